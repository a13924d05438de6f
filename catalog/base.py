"""Inputs shared by the registered queries, each with the SQL that defines it."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.functions.columns import col
from gaugeline.functions.fixed_values import ANNUAL, MONTHS, STATISTICS
from gaugeline.functions.session import checkpoint_dir, keep
from gaugeline.operators.limits import Limit
from gaugeline.operators.panel import season

IDS = ["supplier", "month"]
FEATS = [
    "rev_open",
    "min_price_taxed",
    "wsum",
    "rev_R",
    "rev_A",
    "max_price_lowdisc",
    "tax_big",
]
MULTI = ["rev_open", "min_price_taxed", "wsum"]
KEPT = ["rev_open", "wsum", "min_price_taxed", "rev_R", "rev_A", "max_price_lowdisc"]
EVENT = (1997, 1998)
LIMITS = (
    Limit("rev_open", None, 300000.0),
    Limit("min_price_taxed", 1500.0, None),
    Limit("wsum", 100.0, 1200.0),
    Limit("rev_R", None, 200000.0, True),
    Limit("max_price_lowdisc", None, 85000.0),
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh place in the shared folder for tables a query writes and reads back."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def _exact(value: Column, digits: int, where: Column | None = None) -> Column:
    """Sum of decimals: the same number whatever the order of the rows."""
    c = F.round(value, digits).cast(f"decimal(18,{digits})")
    c = c if where is None else F.when(where, c)
    return F.sum(c).cast("double")


#: Lines a task groups, and of the long statistics, which hold more of each group.
DEALT, LONG_DEALT = 1_000_000, 250_000


def dealt(lines: DataFrame, *keys: Column, rows: int | None = None) -> DataFrame:
    """Lines of equal keys in one task, with as many tasks as the table's size asks for: no task's table of groups grows with it."""
    usual = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lines.repartition(max(usual, lines.count() // (rows or DEALT)), *keys)


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier by month panel with gaps of every kind; cached once per session and folder."""
    price, tax = F.col("l_extendedprice"), F.col("l_tax")
    big = F.col("l_quantity") >= 49
    month = F.trunc(F.col("l_shipdate").cast("date"), "month")
    lines = table(spark, sf, "lineitem").withColumns({"supplier": F.col("l_suppkey"), "month": month})
    grouped = (
        dealt(lines, F.col("supplier"), F.col("month"))
        .groupBy("supplier", "month")
        .agg(
            _exact(price, 2, F.col("l_linestatus") == "O").alias("rev_open"),
            F.min(F.when(tax > 0.01, price)).alias("min_price_taxed"),
            _exact(tax * tax * price, 6, F.col("l_quantity") < 48).alias("wsum"),
            _exact(price, 2, F.col("l_returnflag") == "R").alias("rev_R"),
            _exact(price, 2, F.col("l_returnflag") == "A").alias("rev_A"),
            F.max(F.when(F.col("l_discount") < 0.03, price)).alias("max_price_lowdisc"),
            (_exact(tax, 2, big) / F.nullif(F.count_if(big), F.lit(0))).alias("tax_big"),
        )
    )
    return keep(
        grouped.withColumns(
            {
                "year": F.year("month"),
                "month_no": F.month("month"),
                "season": season(F.month("month")),
            }
        ).select(
            "supplier",
            # Text keys read the same in every engine.
            F.col("month").cast("string").alias("month"),
            "year",
            "month_no",
            "season",
            *FEATS,
        )
    )


PANEL_SQL = """
panel0 AS (
  SELECT l_suppkey AS supplier, CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
    CAST(sum(CAST(round(l_extendedprice, 2) AS DECIMAL(18,2))) FILTER (WHERE l_linestatus = 'O') AS DOUBLE) AS rev_open,
    min(l_extendedprice) FILTER (WHERE l_tax > 0.01) AS min_price_taxed,
    CAST(sum(CAST(round(l_tax * l_tax * l_extendedprice, 6) AS DECIMAL(18,6))) FILTER (WHERE l_quantity < 48) AS DOUBLE) AS wsum,
    CAST(sum(CAST(round(l_extendedprice, 2) AS DECIMAL(18,2))) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) AS rev_R,
    CAST(sum(CAST(round(l_extendedprice, 2) AS DECIMAL(18,2))) FILTER (WHERE l_returnflag = 'A') AS DOUBLE) AS rev_A,
    max(l_extendedprice) FILTER (WHERE l_discount < 0.03) AS max_price_lowdisc,
    CAST(sum(CAST(round(l_tax, 2) AS DECIMAL(18,2))) FILTER (WHERE l_quantity >= 49) AS DOUBLE)
      / nullif(count(*) FILTER (WHERE l_quantity >= 49), 0) AS tax_big
  FROM lineitem GROUP BY 1, 2),
panel AS MATERIALIZED (
  SELECT supplier, CAST(month AS VARCHAR) AS month, CAST(year(month) AS INTEGER) AS year, CAST(month(month) AS INTEGER) AS month_no,
    CASE WHEN month(month) IN (10, 11, 12, 1, 2, 3) THEN 'wet' ELSE 'dry' END AS season,
    rev_open, min_price_taxed, wsum, rev_R, rev_A, max_price_lowdisc, tax_big FROM panel0)"""

LONG_FEATS = ["Qty.(u)", "Price (cur)", "Disc-rate"]
_SOURCE = dict(zip(LONG_FEATS, ["l_quantity", "l_extendedprice", "l_discount"], strict=True))


def long_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Long-statistic table: minimum, mean and maximum per supplier and month, and per year."""
    name = F.get(F.array(*[F.lit(m) for m in MONTHS]), F.month("l_shipdate") - 1)
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("supplier"), "l_shipdate", *_SOURCE.values())
    # Months and years are grouped from the same dealt lines: these are shuffled once, and nothing else is.
    lines = dealt(lines, F.col("supplier"), F.year("l_shipdate"), rows=LONG_DEALT).withColumns({"Ano": F.year("l_shipdate"), "Mes": name})
    aggs = [
        agg.alias(f"{kind}{i}")
        for i, c in enumerate(_SOURCE.values())
        for kind, agg in (
            ("lo", F.min(c)),
            ("mid", _exact(F.col(c), 2) / F.count("*")),
            ("hi", F.max(c)),
        )
    ]
    grouped = (
        lines.groupBy("supplier", "Ano", "Mes").agg(*aggs)
        .unionByName(lines.groupBy("supplier", "Ano").agg(*aggs).withColumn("Mes", F.lit(ANNUAL)))
    )
    stats = [
        F.struct(
            F.lit(s).alias("Calc"),
            *[F.col(f"{kind}{i}").alias(c) for i, c in enumerate(LONG_FEATS)],
        )
        for s, kind in zip(STATISTICS, ("lo", "mid", "hi"), strict=True)
    ]
    return grouped.select("supplier", "Ano", "Mes", F.explode(F.array(*stats)).alias("e")).select(
        "supplier", "Ano", "Mes", "e.*"
    )


_MONTH_LIST = ", ".join(f"'{m}'" for m in MONTHS)
_LONG_AGGS = ", ".join(
    f"min({c}) AS lo{i}, CAST(sum(CAST(round({c}, 2) AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mid{i}, max({c}) AS hi{i}"
    for i, c in enumerate(_SOURCE.values())
)
_LONG_PICK = " UNION ALL ".join(
    f"SELECT supplier, Ano, Mes, '{s}' AS Calc, "
    + ", ".join(f'{k}{i} AS "{c}"' for i, c in enumerate(LONG_FEATS))
    + " FROM long0"
    for s, k in zip(STATISTICS, ("lo", "mid", "hi"), strict=True)
)
LONG_SQL = f"""
long0 AS (
  SELECT l_suppkey AS supplier, CAST(year(l_shipdate) AS INTEGER) AS Ano,
    [{_MONTH_LIST}][CAST(month(l_shipdate) AS INTEGER)] AS Mes, {_LONG_AGGS}
  FROM lineitem GROUP BY 1, 2, 3
  UNION ALL
  SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER), '{ANNUAL}', {_LONG_AGGS}
  FROM lineitem GROUP BY 1, 2),
long_stats AS ({_LONG_PICK})"""


def with_sql(*parts: str, body: str) -> str:
    """SELECT with the given common table expressions."""
    return "WITH " + ",".join(p.strip() for p in parts) + "\n" + body.strip()


def q(name: str) -> str:
    return '"' + name + '"'


def rounded(c: str, digits: int = 4) -> str:
    """SQL rounding without a negative zero."""
    return f"(round({c}, {digits}) + 0.0)"


def rnd(df: DataFrame, cols: Sequence[str], digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(col(c), digits) for c in cols})


def per_variable(features: Sequence[str], select: str, source: str = "panel") -> str:
    """UNION ALL of one aggregate row per variable; ``{c}`` is the column, ``{i}`` its place."""
    return " UNION ALL ".join(
        f"SELECT '{c}' AS variable, {select.format(c=c, i=i)} FROM {source}"
        for i, c in enumerate(features)
    )


def pairs(features: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]


def complete(features: Sequence[str]) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in features)


def scaled_sql(name: str, source: str, features: Sequence[str], keep_cols: Sequence[str]) -> str:
    """CTEs ``name`` with population-standardised features of ``source``."""
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in features)
    cols = ", ".join(
        f"({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END AS {c}" for c in features
    )
    ids = ", ".join(keep_cols)
    return (
        f"{name}_stats AS (SELECT {stats} FROM {source}), "
        f"{name} AS MATERIALIZED (SELECT {ids}, {cols} FROM {source}, {name}_stats)"
    )


def embedding_columns(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    """One DOUBLE column per vector component; all vectors must be of one length."""
    least, most = table(spark, sf, "embeddings").agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if least != most:
        raise ValueError(f"vectors of {least} to {most} components")
    names = [f"e{i}" for i in range(most or 0)]
    df = table(spark, sf, "embeddings").select(
        "vec_id", "label", *[F.get("embedding", i).cast("double").alias(c) for i, c in enumerate(names)]
    )
    return df, names


def scaled_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Complete, standardised rows of the variables with few gaps."""
    from gaugeline.operators.descriptive import Scaler
    from gaugeline.operators.panel import complete_cases, select_by_missing

    rows = panel(spark, sf)
    multi = select_by_missing(rows, FEATS)
    whole = complete_cases(rows, multi)
    return keep(Scaler.fit(whole, multi).transform(whole).select(*IDS, "year", "season", *multi))


SCALED_SQL = (
    f"whole AS (SELECT * FROM panel WHERE {complete(MULTI)}), "
    + scaled_sql("z", "whole", MULTI, [*IDS, "year", "season"])
)

