"""Descriptive statistics, correlation, distribution and scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.operators import descriptive as d

from .base import (
    FEATS,
    IDS,
    MULTI,
    PANEL_SQL,
    SCALED_SQL,
    pairs,
    per_variable,
    rnd,
    rounded,
    scaled_panel,
    scaled_sql,
    with_sql,
)
from .base import panel as load


def describe(spark: SparkSession, sf: str) -> DataFrame:
    out = d.describe(load(spark, sf), FEATS)
    return rnd(out, ["mean", "std", "min", "q1", "median", "q3", "max"], 5)


def pearson(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(d.corr_matrix(load(spark, sf), FEATS), ["corr"], 8)


def spearman(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(d.corr_matrix(load(spark, sf), FEATS, "spearman"), ["corr"], 8)


def box(spark: SparkSession, sf: str) -> DataFrame:
    out = d.box_stats(load(spark, sf), FEATS)
    return rnd(out, [c for c in out.columns if c.startswith("z_")], 6)


def zscored(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(d.z_scores(load(spark, sf), FEATS).select(*IDS, *FEATS), FEATS, 6)


def histogram(spark: SparkSession, sf: str) -> DataFrame:
    out = d.histogram(load(spark, sf), FEATS, 30)
    return rnd(out, ["bin_low", "bin_high"], 6)


def series(spark: SparkSession, sf: str) -> DataFrame:
    out = d.series_long(load(spark, sf), MULTI, "month", ["supplier", "season"], day=15)
    return out.withColumn("date", F.col("date").cast("string"))


def standardized(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(d.standardize(load(spark, sf), FEATS)[0].select(*IDS, *FEATS), FEATS, 6)


def matrix(spark: SparkSession, sf: str) -> DataFrame:
    out = d.to_matrix(scaled_panel(spark, sf), MULTI, IDS)
    return out.select(*IDS, *[F.round(F.get("x", i), 6).alias(f"x{i}") for i in range(len(MULTI))])


def inverse(spark: SparkSession, sf: str) -> DataFrame:
    scaler = d.Scaler.fit(load(spark, sf), FEATS)
    back = scaler.inverse(scaler.transform(load(spark, sf)))
    return rnd(back.select(*IDS, *FEATS), FEATS, 6)


def projection(spark: SparkSession, sf: str) -> DataFrame:
    return d.pca_project(scaled_panel(spark, sf), MULTI, IDS)[0]


def _fences(c: str) -> str:
    return f"""SELECT '{c}' AS variable, q1, q2, q3, m, s,
      (SELECT min({c}) FROM panel WHERE {c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS lo,
      (SELECT max({c}) FROM panel WHERE {c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS hi,
      (SELECT count(*) FROM panel WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS n
      FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2,
        quantile_cont({c}, 0.75) AS q3, avg({c}) AS m, stddev_samp({c}) AS s FROM panel)"""


def _hist(c: str) -> str:
    return f"""SELECT '{c}' AS variable,
      CAST(least(floor(({c} - lo) / ((hi - lo) / 30)), 29) AS INTEGER) AS bin, lo, (hi - lo) / 30 AS w
      FROM panel, (SELECT min({c}) AS lo, max({c}) AS hi FROM panel) WHERE {c} IS NOT NULL"""


def _spearman(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS var_a, '{b}' AS var_b, {rounded('corr(ra, rb)', 8)} AS corr FROM (
      SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra,
        rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb
      FROM panel WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""


QUERIES = {
    "st_01_describe": describe,
    "st_02_corr_pearson": pearson,
    "st_03_corr_spearman": spearman,
    "st_04_box_stats": box,
    "st_04_z_scores": zscored,
    "st_05_histogram": histogram,
    "st_06_series_long": series,
    "st_07_standardize": standardized,
    "st_08_to_matrix": matrix,
    "st_09_inverse_scaling": inverse,
    "st_10_pca_project": projection,
}

_STATS = [("mean", "avg({c})"), ("std", "stddev_samp({c})"), ("min", "min({c})"),
          ("q1", "quantile_cont({c}, 0.25)"), ("median", "quantile_cont({c}, 0.5)"),
          ("q3", "quantile_cont({c}, 0.75)"), ("max", "max({c})")]

ORACLES = {
    "st_01_describe": with_sql(
        PANEL_SQL,
        body=per_variable(
            FEATS, "count({c}) AS count, " + ", ".join(f"round({e}, 5) AS {n}" for n, e in _STATS)
        ),
    ),
    "st_02_corr_pearson": with_sql(
        PANEL_SQL,
        body=" UNION ALL ".join(
            f"SELECT '{a}' AS var_a, '{b}' AS var_b, {rounded(f'corr({a}, {b})', 8)} AS corr FROM panel"
            for a, b in pairs(FEATS)
        ),
    ),
    "st_03_corr_spearman": with_sql(
        PANEL_SQL, body=" UNION ALL ".join(_spearman(a, b) for a, b in pairs(FEATS))
    ),
    "st_04_box_stats": with_sql(
        PANEL_SQL, "v AS (" + " UNION ALL ".join(_fences(c) for c in FEATS) + ")",
        body="SELECT variable, "
        + ", ".join(
            f"{rounded(f'({e} - m) / s', 6)} AS z_{n}"
            for n, e in (("q1", "q1"), ("median", "q2"), ("q3", "q3"), ("whisker_low", "lo"), ("whisker_high", "hi"))
        )
        + ", n AS n_fliers FROM v",
    ),
    "st_04_z_scores": with_sql(
        PANEL_SQL,
        "s AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in FEATS) + " FROM panel)",
        body="SELECT supplier, month, "
        + ", ".join(f"{rounded(f'({c} - m_{c}) / s_{c}', 6)} AS {c}" for c in FEATS)
        + " FROM panel, s",
    ),
    "st_05_histogram": with_sql(
        PANEL_SQL, "h AS (" + " UNION ALL ".join(_hist(c) for c in FEATS) + ")",
        body="""SELECT variable, bin, round(lo + bin * w, 6) AS bin_low, round(lo + (bin + 1) * w, 6) AS bin_high,
        count(*) AS n FROM h GROUP BY variable, bin, lo, w""",
    ),
    "st_06_series_long": with_sql(
        PANEL_SQL,
        body=" UNION ALL ".join(
            f"SELECT CAST(make_date(CAST(year AS INTEGER), CAST(month_no AS INTEGER), 15) AS VARCHAR) AS date, supplier, season, '{c}' AS variable, {c} AS value FROM panel"
            for c in MULTI
        ),
    ),
    "st_07_standardize": with_sql(
        PANEL_SQL, scaled_sql("z", "panel", FEATS, IDS),
        body="SELECT supplier, month, " + ", ".join(f"{rounded(c, 6)} AS {c}" for c in FEATS) + " FROM z",
    ),
    "st_08_to_matrix": with_sql(
        PANEL_SQL, SCALED_SQL,
        body="SELECT supplier, month, " + ", ".join(f"{rounded(c, 6)} AS x{i}" for i, c in enumerate(MULTI)) + " FROM z",
    ),
    "st_09_inverse_scaling": with_sql(
        PANEL_SQL, body="SELECT supplier, month, " + ", ".join(f"round({c}, 6) AS {c}" for c in FEATS) + " FROM panel"
    ),
}
