"""Small column helpers: quoting, missing values, wide/long reshaping."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """Column by literal name, safe for names with dots, blanks and brackets."""
    return F.col("`" + name.replace("`", "``") + "`")


def num(name: str) -> Column:
    """Column as DOUBLE with NaN turned into NULL.

    A raw NaN sorts above every number in Spark and would be flagged by any upper fence.
    """
    return F.nullif(col(name).cast("double"), F.lit(float("nan")))


def nan_to_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace ``cols`` by their DOUBLE value with NaN as NULL."""
    return df.withColumns({c: num(c) for c in cols})


def flag(condition: Column) -> Column:
    """Boolean where an unknown comparison counts as false."""
    return F.coalesce(condition, F.lit(False))


def all_of(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def any_of(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def total(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0))


def long_form(
    df: DataFrame,
    keep: Sequence[str],
    fields: dict[str, dict[str, Column]],
    name: str = "variable",
) -> DataFrame:
    """One output row per input row and entry of ``fields``: ``name`` plus the entry's columns."""
    entries = [
        F.struct(F.lit(label).alias(name), *[c.alias(k) for k, c in cols.items()])
        for label, cols in fields.items()
    ]
    return df.select(*[col(c) for c in keep], F.explode(F.array(*entries)).alias("_e")).select(
        *[col(c) for c in keep], "_e.*"
    )


def aggregate_long(
    df: DataFrame,
    cols: Sequence[str],
    measures: dict[str, Callable[[Column], Column]],
    name: str = "variable",
) -> DataFrame:
    """All ``measures`` of all ``cols`` in one wide aggregation, returned one row per column.

    ``position`` is the declared order of the variable, kept for tie-breaks.
    """
    aggs = [fn(num(c)).alias(f"m{i}_{k}") for i, c in enumerate(cols) for k, fn in measures.items()]
    wide = df.agg(*aggs)
    return long_form(
        wide,
        [],
        {
            c: {"position": F.lit(i), **{k: F.col(f"m{i}_{k}") for k in measures}}
            for i, c in enumerate(cols)
        },
        name,
    )


def corrected_skew(c: Column) -> Column:
    """Bias-corrected sample skewness (NULL below three values)."""
    n = F.count(c).cast("double")
    g1 = F.skewness(c)
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def missing_fraction(c: Column) -> Column:
    return F.avg(c.isNull().cast("double"))
