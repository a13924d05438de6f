"""Checks against one-sided and two-sided limits, and the labels built on them."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import any_of, col, flag, long_form, num, total
from ..functions.fixed_values import CLASS2_LIMITS
from ..functions.quantiles import medians


class Limit(NamedTuple):
    variable: str
    low: float | None
    high: float | None
    indicative: bool = False


CLASS2 = tuple(Limit(*row) for row in CLASS2_LIMITS)


def limits_from_table(table: DataFrame, features: Sequence[str]) -> tuple[Limit, ...]:
    """Limits of the given features from a table ``variable, low, high, indicative``.

    A variable may appear once, so no more rows than features come to the driver.
    """
    features = list(features)
    rows = (
        table.filter(F.col("variable").isin(features))
        .select("variable", "low", "high", "indicative")
        .limit(len(features) + 1)
        .collect()
    )
    if len(rows) > len({r.variable for r in rows}):
        raise ValueError("limits table lists a variable more than once")
    order = {c: i for i, c in enumerate(features)}
    return tuple(Limit(*r) for r in sorted(rows, key=lambda r: order[r.variable]))


def active_limits(
    df: DataFrame,
    limits: Sequence[Limit],
    features: Sequence[str] | None = None,
    exclude_indicative: bool = False,
) -> list[Limit]:
    present = set(df.columns)
    wanted = present if features is None else present & set(features)
    return [
        lim for lim in limits if lim.variable in wanted and not (exclude_indicative and lim.indicative)
    ]


def violates(lim: Limit, value: Column | None = None) -> Column:
    """True where the value lies outside the limit; missing is never outside."""
    x = num(lim.variable) if value is None else value
    parts = []
    if lim.low is not None:
        parts.append(flag(x < F.lit(lim.low)))
    if lim.high is not None:
        parts.append(flag(x > F.lit(lim.high)))
    return any_of(parts)


def limit_violations(
    df: DataFrame,
    limits: Sequence[Limit] = CLASS2,
    *,
    features: Sequence[str] | None = None,
    exclude_indicative: bool = False,
    prefix: str = "viol_",
) -> DataFrame:
    """Add one boolean per limited variable that is present."""
    act = active_limits(df, limits, features, exclude_indicative)
    return df.withColumns({prefix + lim.variable: violates(lim) for lim in act})


def violations_expr(
    df: DataFrame,
    limits: Sequence[Limit] = CLASS2,
    *,
    features: Sequence[str] | None = None,
    exclude_indicative: bool = False,
) -> Column:
    act = active_limits(df, limits, features, exclude_indicative)
    return total([violates(lim).cast("int") for lim in act]).cast("int")


def violation_count(
    df: DataFrame,
    limits: Sequence[Limit] = CLASS2,
    *,
    features: Sequence[str] | None = None,
    exclude_indicative: bool = False,
    name: str = "n_violations",
) -> DataFrame:
    """Add the number of violated limits per row."""
    return df.withColumn(
        name,
        violations_expr(df, limits, features=features, exclude_indicative=exclude_indicative),
    )


def label_any(
    df: DataFrame,
    limits: Sequence[Limit] = CLASS2,
    *,
    features: Sequence[str] | None = None,
    name: str = "inadequate",
) -> tuple[DataFrame, list[str]]:
    """Label 1 where any limit is violated; also the variables the rule used."""
    act = active_limits(df, limits, features)
    out = df.withColumn(name, any_of([violates(lim) for lim in act]).cast("int"))
    return out, [lim.variable for lim in act]


def label_severity(
    df: DataFrame,
    limits: Sequence[Limit] = CLASS2,
    *,
    features: Sequence[str] | None = None,
    threshold: float | None = None,
    name: str = "severity_high",
) -> tuple[DataFrame, list[str]]:
    """Label 1 where the violation count exceeds its median (or ``threshold``)."""
    act = active_limits(df, limits, features)
    count = total([violates(lim).cast("int") for lim in act])
    if threshold is None:
        threshold = medians(df, {"n": count.cast("double")})["n"]
    label = (count > F.lit(threshold)).cast("int")
    return df.withColumn(name, label), [lim.variable for lim in act]


def violation_detail(
    df: DataFrame, id_cols: Sequence[str], limits: Sequence[Limit] = CLASS2
) -> DataFrame:
    """Long table: id, variable, value, whether it violates and whether the limit is indicative."""
    act = active_limits(df, limits)
    return long_form(
        df,
        id_cols,
        {
            lim.variable: {
                "value": num(lim.variable),
                "violates": violates(lim),
                "indicative": F.lit(lim.indicative),
            }
            for lim in act
        },
    )


def label_profile(df: DataFrame, label: str, count: str) -> DataFrame:
    """Rows per label class, with lowest, median and highest violation count over all rows."""
    median = medians(df, {"n": col(count).cast("double")})["n"]
    low, high = df.agg(F.min(col(count)), F.max(col(count))).first()
    return (
        df.groupBy(col(label))
        .agg(F.count("*").alias("n"))
        .withColumns(
            {
                "min_violations": F.lit(low),
                "median_violations": F.lit(median),
                "max_violations": F.lit(high),
            }
        )
    )
