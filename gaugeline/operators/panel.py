"""Filters, projections and time attributes of the modelling panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import aggregate_long, all_of, col, flag, missing_fraction, num
from ..functions.fixed_values import (
    ANNUAL,
    FEATURE_GROUPS,
    FEATURES,
    MONTHS,
    MULTI_MAX_MISSING,
    STATISTICS,
    WET_MONTHS,
)


def month_number(c: Column, months: Sequence[str] = MONTHS) -> Column:
    lookup = F.create_map(*[F.lit(x) for i, m in enumerate(months, 1) for x in (m, i)])
    return F.try_element_at(lookup, c)


def season(month_no: Column, wet_months: Sequence[int] = WET_MONTHS) -> Column:
    return F.when(month_no.isin(list(wet_months)), "wet").otherwise("dry")


def add_time_features(
    df: DataFrame, date_col: str = "date", wet_months: Sequence[int] = WET_MONTHS
) -> DataFrame:
    """Add ``month_no``, ``quarter`` and ``season`` from a date column."""
    month = F.month(col(date_col))
    return df.withColumns(
        {
            "month_no": month,
            "quarter": F.quarter(col(date_col)),
            "season": season(month, wet_months),
        }
    )


def select_stat(
    df: DataFrame,
    stat: str = STATISTICS[1],
    *,
    stat_col: str = "Calc",
    period_col: str = "Mes",
    annual: str = ANNUAL,
) -> DataFrame:
    """Rows of one statistic without the annual summary rows."""
    return df.filter((col(stat_col) == stat) & (col(period_col) != annual))


def build_panel(
    df: DataFrame,
    stat: str = STATISTICS[1],
    *,
    features: Sequence[str] = FEATURES,
    keys: Sequence[str] = (),
    year_col: str = "Ano",
    period_col: str = "Mes",
    stat_col: str = "Calc",
    annual: str = ANNUAL,
    months: Sequence[str] = MONTHS,
    wet_months: Sequence[int] = WET_MONTHS,
    sort: bool = False,
) -> DataFrame:
    """One row per period of one statistic, with date, month number, quarter and season.

    Sorting by date is for sinks; leave it off between operators.
    """
    sub = select_stat(df, stat, stat_col=stat_col, period_col=period_col, annual=annual)
    number = month_number(col(period_col), months)
    out = add_time_features(
        sub.withColumn("date", F.make_date(col(year_col), number, F.lit(1))), "date", wet_months
    ).select(
        "date",
        *[col(c) for c in keys],
        col(year_col),
        col(period_col),
        "month_no",
        "quarter",
        "season",
        *[num(c).alias(c) for c in features],
    )
    return out.orderBy("date") if sort else out


def missing_fractions(df: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """Missing fraction of each feature: one aggregate, one number per feature on the driver."""
    row = df.agg(*[missing_fraction(num(c)).alias(f"f{i}") for i, c in enumerate(features)]).first()
    return {c: row[i] for i, c in enumerate(features)}


def select_by_missing(
    df: DataFrame, features: Sequence[str], max_missing: float = MULTI_MAX_MISSING
) -> list[str]:
    """Features, in order, that miss at most ``max_missing`` of the rows."""
    rates = missing_fractions(df, features)
    return [c for c in features if rates[c] is not None and rates[c] <= max_missing]


def complete_cases(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows with every feature present."""
    return df.filter(all_of([num(c).isNotNull() for c in features]))


def expand_flags(
    full: DataFrame, subset: DataFrame, id_cols: Sequence[str], flags: Sequence[str]
) -> DataFrame:
    """Bring flags of a subset back to all rows; rows outside the subset get false."""
    part = subset.select(*[col(c) for c in id_cols], *[col(f) for f in flags])
    return full.join(part, list(id_cols), "left").withColumns({f: flag(col(f)) for f in flags})


def drop_leaky(features: Sequence[str], used: Sequence[str]) -> list[str]:
    """Features, in order, without those that define the label."""
    taken = set(used)
    return [c for c in features if c not in taken]


def join_confirmed(
    panel: DataFrame,
    confirmed: DataFrame,
    keys: Sequence[str],
    extra: Sequence[str],
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Panel rows whose key is confirmed, with the extra columns of the confirmed row.

    Restricting to the key set first and joining afterwards equals one inner join.
    """
    right = confirmed.select(*[col(c) for c in keys], *[col(c) for c in extra])
    out = panel.join(right, list(keys), "inner")
    return out.orderBy(*[col(c) for c in order_by]) if order_by else out


def group_summary(
    df: DataFrame, groups: dict[str, Sequence[str]] = FEATURE_GROUPS
) -> DataFrame:
    """Per theme: number of variables, observed values and mean missing fraction."""
    variables = [v for vs in groups.values() for v in vs]
    per_variable = aggregate_long(
        df, variables, {"observed": F.count, "missing": missing_fraction}
    )
    theme = F.create_map(*[F.lit(x) for g, vs in groups.items() for v in vs for x in (v, g)])
    return (
        per_variable.withColumn("theme", F.element_at(theme, F.col("variable")))
        .groupBy("theme")
        .agg(
            F.count("*").alias("n_variables"),
            F.sum("observed").alias("n_observed"),
            F.avg("missing").alias("mean_missing"),
        )
    )
