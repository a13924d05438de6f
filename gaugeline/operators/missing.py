"""Missing-data profile, imputation decisions, simple fills and Little's test."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (
    aggregate_long,
    col,
    corrected_skew,
    missing_fraction,
    num,
    total,
)
from ..functions.fixed_values import ANNUAL, DROP_ABOVE, SIMPLE_BELOW, SKEW_ABOVE
from ..functions.quantiles import medians


# --- profile ------------------------------------------------------------------


def missing_rate(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Missing fraction per variable, highest first."""
    out = aggregate_long(df, features, {"missing": missing_fraction})
    return out.orderBy(F.desc("missing"), "position").select("variable", "missing")


def coverage(
    df: DataFrame, features: Sequence[str], period: str, *, month: str | None = None
) -> DataFrame:
    """Period by variable: 1 where the variable was measured at least once.

    On a long table, name its ``month`` column: annual summary rows measure nothing and are left out.
    """
    rows = df if month is None else df.filter(~col(month).eqNullSafe(F.lit(ANNUAL)))
    return rows.groupBy(col(period)).agg(
        *[F.max(num(c).isNotNull().cast("int")).alias(c) for c in features]
    )


def missing_by_period(
    df: DataFrame,
    features: Sequence[str],
    period: str,
    *,
    above: float = 0.01,
    below: float = 1.0,
) -> DataFrame:
    """Percent missing per period for variables whose overall rate lies between the bounds."""
    row = df.agg(*[missing_fraction(num(c)).alias(f"f{i}") for i, c in enumerate(features)]).first()
    chosen = [c for c, f in zip(features, row, strict=True) if f is not None and above < f < below]
    return df.groupBy(col(period)).agg(
        *[(missing_fraction(num(c)) * 100).alias(c) for c in chosen]
    )


def missing_corr(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Correlation between missingness indicators, long form, varying indicators only."""
    gap = {c: num(c).isNull().cast("double") for c in features}
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    wide = df.agg(*[F.corr(gap[a], gap[b]).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    entries = F.array(
        *[
            F.struct(F.lit(a).alias("var_a"), F.lit(b).alias("var_b"), F.col(f"c{i}").alias("corr"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    # The correlation with a constant indicator is undefined (NULL or NaN) and dropped.
    return (
        wide.select(F.explode(entries).alias("e"))
        .select("e.*")
        .filter(F.col("corr").isNotNull() & ~F.isnan("corr"))
    )


def presence_matrix(df: DataFrame, id_cols: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Row by variable presence."""
    return df.select(*[col(c) for c in id_cols], *[num(c).isNotNull().alias(c) for c in features])


# --- decisions ----------------------------------------------------------------


def impute_decision(
    fraction: Column, skew: Column, *, inclusive_skew: bool = False
) -> Column:
    """``drop`` above 30 % missing, ``knn`` from 5 %, else ``median`` if skewed or ``mean``."""
    size = F.abs(skew)
    skewed = size >= SKEW_ABOVE if inclusive_skew else size > SKEW_ABOVE
    return (
        F.when(fraction > DROP_ABOVE, "drop")
        .when(fraction >= SIMPLE_BELOW, "knn")
        .when(skewed, "median")
        .otherwise("mean")
    )


def missing_summary(
    df: DataFrame, features: Sequence[str], *, inclusive_skew: bool = False
) -> DataFrame:
    """``variable, pct_missing, skew, decision``, most missing first; one scan."""
    stats = aggregate_long(df, features, {"fraction": missing_fraction, "skew": corrected_skew})
    # A constant column has no skewness.
    skew = F.nullif("skew", F.lit(float("nan")))
    return (
        stats.withColumn("skew", skew)
        .withColumn(
            "decision",
            impute_decision(F.col("fraction"), F.col("skew"), inclusive_skew=inclusive_skew),
        )
        .orderBy(F.desc("fraction"), "position")
        .select(
            "variable",
            F.round(F.col("fraction") * 100, 2).alias("pct_missing"),
            F.round("skew", 2).alias("skew"),
            "decision",
        )
    )


@dataclass(frozen=True)
class ImputationPlan:
    """Names per decision; ``summary`` is the table behind it."""

    drop: list[str] = field(default_factory=list)
    mean: list[str] = field(default_factory=list)
    median: list[str] = field(default_factory=list)
    knn: list[str] = field(default_factory=list)
    summary: DataFrame | None = None

    @property
    def kept(self) -> list[str]:
        return self.mean + self.median + self.knn


def plan_imputation(df: DataFrame, features: Sequence[str]) -> ImputationPlan:
    """Sort the features into drop, mean, median and knn (one row per feature is collected)."""
    summary = missing_summary(df, features)
    rows = summary.select("variable", "decision").collect()
    names = {
        d: [r.variable for r in rows if r.decision == d] for d in ("drop", "mean", "median", "knn")
    }
    return ImputationPlan(**names, summary=summary)


# --- simple fills -------------------------------------------------------------


def fill_values(
    df: DataFrame, mean_cols: Sequence[str], median_cols: Sequence[str]
) -> dict[str, float | None]:
    out: dict[str, float | None] = {}
    if mean_cols:
        row = df.agg(*[F.avg(num(c)).alias(f"a{i}") for i, c in enumerate(mean_cols)]).first()
        out.update(zip(mean_cols, row, strict=True))
    if median_cols:
        out.update(medians(df, {c: num(c) for c in median_cols}))
    return out


def impute_simple(
    df: DataFrame, mean_cols: Sequence[str] = (), median_cols: Sequence[str] = ()
) -> DataFrame:
    """Fill gaps by the mean or the median of the column."""
    values = fill_values(df, mean_cols, median_cols)
    return df.withColumns(
        {c: F.coalesce(num(c), F.lit(v).cast("double")) for c, v in values.items()}
    )


# --- validation ---------------------------------------------------------------


def _delta_pct(before: Column, after: Column) -> Column:
    return F.when(before != 0, F.round((after - before) / F.abs(before) * 100, 2))


def validate_imputation(before: DataFrame, after: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean, median and sample deviation before and after, with relative changes."""
    present = set(after.columns)
    cols = [c for c in features if c in present]
    measures = {"mean": F.avg, "std": F.stddev_samp}
    med_b = medians(before, {c: num(c) for c in cols})
    med_a = medians(after, {c: num(c) for c in cols})
    sides = []
    for side, frame in (("before", before), ("after", after)):
        stats = aggregate_long(frame, cols, measures)
        sides.append(
            stats.select(
                "variable",
                "position",
                F.col("mean").alias(f"mean_{side}"),
                F.col("std").alias(f"std_{side}"),
            )
        )
    middle = df_of_values(before, {c: (med_b[c], med_a[c]) for c in cols}, ["median_before", "median_after"])
    joined = sides[0].join(sides[1].drop("position"), "variable").join(middle, "variable")
    return joined.orderBy("position").select(
        "variable",
        F.round("mean_before", 3).alias("mean_before"),
        F.round("mean_after", 3).alias("mean_after"),
        F.round("median_before", 3).alias("median_before"),
        F.round("median_after", 3).alias("median_after"),
        F.round("std_before", 3).alias("std_before"),
        F.round("std_after", 3).alias("std_after"),
        _delta_pct(F.col("mean_before"), F.col("mean_after")).alias("delta_mean_pct"),
        _delta_pct(F.col("std_before"), F.col("std_after")).alias("delta_std_pct"),
    )


def df_of_values(
    df: DataFrame, values: dict[str, tuple[float | None, ...]], names: Sequence[str]
) -> DataFrame:
    """Per-variable numbers (one row per variable) as a DataFrame."""
    schema = "variable string, " + ", ".join(f"`{n}` double" for n in names)
    return df.sparkSession.createDataFrame([(k, *v) for k, v in values.items()], schema)


# --- Little's test ------------------------------------------------------------


def pattern_key(features: Sequence[str]) -> Column:
    """Presence pattern as text, one character per feature."""
    return F.concat(*[F.when(num(c).isNull(), "0").otherwise("1") for c in features])


def missing_patterns(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows and mean of every variable per presence pattern."""
    return df.groupBy(pattern_key(features).alias("pattern")).agg(
        F.count("*").alias("n"), *[F.avg(num(c)).alias(c) for c in features]
    )


def chi2_tail(x: float, dof: float) -> float:
    """P(X > x) for a chi-square variable: regularised upper incomplete gamma."""
    a, z = dof / 2.0, x / 2.0
    if z <= 0:
        return 1.0
    scale = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:
        term = acc = 1.0 / a
        n = a
        while abs(term) > abs(acc) * 1e-16:
            n += 1
            term *= z / n
            acc += term
        return max(0.0, 1.0 - acc * scale)
    tiny = 1e-300
    b = z + 1 - a
    c, d = 1 / tiny, 1 / b
    h, i = d, 0
    while True:
        i += 1
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            return min(1.0, h * scale)


def little_mcar(df: DataFrame, features: Sequence[str], *, min_observed: float = 0.5) -> DataFrame:
    """Approximate test that gaps are completely random: ``chi2, df, p_value``.

    Patterns stay distributed. A pattern contributes n·d'Sd with S the pseudo-inverse of the
    full covariance and d zero at unobserved variables, which equals the sub-block form.
    """
    spark = df.sparkSession
    schema = "chi2 double, df bigint, p_value double"
    row = df.agg(*[missing_fraction(num(c)).alias(f"f{i}") for i, c in enumerate(features)]).first()
    cols = [c for c, f in zip(features, row, strict=True) if f is not None and 1 - f >= min_observed]
    if len(cols) < 2:
        return spark.createDataFrame([(None, None, None)], schema)
    p = len(cols)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    stats = df.agg(
        *[F.avg(num(c)).alias(f"m{i}") for i, c in enumerate(cols)],
        *[F.covar_samp(num(cols[i]), num(cols[j])).alias(f"s{i}_{j}") for i, j in pairs],
    ).first()
    mean, cov = stats[:p], np.zeros((p, p))
    for (i, j), v in zip(pairs, stats[p:], strict=True):
        cov[i, j] = cov[j, i] = 0.0 if v is None or math.isnan(v) else v
    inverse = np.linalg.pinv(cov + np.eye(p) * 1e-6)

    patterns = missing_patterns(df.select(*[num(c).alias(f"x{i}") for i, c in enumerate(cols)]),
                                [f"x{i}" for i in range(p)])
    # NULL means unobserved in the pattern; such terms drop out as zeros.
    diff = patterns.select(
        "n",
        *[
            F.coalesce(F.col(f"x{i}") - F.lit(mean[i]), F.lit(0.0)).alias(f"d{i}")
            for i in range(p)
        ],
        F.length(F.replace("pattern", F.lit("0"), F.lit(""))).alias("observed"),
    )
    quad = total(
        [
            F.col(f"d{i}") * total([F.col(f"d{j}") * float(inverse[i, j]) for j in range(p)])
            for i in range(p)
        ]
    )
    chi2, dof = diff.agg(F.sum(F.col("n") * quad), F.sum("observed")).first()
    dof = max(int(dof) - p, 1)
    result = (round(float(chi2), 3), dof, round(chi2_tail(float(chi2), dof), 5))
    return spark.createDataFrame([result], schema)
