"""Univariate outlier rules.

Every rule compares a value with a few statistics of its column. ``Profile`` computes the
statistics of all columns together (a wide aggregate, shared quantile rounds, one more for the
deviation from the median), and the rules are plain column expressions over constants, so
flagging is one pass of generated code without a join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import any_of, col, flag, long_form, num
from ..functions.fixed_values import IQR_FACTOR, MAD_ABOVE, MAD_FACTOR, MIN_OBSERVATIONS
from ..functions.quantiles import exact_quantiles, medians
from .descriptive import Scaler
from .medcouple import medcouple_values

METHODS = ["IQR_1.5", "IQR_3.0", "Z-score", "MAD", "Percentil_1-99", "Tukey_adj"]


@dataclass(frozen=True)
class Profile:
    """Column statistics behind the rules; one small record per column."""

    count: dict[str, int]
    mean: dict[str, float | None]
    std: dict[str, float | None]
    quantile: dict[str, dict[float, float | None]]
    mad: dict[str, float | None]
    medcouple: dict[str, float | None]

    @staticmethod
    def fit(
        df: DataFrame,
        features: Sequence[str],
        *,
        mad: bool = False,
        medcouple: bool = False,
        tails: bool = False,
    ) -> Profile:
        row = df.agg(
            *[f(num(c)).alias(f"{f.__name__}{i}") for i, c in enumerate(features)
              for f in (F.count, F.avg, F.stddev_pop)]
        ).first()
        count = {c: row[3 * i] for i, c in enumerate(features)}
        probs = [0.25, 0.5, 0.75, *([0.01, 0.99] if tails else [])]
        cols = {c: num(c) for c in features}
        found = exact_quantiles(df, cols, probs, counts=count)
        quantile = {c: dict(zip(probs, v, strict=True)) for c, v in found.items()}
        middle = {c: quantile[c][0.5] for c in features}
        deviations: dict[str, float | None] = dict.fromkeys(features)
        if mad:
            known = [c for c in features if middle[c] is not None]
            deviations.update(
                medians(df, {c: F.abs(num(c) - F.lit(middle[c])) for c in known},
                        counts={c: count[c] for c in known})
            )
        mc: dict[str, float | None] = dict.fromkeys(features)
        if medcouple:
            mc.update(medcouple_values(df, features, centers=middle))
        return Profile(
            count,
            {c: row[3 * i + 1] for i, c in enumerate(features)},
            {c: row[3 * i + 2] for i, c in enumerate(features)},
            quantile,
            deviations,
            mc,
        )

    def too_few(self, c: str, min_obs: int) -> bool:
        return self.count[c] == 0 or self.count[c] < min_obs

    def iqr(self, c: str, k: float = IQR_FACTOR, *, min_obs: int = 0, skip_flat: bool = False) -> Column:
        q1, q3 = self.quantile[c][0.25], self.quantile[c][0.75]
        if self.too_few(c, min_obs) or (skip_flat and q1 == q3):
            return F.lit(False)
        x, width = num(c), q3 - q1
        return flag((x < F.lit(q1 - k * width)) | (x > F.lit(q3 + k * width)))

    def zscore(self, c: str, t: float = 3.0, *, min_obs: int = 0) -> Column:
        if self.too_few(c, min_obs) or not self.std[c]:
            return F.lit(False)
        return flag(F.abs((num(c) - F.lit(self.mean[c])) / F.lit(self.std[c])) > t)

    def robust_z(
        self, c: str, t: float = MAD_ABOVE, *, min_obs: int = 0, zero_mad: str = "skip"
    ) -> Column:
        mad = self.mad[c]
        if self.too_few(c, min_obs):
            return F.lit(False)
        if mad == 0:
            if zero_mad == "skip":
                return F.lit(False)
            mad = 1e-9
        z = F.lit(MAD_FACTOR) * (num(c) - F.lit(self.quantile[c][0.5])) / F.lit(mad)
        return flag(F.abs(z) > t)

    def percentile(self, c: str, *, min_obs: int = 0) -> Column:
        if self.too_few(c, min_obs):
            return F.lit(False)
        low, high = self.quantile[c][0.01], self.quantile[c][0.99]
        return flag((num(c) < F.lit(low)) | (num(c) > F.lit(high)))

    def adjusted_box(self, c: str, *, min_obs: int = 0) -> Column:
        q1, q3 = self.quantile[c][0.25], self.quantile[c][0.75]
        if self.too_few(c, min_obs) or q1 == q3:
            return F.lit(False)
        low, high = adjusted_fences(q1, q3, self.medcouple[c])
        return flag((num(c) < low) | (num(c) > high))


def adjusted_fences(q1: float, q3: float, mc: float) -> tuple[Column, Column]:
    """Tukey fences stretched on the side of the skew."""
    down, up = (-4.0, 3.0) if mc >= 0 else (-3.0, 4.0)
    reach = F.lit(IQR_FACTOR * (q3 - q1))
    return (
        F.lit(q1) - reach * F.exp(F.lit(down * mc)),
        F.lit(q3) + reach * F.exp(F.lit(up * mc)),
    )


def _add(
    df: DataFrame, features: Sequence[str], prefix: str, rule: Callable[[str], Column]
) -> DataFrame:
    return df.withColumns({prefix + c: rule(c) for c in features})


def flag_iqr(
    df: DataFrame,
    features: Sequence[str],
    k: float = IQR_FACTOR,
    *,
    min_obs: int = 0,
    skip_flat: bool = False,
    prefix: str = "iqr_",
) -> DataFrame:
    """Outside the quartiles by more than ``k`` times their distance."""
    p = Profile.fit(df, features)
    return _add(df, features, prefix, lambda c: p.iqr(c, k, min_obs=min_obs, skip_flat=skip_flat))


def flag_zscore(
    df: DataFrame, features: Sequence[str], t: float = 3.0, *,
    min_obs: int = MIN_OBSERVATIONS, prefix: str = "z_"
) -> DataFrame:
    """More than ``t`` population deviations from the mean."""
    row = df.agg(
        *[f(num(c)).alias(f"{f.__name__}{i}") for i, c in enumerate(features)
          for f in (F.count, F.avg, F.stddev_pop)]
    ).first()
    count, mean, std = ({c: row[3 * i + j] for i, c in enumerate(features)} for j in range(3))
    p = Profile(count, mean, std, {}, {}, {})
    return _add(df, features, prefix, lambda c: p.zscore(c, t, min_obs=min_obs))


def flag_mad(
    df: DataFrame,
    features: Sequence[str],
    t: float = MAD_ABOVE,
    *,
    min_obs: int = 0,
    zero_mad: str = "skip",
    prefix: str = "mad_",
) -> DataFrame:
    """Robust z-score from the median absolute deviation above ``t``."""
    p = Profile.fit(df, features, mad=True)
    return _add(
        df, features, prefix, lambda c: p.robust_z(c, t, min_obs=min_obs, zero_mad=zero_mad)
    )


def flag_percentile(
    df: DataFrame, features: Sequence[str], *,
    min_obs: int = MIN_OBSERVATIONS, prefix: str = "pct_"
) -> DataFrame:
    """Outside the 1st and 99th percentile."""
    p = Profile.fit(df, features, tails=True)
    return _add(df, features, prefix, lambda c: p.percentile(c, min_obs=min_obs))


def flag_adjusted_box(
    df: DataFrame, features: Sequence[str], *,
    min_obs: int = MIN_OBSERVATIONS, prefix: str = "adj_"
) -> DataFrame:
    """Outside skew-adjusted fences."""
    p = Profile.fit(df, features, medcouple=True)
    return _add(df, features, prefix, lambda c: p.adjusted_box(c, min_obs=min_obs))


def method_rules(p: Profile, c: str, min_obs: int = MIN_OBSERVATIONS) -> dict[str, Column]:
    """The six rules of one column by method name, in declared order."""
    rules = [
        p.iqr(c, 1.5, min_obs=min_obs, skip_flat=True),
        p.iqr(c, 3.0, min_obs=min_obs, skip_flat=True),
        p.zscore(c, min_obs=min_obs),
        p.robust_z(c, min_obs=min_obs),
        p.percentile(c, min_obs=min_obs),
        p.adjusted_box(c, min_obs=min_obs),
    ]
    return dict(zip(METHODS, rules, strict=True))


def iqr_table(df: DataFrame, features: Sequence[str], k: float = IQR_FACTOR) -> DataFrame:
    """Outlier count and percent of present values per variable, highest count first."""
    p = Profile.fit(df, features)
    wide = df.agg(*[F.count_if(p.iqr(c, k)).alias(f"n{i}") for i, c in enumerate(features)])
    return (
        long_form(
            wide,
            [],
            {
                c: {
                    "position": F.lit(i),
                    "n_outliers": F.col(f"n{i}"),
                    "pct": F.round(F.col(f"n{i}") / F.lit(p.count[c]) * 100, 2)
                    if p.count[c]
                    else F.lit(0.0),
                }
                for i, c in enumerate(features)
            },
        )
        .orderBy(F.desc("n_outliers"), "position")
        .drop("position")
    )


def row_any(df: DataFrame, flags: Sequence[str], name: str) -> DataFrame:
    """True where any of the flags is."""
    return df.withColumn(name, any_of([flag(col(f)) for f in flags]))


def flag_counts_by_variable(
    df: DataFrame, features: Sequence[str], prefixes: dict[str, str]
) -> DataFrame:
    """Number of flags per variable and method; ``prefixes`` maps method to column prefix."""
    methods = list(prefixes)
    wide = df.agg(
        *[
            F.count_if(flag(col(prefixes[m] + c))).alias(f"n{i}_{j}")
            for i, c in enumerate(features)
            for j, m in enumerate(methods)
        ]
    )
    return long_form(
        wide,
        [],
        {
            c: {m: F.col(f"n{i}_{j}") for j, m in enumerate(methods)}
            for i, c in enumerate(features)
        },
    )


def most_extreme(
    df: DataFrame, features: Sequence[str], scaler: Scaler | None = None
) -> DataFrame:
    """Add the variable with the largest |z| of each row (first on a tie), its value and z.

    The choice is a row-local maximum over an array, so nothing is shuffled.
    """
    scaler = scaler or Scaler.fit(df, features)
    entries = F.array(
        *[
            F.struct(
                F.coalesce(F.abs(scaler.scaled(c)), F.lit(-1.0)).alias("size"),
                F.lit(-i).alias("order"),
                F.lit(c).alias("variable"),
                num(c).alias("value"),
                scaler.scaled(c).alias("z"),
            )
            for i, c in enumerate(features)
        ]
    )
    return (
        df.withColumn("_top", F.array_max(entries))
        .withColumns(
            {
                "top_variable": F.col("_top.variable"),
                "top_value": F.round("_top.value", 3),
                "top_z": F.round("_top.z", 2),
            }
        )
        .drop("_top")
    )

