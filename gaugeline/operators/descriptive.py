"""Descriptive statistics, correlation, histograms, scaling and projection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import PCA, Bucketizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import aggregate_long, col, long_form, num
from ..functions.fixed_values import IQR_FACTOR
from ..functions.quantiles import exact_quantiles
from .missing import df_of_values
from .ranks import rank_correlation


def describe(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum per variable."""
    stats = aggregate_long(
        df,
        features,
        {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max},
    )
    quart = exact_quantiles(df, {c: num(c) for c in features}, [0.25, 0.5, 0.75])
    middle = df_of_values(df, {c: tuple(q) for c, q in quart.items()}, ["q1", "median", "q3"])
    return (
        stats.join(middle, "variable")
        .orderBy("position")
        .select("variable", "count", "mean", "std", "min", "q1", "median", "q3", "max")
    )


# --- correlation --------------------------------------------------------------


def corr_matrix(df: DataFrame, features: Sequence[str], method: str = "pearson") -> DataFrame:
    """Pairwise-complete correlation, long form ``var_a, var_b, corr``, one row per pair."""
    if method == "spearman":
        return rank_correlation(df, features)
    if method != "pearson":
        raise ValueError(f"unknown method {method!r}")
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    wide = df.agg(*[F.corr(num(a), num(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    entries = [
        F.struct(F.lit(a).alias("var_a"), F.lit(b).alias("var_b"), F.col(f"c{i}").alias("corr"))
        for i, (a, b) in enumerate(pairs)
    ]
    return wide.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def bucket_columns(
    df: DataFrame, features: Sequence[str], n_buckets: int = 256
) -> tuple[DataFrame, list[str]]:
    """Add a bucket number per feature; bucket edges are sketched quantiles, so sizes are even."""
    probs = [i / n_buckets for i in range(1, n_buckets)]
    row = df.agg(
        *[F.percentile_approx(num(c), probs, 10_000).alias(f"p{i}") for i, c in enumerate(features)]
    ).first()
    inf = float("inf")
    splits = []
    for edges in row:
        inner = sorted(set(edges or []))
        splits.append([-inf, *(inner or [0.0]), inf])
    work = df.withColumns({f"_x{i}": num(c) for i, c in enumerate(features)})
    names = [f"_b{i}" for i in range(len(features))]
    out = Bucketizer(
        splitsArray=splits,
        inputCols=[f"_x{i}" for i in range(len(features))],
        outputCols=names,
        handleInvalid="keep",
    ).transform(work)
    return out, names


# --- distribution -------------------------------------------------------------


def box_stats(df: DataFrame, features: Sequence[str], k: float = IQR_FACTOR) -> DataFrame:
    """Quartiles, whiskers (extreme data within the fences) and fliers of the z-scored variables."""
    quart = exact_quantiles(df, {c: num(c) for c in features}, [0.25, 0.5, 0.75])
    measures = {}
    for c, (q1, _, q3) in quart.items():
        low, high = _fences(q1, q3, k)
        measures[c] = (F.lit(low), F.lit(high))
    aggs = []
    for i, c in enumerate(features):
        x, (low, high) = num(c), measures[c]
        inside = (x >= low) & (x <= high)
        aggs += [
            F.avg(x).alias(f"mean{i}"),
            F.stddev_samp(x).alias(f"std{i}"),
            F.min(F.when(inside, x)).alias(f"lo{i}"),
            F.max(F.when(inside, x)).alias(f"hi{i}"),
            F.count_if(~inside).alias(f"n{i}"),
        ]
    wide = df.agg(*aggs)

    def z(i: int, value: Column) -> Column:
        return (value - F.col(f"mean{i}")) / F.nullif(F.col(f"std{i}"), F.lit(0.0))

    return long_form(
        wide,
        [],
        {
            c: {
                "z_q1": z(i, F.lit(quart[c][0])),
                "z_median": z(i, F.lit(quart[c][1])),
                "z_q3": z(i, F.lit(quart[c][2])),
                "z_whisker_low": z(i, F.col(f"lo{i}")),
                "z_whisker_high": z(i, F.col(f"hi{i}")),
                "n_fliers": F.col(f"n{i}"),
            }
            for i, c in enumerate(features)
        },
    )


def _fences(q1: float | None, q3: float | None, k: float) -> tuple[float | None, float | None]:
    if q1 is None or q3 is None:
        return None, None
    return q1 - k * (q3 - q1), q3 + k * (q3 - q1)


def z_scores(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Columns centred and divided by the sample deviation."""
    row = df.agg(
        *[a.alias(f"s{i}") for i, a in enumerate(
            [f(num(c)) for c in features for f in (F.avg, F.stddev_samp)])]
    ).first()
    return df.withColumns(
        {
            c: (num(c) - F.lit(row[2 * i])) / F.nullif(F.lit(row[2 * i + 1]).cast("double"), F.lit(0.0))
            for i, c in enumerate(features)
        }
    )


def histogram(df: DataFrame, features: Sequence[str], bins: int = 30) -> DataFrame:
    """Equal-width bins between minimum and maximum; the last bin includes the maximum."""
    row = df.agg(
        *[f(num(c)).alias(f"{f.__name__}{i}") for i, c in enumerate(features) for f in (F.min, F.max)]
    ).first()
    fields = {}
    for i, c in enumerate(features):
        low, high = row[2 * i], row[2 * i + 1]
        if low is None:
            continue
        width = (high - low) / bins
        x = num(c)
        if width == 0:
            place = F.when(x.isNotNull(), F.lit(0))
        else:
            # ``least`` skips NULL, so gaps are kept out explicitly.
            spot = F.floor((x - low) / F.lit(width)).cast("int")
            place = F.when(x.isNotNull(), F.least(spot, F.lit(bins - 1)))
        fields[c] = {"bin": place, "low": F.lit(low), "width": F.lit(width)}
    return (
        long_form(df, [], fields)
        .filter(F.col("bin").isNotNull())
        .groupBy("variable", "bin", "low", "width")
        .agg(F.count("*").alias("n"))
        .select(
            "variable",
            "bin",
            (F.col("low") + F.col("bin") * F.col("width")).alias("bin_low"),
            (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("bin_high"),
            "n",
        )
    )


def series_long(
    df: DataFrame, features: Sequence[str], date_col: str, keep: Sequence[str] = (), day: int | None = None
) -> DataFrame:
    """Long time series ``date, variable, value`` with per-row columns; ``day`` moves the date."""
    date = col(date_col)
    if day is not None:
        date = F.make_date(F.year(date), F.month(date), F.lit(day))
    return long_form(
        df.withColumn("_date", date), ["_date", *keep], {c: {"value": num(c)} for c in features}
    ).withColumnRenamed("_date", "date")


# --- scaling ------------------------------------------------------------------


@dataclass(frozen=True)
class Scaler:
    """Standardisation with the population deviation; a constant column is only centred."""

    features: list[str]
    means: list[float]
    stds: list[float]

    @staticmethod
    def fit(df: DataFrame, features: Sequence[str]) -> Scaler:
        row = df.agg(
            *[f(num(c)).alias(f"s{i}_{f.__name__}") for i, c in enumerate(features)
              for f in (F.avg, F.stddev_pop)]
        ).first()
        means = [row[2 * i] for i in range(len(features))]
        stds = [row[2 * i + 1] or 1.0 for i in range(len(features))]
        return Scaler(list(features), means, stds)

    def scaled(self, feature: str, value: Column | None = None) -> Column:
        i = self.features.index(feature)
        x = num(feature) if value is None else value
        return (x - F.lit(self.means[i]).cast("double")) / F.lit(self.stds[i])

    def unscaled(self, feature: str, value: Column | None = None) -> Column:
        i = self.features.index(feature)
        x = num(feature) if value is None else value
        return x * F.lit(self.stds[i]) + F.lit(self.means[i]).cast("double")

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.scaled(c) for c in self.features})

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.unscaled(c) for c in self.features})

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (i, c, m, s)
            for i, (c, m, s) in enumerate(zip(self.features, self.means, self.stds, strict=True))
        ]
        return spark.createDataFrame(rows, "position int, feature string, mean double, std double")

    def save(self, spark: SparkSession, path: str) -> None:
        self.table(spark).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Scaler:
        rows = spark.read.parquet(path).orderBy("position").collect()
        return Scaler([r.feature for r in rows], [r.mean for r in rows], [r.std for r in rows])


def standardize(
    df: DataFrame, features: Sequence[str], scaler: Scaler | None = None
) -> tuple[DataFrame, Scaler]:
    """Standardise with a fitted scaler, or fit one first."""
    scaler = scaler or Scaler.fit(df, features)
    return scaler.transform(df), scaler


def to_matrix(
    df: DataFrame, features: Sequence[str], keep: Sequence[str] = (), name: str = "x"
) -> DataFrame:
    """Standardised features as one ARRAY<DOUBLE> column next to the kept columns."""
    scaler = Scaler.fit(df, features)
    return df.select(
        *[col(c) for c in keep], F.array(*[scaler.scaled(c) for c in features]).alias(name)
    )


def pca_project(
    df: DataFrame, features: Sequence[str], keep: Sequence[str], k: int = 2
) -> tuple[DataFrame, list[float]]:
    """Principal components of the standardised features and their explained share.

    The sign of each component makes its largest loading positive.
    """
    vectors = to_matrix(df, features, keep).withColumn("x", array_to_vector("x"))
    model = PCA(k=k, inputCol="x", outputCol="pc").fit(vectors)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, j]).argmax(), j] > 0 else -1.0 for j in range(k)]
    parts = vector_to_array(F.col("pc"))
    out = model.transform(vectors).select(
        *[col(c) for c in keep],
        *[(F.get(parts, j) * signs[j]).alias(f"pc{j + 1}") for j in range(k)],
    )
    return out, [float(v) for v in model.explainedVariance.toArray()]

