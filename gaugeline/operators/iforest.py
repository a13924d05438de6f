"""Isolation forest: sampled and grown per tree on the cluster, scored in Arrow batches.

A tree needs at most 256 rows. Rows draw their trees by a seeded hash of their key, so samples do
not depend on partitioning, only a bounded surplus per tree is shuffled, and the grown forest
(trees x 511 nodes at most) is small enough to travel inside the scoring function.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import all_of, col, num, total
from ..functions.fixed_values import (
    CONTAMINATION,
    CONTAMINATION_GRID,
    CV_FOLDS,
    FOREST_SAMPLE,
    FOREST_TREES,
    SEED,
)
from ..functions.quantiles import exact_quantiles
from ..functions.session import keep

NODE_SCHEMA = "tree int, node int, feature int, cut double, below int, above int, path double"
_SPACE = 1 << 31
#: Rows that go down the trees together: what a step holds of them stays in a core's cache.
SLICE = 8_192


def expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    deep = 2 * (np.log(big - 1) + np.euler_gamma) - 2 * (big - 1) / big
    return np.where(n > 2, deep, np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """Nodes ``(node, feature, cut, below, above, path)`` of one random tree."""
    limit = math.ceil(math.log2(max(2, len(x))))
    nodes: list[list] = [[-1, 0.0, -1, -1, 0.0]]
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        at, rows, depth = todo.pop()
        part = x[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        open_axes = np.flatnonzero(high > low)
        if depth >= limit or len(rows) < 2 or not len(open_axes):
            nodes[at][4] = depth + float(expected_path(len(rows)))
            continue
        axis = int(rng.choice(open_axes))
        cut = float(rng.uniform(low[axis], high[axis]))
        goes = part[:, axis] <= cut
        below, above = len(nodes), len(nodes) + 1
        nodes += [[-1, 0.0, -1, -1, 0.0], [-1, 0.0, -1, -1, 0.0]]
        nodes[at][:4] = [axis, cut, below, above]
        todo += [(below, rows[goes], depth + 1), (above, rows[~goes], depth + 1)]
    return [(i, *n) for i, n in enumerate(nodes)]


def mean_path(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, path: np.ndarray) -> np.ndarray:
    """Mean path of every row over the filled trees of :meth:`IsolationForestModel.arrays`."""
    n, dims = x.shape
    flat, rows = np.ascontiguousarray(x).ravel(), np.arange(n) * dims
    at, spot, value, edge, low = np.empty(n, np.intp), np.empty(n, np.intp), np.empty(n), np.empty(n), np.empty(n, bool)
    out, inner = np.zeros(n), feature.shape[1]
    for f, c, ends in zip(feature, cut, path, strict=True):
        at[:] = 0
        for _ in range(int(math.log2(inner + 1))):
            # Places are in range; "clip" only spares the check.
            np.take(f, at, out=spot, mode="clip")
            np.add(spot, rows, out=spot)
            np.take(flat, spot, out=value, mode="clip")
            np.take(c, at, out=edge, mode="clip")
            np.less_equal(value, edge, out=low)
            np.add(at, 1, out=at)
            np.multiply(at, 2, out=at)
            np.subtract(at, low, out=at, casting="unsafe")
        np.subtract(at, inner, out=at)
        out += ends[at]
    return out / len(feature)


@dataclass(frozen=True)
class IsolationForestModel:
    features: list[str]
    sample_size: int
    nodes: pd.DataFrame

    def arrays(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature and cut of the inner nodes and path of the leaves, one line a tree, every tree filled up to ``depth``.

        The children of node i are 2i + 1 and 2i + 2; below a leaf all nodes lead to its path.
        """
        trees = [t.sort_values("node") for _, t in self.nodes.groupby("tree")]
        feature = np.zeros((len(trees), 2**depth - 1), np.intp)
        cut, path = np.zeros(feature.shape), np.zeros((len(trees), 2**depth))
        for t, nodes in enumerate(trees):
            of, at, below, above, ends = (nodes[c].to_numpy() for c in ("feature", "cut", "below", "above", "path"))
            here = np.zeros(1, np.intp)
            for level in range(depth):
                line, inner = slice(2**level - 1, 2 ** (level + 1) - 1), of[here] >= 0
                feature[t, line] = np.maximum(of[here], 0)
                cut[t, line] = at[here]
                here = np.stack([np.where(inner, below[here], here), np.where(inner, above[here], here)], axis=1).ravel().astype(np.intp)
            path[t] = ends[here]
        return feature, cut, path

    def save(self, spark: SparkSession, path: str) -> None:
        table = spark.createDataFrame(self.nodes, NODE_SCHEMA)
        table.withColumns(
            {"sample_size": F.lit(self.sample_size), "features": F.array(*map(F.lit, self.features))}
        ).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> IsolationForestModel:
        stored = spark.read.parquet(path)
        head = stored.select("sample_size", "features").first()
        nodes = stored.drop("sample_size", "features").toPandas()
        return IsolationForestModel(list(head.features), head.sample_size, nodes)

    def score(self, df: DataFrame, name: str = "iforest_score") -> DataFrame:
        """Add the anomaly score in (0, 1]; works on streaming DataFrames too."""
        return df.withColumn(name, F.get(score_columns([self]), 0))


def score_columns(models: Sequence[IsolationForestModel]) -> Column:
    """Scores of all models (same features) as one ARRAY<DOUBLE> column."""
    depth = math.ceil(math.log2(max(2, max(m.sample_size for m in models))))
    packed = [(m.arrays(depth), float(expected_path(m.sample_size))) for m in models]

    @F.pandas_udf("array<double>")
    def scores(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for series in batches:
            # A single feature arrives as a bare series.
            columns = (series,) if isinstance(series, pd.Series) else series
            x = np.column_stack([s.to_numpy(float) for s in columns])
            result = np.empty((len(x), len(packed)))
            for lo in range(0, len(x), SLICE):
                part = x[lo : lo + SLICE]
                for j, (trees, norm) in enumerate(packed):
                    mean = mean_path(part, *trees)
                    result[lo : lo + SLICE, j] = np.power(2.0, -mean / norm) if norm > 0 else 0.5
            yield pd.Series(list(result))

    # A row with a gap lies on no side of a cut, so it has no score.
    whole = F.lit(True)
    for c in models[0].features:
        whole = whole & num(c).isNotNull()
    return F.when(whole, scores(*[num(c) for c in models[0].features]))


@dataclass(frozen=True)
class IsolationForest:
    n_trees: int = FOREST_TREES
    max_samples: int = FOREST_SAMPLE
    seed: int = SEED

    def fit(self, df: DataFrame, id_cols: Sequence[str], features: Sequence[str]) -> IsolationForestModel:
        return self.fit_many(df, id_cols, features, [F.lit(True)])[0]

    def fit_many(
        self, df: DataFrame, id_cols: Sequence[str], features: Sequence[str], masks: Sequence[Column]
    ) -> list[IsolationForestModel]:
        """One forest per mask (the rows it may learn from), all grown in one job."""
        names = [f"x{i}" for i in range(len(features))]
        counts = df.agg(*[F.count_if(m).alias(f"n{i}") for i, m in enumerate(masks)]).first()
        sizes = [min(self.max_samples, n) for n in counts]
        # A surplus of eight deviations makes every tree full; row numbers trim it.
        shares = [
            min(1.0, (s + 8 * math.sqrt(s) + 16) / max(n, 1)) for s, n in zip(sizes, counts, strict=True)
        ]
        trees, count = self.n_trees, len(masks)
        # Rows that join no tree leave before anything is expanded.
        gate = min(1.0, 2 * sum(shares) * trees)
        rows = df.select(
            F.xxhash64(*[col(c) for c in id_cols], F.lit(self.seed)).alias("key"),
            F.array(*[F.coalesce(m, F.lit(False)) for m in masks]).alias("allowed"),
            *[num(c).alias(x) for c, x in zip(features, names, strict=True)],
        )
        rows = rows.filter(
            all_of([F.col(x).isNotNull() for x in names])
            & (F.pmod(F.xxhash64("key"), F.lit(_SPACE)) < math.ceil(gate * _SPACE))
        )
        limits = F.array(*[F.lit(math.ceil(min(1.0, s / gate) * _SPACE)) for s in shares])
        draws = F.transform(
            F.sequence(F.lit(0), F.lit(count * trees - 1)),
            lambda t: F.struct(
                t.alias("tree"), F.pmod(F.xxhash64(F.col("key"), t), F.lit(_SPACE)).alias("draw")
            ),
        )

        def joins(s: Column) -> Column:
            model = F.floor(s["tree"] / trees).cast("int")
            return (s["draw"] < F.get(limits, model)) & F.get(F.col("allowed"), model)

        order = Window.partitionBy("tree").orderBy("draw", "key")
        size_of = F.get(F.array(*[F.lit(s) for s in sizes]), F.floor(F.col("tree") / trees).cast("int"))
        sampled = (
            rows.select("key", *names, F.explode(F.filter(draws, joins)).alias("d"))
            .select("key", "d.tree", "d.draw", *names)
            .withColumn("place", F.row_number().over(order))
            .filter(F.col("place") <= size_of)
        )
        seed = self.seed

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("place")
            tree = int(pdf.tree.iloc[0])
            nodes = grow(pdf[names].to_numpy(float), np.random.default_rng([seed, tree]))
            out = pd.DataFrame(nodes, columns=["node", "feature", "cut", "below", "above", "path"])
            out.insert(0, "tree", tree)
            return out

        grown = sampled.groupBy("tree").applyInPandas(build, NODE_SCHEMA).toPandas()
        return [
            IsolationForestModel(list(features), sizes[i], grown[grown.tree // trees == i])
            for i in range(count)
        ]


@dataclass(frozen=True)
class Detection:
    """Rows with ``anomaly`` and ``anomaly_score`` (negative = anomalous), share and model."""

    table: DataFrame
    rate: float
    model: IsolationForestModel


def detect_anomalies(
    df: DataFrame,
    id_cols: Sequence[str],
    features: Sequence[str],
    contamination: float = CONTAMINATION,
    *,
    forest: IsolationForest | None = None,
    flag_name: str = "anomaly",
    score_name: str = "anomaly_score",
) -> Detection:
    """Fit, score and cut at the exact contamination quantile."""
    model = (forest or IsolationForest()).fit(df, id_cols, features)
    scored = keep(model.score(df, "_raw"))
    cut = exact_quantiles(scored, {"s": -F.col("_raw")}, [contamination])["s"][0]
    shifted = -F.col("_raw") - F.lit(cut)
    out = scored.withColumns({score_name: shifted, flag_name: shifted < 0}).drop("_raw")
    flagged, n = out.agg(F.count_if(col(flag_name)), F.count("*")).first()
    return Detection(out, round(flagged / n, 4) if n else 0.0, model)


def anomaly_details(
    table: DataFrame,
    original: DataFrame,
    id_cols: Sequence[str],
    features: Sequence[str],
    *,
    flag_name: str = "anomaly",
    score_name: str = "anomaly_score",
) -> DataFrame:
    """Flagged rows with their ids, original values and score, most anomalous first."""
    marked = table.filter(col(flag_name)).select(*[col(c) for c in id_cols], col(score_name))
    return (
        original.select(*[col(c) for c in (*id_cols, *features)])
        .join(marked, list(id_cols))
        .orderBy(col(score_name), *[col(c) for c in id_cols])
    )


def calibrate_contamination(
    df: DataFrame,
    id_cols: Sequence[str],
    features: Sequence[str],
    grid: Sequence[float] = CONTAMINATION_GRID,
    *,
    folds: int = CV_FOLDS,
    forest: IsolationForest | None = None,
) -> DataFrame:
    """Agreement of forests fitted without one fold each, per contamination, best first.

    ``contamination, n_flags, rate, stability_jaccard``. All forests grow in one job, all score
    in one pass, and each grid value only moves the cut taken from the fold's training rows.
    """
    forest = forest or IsolationForest()
    fold = F.pmod(F.xxhash64(*[col(c) for c in id_cols], F.lit(forest.seed + 1)), F.lit(folds))
    rows = keep(df.select(*[col(c) for c in (*id_cols, *features)], fold.alias("_fold")))
    masks = [F.lit(True), *[F.col("_fold") != f for f in range(folds)]]
    models = forest.fit_many(rows, id_cols, features, masks)
    scored = keep(rows.select("_fold", score_columns(models).alias("_s")))
    scores = {i: -F.get(F.col("_s"), i) for i in range(folds + 1)}
    cuts = exact_quantiles(
        scored, {str(i): F.when(masks[i], s) for i, s in scores.items()}, list(grid)
    )
    # Rows marked alike are counted first: the pairs of forests are looked at once per kind of row.
    bits = {(i, g): (f"m{i}_{g // 32}", 1 << g % 32) for i in scores for g in range(len(grid))}
    kinds = {
        name: total([F.when(scores[i] < F.lit(cuts[str(i)][g]), F.lit(bit)).otherwise(0) for (i, g), (m, bit) in bits.items() if m == name])
        for name in dict.fromkeys(m for m, _ in bits.values())
    }
    marked = scored.select(*[c.cast("bigint").alias(m) for m, c in kinds.items()]).groupBy(*kinds).agg(F.count("*").alias("n"))

    def rows_where(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    aggs = []
    for g in range(len(grid)):
        marks = {i: F.col(bits[i, g][0]).bitwiseAND(F.lit(bits[i, g][1])) != 0 for i in scores}
        aggs.append(rows_where(marks[0]).alias(f"n{g}"))
        for i in range(1, folds + 1):
            for j in range(i + 1, folds + 1):
                aggs.append(rows_where(marks[i] & marks[j]).alias(f"b{g}_{i}_{j}"))
                aggs.append(rows_where(marks[i] | marks[j]).alias(f"u{g}_{i}_{j}"))
    row = marked.agg(rows_where(F.lit(True)).alias("n"), *aggs).first()
    table = []
    for g, c in enumerate(grid):
        shares = [
            row[f"b{g}_{i}_{j}"] / row[f"u{g}_{i}_{j}"] if row[f"u{g}_{i}_{j}"] else 1.0
            for i in range(1, folds + 1)
            for j in range(i + 1, folds + 1)
        ]
        stability = round(float(np.mean(shares)), 4) if shares else None
        table.append((float(c), row[f"n{g}"], round(row[f"n{g}"] / row["n"], 4), stability))
    scored.unpersist()
    rows.unpersist()
    schema = "contamination double, n_flags bigint, rate double, stability_jaccard double"
    return df.sparkSession.createDataFrame(table, schema).orderBy(
        F.desc("stability_jaccard"), "contamination"
    )
