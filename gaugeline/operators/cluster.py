"""K-means, its quality measures and cluster descriptions.

The silhouette uses Euclidean distances to all other rows, which has no closed form. Rows meet
block by block and only the distance sum of each row to each cluster leaves a block pair, for
all labelings at once. ``method="squared"`` is the squared-Euclidean variant, one aggregate
and one row-local pass, for tables where the quadratic work of the exact one is too much.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col, num, total
from ..functions.fixed_values import SEED
from ..functions.session import keep
from . import kmeans
from .descriptive import to_matrix
from .panel import complete_cases

BLOCK = 8_192
#: Blocks at most, until a block would hold more rows than ``WIDEST``: each row is sent to a task once per block.
BLOCKS, WIDEST = 20, 2**20
#: Columns of distances held at once, ``TILE_ROWS`` rows of them: a tile stays in a core's cache.
TILE, TILE_ROWS = 2_048, 64


@dataclass(frozen=True)
class Clustering:
    """Labelled rows, centroids in label order and within-cluster sum of squares."""

    table: DataFrame
    centroids: list[list[float]]
    wcss: float
    features: list[str]

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the centroids as a table ``cluster, position, variable, value``."""
        rows = [
            (i, j, c, float(v)) for i, centre in enumerate(self.centroids)
            for j, (c, v) in enumerate(zip(self.features, centre, strict=True))
        ]
        schema = "cluster int, position int, variable string, value double"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)


def load_centroids(spark: SparkSession, path: str) -> tuple[list[str], list[list[float]]]:
    """Features and centroids of a saved clustering, for :func:`kmeans.assign`."""
    rows = spark.read.parquet(path).orderBy("cluster", "position").collect()
    features = [r.variable for r in rows if r.cluster == 0]
    return features, [[r.value for r in rows if r.cluster == i] for i in sorted({r.cluster for r in rows})]


def kmeans_fit(
    df: DataFrame, features: Sequence[str], k: int, *, seed: int = SEED, label: str = "cluster"
) -> Clustering:
    """Fit k-means on (standardised, complete) features; labels follow the centroid order.

    Equal rows give equal centroids and labels however they are partitioned. Rows with a missing feature get no label.
    """
    centres, cost = kmeans.fit_all(df, features, [k], seed=seed)[k]
    return Clustering(kmeans.assign(df, features, {label: centres}), centres, cost, list(features))


def silhouettes(
    df: DataFrame,
    features: Sequence[str],
    labels: Sequence[str],
    *,
    method: str = "exact",
    block: int = BLOCK,
) -> dict[str, float | None]:
    """Mean silhouette of each label column (``None`` below two clusters).

    Distances do not change when all rows are shifted, so the variables are centred first: far from the origin, squares
    would swallow the differences.
    """
    means = df.agg(*[F.avg(num(f)).alias(f"m{i}") for i, f in enumerate(features)]).first()
    df = df.withColumns({f: num(f) - F.lit(m) for f, m in zip(features, means, strict=True)})
    sizes = _cluster_sizes(df, labels)
    usable = [c for c in labels if len(sizes[c]) >= 2]
    if not usable:
        return dict.fromkeys(labels)
    if method == "exact":
        found = _exact(df, features, usable, sizes, block)
    elif method == "squared":
        found = {c: _squared(df, features, c, sizes[c]) for c in usable}
    else:
        raise ValueError(f"unknown method {method!r}")
    return {c: found.get(c) for c in labels}


def silhouette(df: DataFrame, features: Sequence[str], label: str, *, method: str = "exact") -> DataFrame:
    """One row with the mean silhouette of a labelling."""
    value = silhouettes(df, features, [label], method=method)[label]
    return df.sparkSession.createDataFrame([(value,)], "silhouette double")


def _cluster_sizes(df: DataFrame, labels: Sequence[str]) -> dict[str, dict[int, int]]:
    """Rows of every cluster of every label, in the clusters' order; labels of one type are counted in one job."""
    kinds = {c: df.select(col(c)).schema[0].dataType for c in labels}
    sizes: dict[str, dict[int, int]] = {c: {} for c in labels}
    for kind in dict.fromkeys(kinds.values()):
        alike = [c for c in labels if kinds[c] == kind]
        marks = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), col(c).alias("v")) for i, c in enumerate(alike)]))
        counts = df.select(marks.alias("m")).groupBy("m.i", "m.v").agg(F.count("*").alias("n"))
        for r in counts.orderBy("i", "v").collect():
            sizes[alike[r.i]][r.v] = r.n
    return sizes


def _width(own: Column, sums: list[Column], sizes: list[int]) -> Column:
    """Silhouette of a row from its cluster position and its distance sum to every cluster."""
    mean_other = F.array(*[s / n for s, n in zip(sums, sizes, strict=True)])
    size = F.get(F.array(*[F.lit(n) for n in sizes]), own)
    inside = F.get(F.array(*sums), own) / (size - 1)
    spots = F.array(*[F.lit(i) for i in range(len(sizes))])
    other = F.array_min(
        F.array_compact(
            F.zip_with(mean_other, spots, lambda m, i: F.when(i != own, m))
        )
    )
    wide = F.greatest(inside, other)
    return F.when(size == 1, 0.0).when(wide == 0, 0.0).otherwise((other - inside) / wide)


def _exact(
    df: DataFrame,
    features: Sequence[str],
    labels: Sequence[str],
    sizes: dict[str, dict[int, int]],
    block: int,
) -> dict[str, float]:
    spots = {c: {v: i for i, v in enumerate(sizes[c])} for c in labels}
    xs, ls = [f"x{i}" for i in range(len(features))], [f"l{i}" for i in range(len(labels))]
    # Identical rows enter once with a weight.
    points = keep(
        df.select(
            *[num(f).alias(x) for f, x in zip(features, xs, strict=True)],
            *[
                F.element_at(
                    F.create_map(*[F.lit(y) for pair in spots[c].items() for y in pair]), col(c)
                ).alias(lb)
                for c, lb in zip(labels, ls, strict=True)
            ],
        )
        .groupBy(*xs, *ls)
        .agg(F.count("*").cast("double").alias("w"))
        .withColumn("id", F.xxhash64(*xs, *ls))
    )
    n_blocks = _blocks(points.count(), block)
    widths = [len(sizes[c]) for c in labels]
    starts = np.cumsum([0, *widths])
    placed = points.withColumn("b", F.pmod("id", F.lit(n_blocks)).cast("int"))
    row = ["id", "w", *xs, *ls]
    # Distances are symmetric: a block meets itself and the blocks after it, and the meeting
    # serves both sides.
    later, sooner = F.sequence("b", F.lit(n_blocks - 1)), F.sequence(F.lit(0), F.col("b"))
    left = placed.select(F.col("b").alias("bi"), F.explode(later).alias("bj"), *row)
    right = placed.select(
        F.explode(sooner).alias("bi"), F.col("b").alias("bj"), *[F.col(c).alias(c) for c in row]
    )
    sums = [f"s{i}" for i in range(int(starts[-1]))]

    def membership(b: pd.DataFrame) -> np.ndarray:
        """Row weights spread over the clusters of every labelling."""
        member = np.zeros((len(b), int(starts[-1])))
        for i, lb in enumerate(ls):
            member[np.arange(len(b)), starts[i] + b[lb].to_numpy()] = b.w
        return member

    def block_sums(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame(columns=["id", *sums])
        same = bool(a.bi.iloc[0] == a.bj.iloc[0])
        x, y = a[xs].to_numpy(), b[xs].to_numpy()
        to_a, to_b = _distance_sums(x, y, membership(a), membership(b), same)
        parts = [(a, to_a)] if same else [(a, to_a), (b, to_b)]
        frames = []
        for side, values in parts:
            frame = pd.DataFrame(values, columns=sums)
            frame.insert(0, "id", side["id"].to_numpy())
            frames.append(frame)
        return pd.concat(frames, ignore_index=True)

    keys = ["bi", "bj"]
    partitions = max(
        int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(n_blocks**2, 8192)
    )
    # Only per-cluster sums leave a block pair; they add up per row.
    merged = (
        left.repartition(partitions, *keys)
        .groupBy(*keys)
        .cogroup(right.repartition(partitions, *keys).groupBy(*keys))
        .applyInPandas(block_sums, "id bigint, " + ", ".join(f"{s} double" for s in sums))
        .groupBy("id")
        .agg(*[F.sum(s).alias(s) for s in sums])
    )
    scores = points.select("id", "w", *ls).join(merged, "id")
    row = scores.agg(
        *[
            (
                F.sum(
                    F.col("w")
                    * _width(
                        F.col(ls[i]),
                        [F.col(s) for s in sums[starts[i] : starts[i + 1]]],
                        list(sizes[c].values()),
                    )
                )
                / F.sum("w")
            ).alias(f"v{i}")
            for i, c in enumerate(labels)
        ]
    ).first()
    points.unpersist()
    return dict(zip(labels, row, strict=True))


def _blocks(n: int, block: int) -> int:
    """Number of blocks: a large table gets larger blocks rather than more of them, since its rows are copied once per block."""
    return max(1, min(math.ceil(n / block), max(BLOCKS, math.ceil(n / WIDEST))))


def _distance_sums(x: np.ndarray, y: np.ndarray, of_x: np.ndarray, of_y: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the distances from each row of one side to the other side's rows, weighted by its columns; tiles are of fixed size.

    A row has its weight in the columns it belongs to. Rows of the same columns lie together, so that a distance is added up
    once for all its columns on either side.
    """
    (x, of_x, group_x, to_row), (y, of_y, group_y, to_column) = _grouped(x, of_x), _grouped(y, of_y)
    x2, y2, wx, wy = (x * x).sum(axis=1), (y * y).sum(axis=1), of_x.max(axis=1), of_y.max(axis=1)
    # One product gives the squared distances: x2 - 2xy + y2.
    left, right = np.column_stack([-2 * x, x2, np.ones(len(x))]), np.column_stack([y, np.ones(len(y)), y2])
    tiles = []
    for lo in range(0, len(y), TILE):
        cols = slice(lo, min(lo + TILE, len(y)))
        starts, member, weights = _runs(group_y[cols]), of_y[cols], None
        if 4 * len(starts) <= len(member):
            member, weights = member[starts] > 0, wy[cols]
        else:
            starts = None
        weights = None if weights is None or (weights == 1).all() else weights
        tiles.append((cols, np.ascontiguousarray(right[cols].T), y2[cols].max(), weights, starts, member.astype(float)))
    to_x, to_y = np.zeros_like(of_x), np.zeros(of_y.shape[::-1])
    for at in range(0, len(x), TILE_ROWS):
        rows = slice(at, at + TILE_ROWS)
        farthest, runs = x2[rows].max(), _runs(group_x[rows])
        spans = [slice(*ends) for ends in zip(runs, np.append(runs[1:], len(x2[rows])), strict=True)]
        to_run = np.empty((0 if same else len(spans), len(y)))
        for cols, other, largest, weights, starts, member in tiles:
            d = left[rows] @ other
            # Of close points the product keeps too few digits; there, differences are taken.
            if d.min() <= 1e-6 * (farthest + largest):
                p, q = np.nonzero(d <= 1e-6 * (x2[rows, None] + y2[cols]))
                for first in range(0, len(p), 65_536):
                    i, j = p[first : first + 65_536], q[first : first + 65_536]
                    d[i, j] = ((x[rows][i] - y[cols][j]) ** 2).sum(axis=1)
            np.sqrt(d, out=d)
            for sums, span in zip(to_run, spans, strict=False):
                sums[cols] = wx[rows][span] @ d[span]
            if weights is not None:
                d *= weights
            to_x[rows] += (d if starts is None else np.add.reduceat(d, starts, axis=1)) @ member
        for sums, first in zip(to_run, runs, strict=False):
            to_y[of_x[at + first] > 0] += sums
    out_x, out_y = np.empty_like(to_x), np.empty_like(to_y.T)
    out_x[to_row], out_y[to_column] = to_x, to_y.T
    return out_x, out_y


def _grouped(x: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Points, memberships, numbers of the sets of columns and places before, with rows of equal sets together by their norms."""
    group = np.unique(np.packbits(member > 0, axis=1), axis=0, return_inverse=True)[1].ravel()
    order = np.lexsort(((x * x).sum(axis=1), group))
    return x[order], member[order], group[order], order


def _runs(group: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers start."""
    return np.flatnonzero(np.append(True, group[1:] != group[:-1]))


def _squared(df: DataFrame, features: Sequence[str], label: str, sizes: dict[int, int]) -> float:
    """Squared distances sum in closed form from each cluster's size, mean and mean square."""
    norm = total([num(c) * num(c) for c in features])
    stats = {
        r[0]: r[1:]
        for r in df.groupBy(col(label))
        .agg(F.avg(norm), *[F.avg(num(c)) for c in features])
        .collect()
    }
    values = list(sizes)
    own = F.element_at(
        F.create_map(*[F.lit(y) for i, v in enumerate(values) for y in (v, i)]), col(label)
    )
    sums = []
    for v in values:
        square, *mean = stats[v]
        cross = total([num(c) * F.lit(m) for c, m in zip(features, mean, strict=True)])
        sums.append((norm - 2 * cross + F.lit(square)) * sizes[v])
    return df.agg(F.avg(_width(own, sums, list(sizes.values())))).first()[0]


def sweep_k(
    df: DataFrame,
    features: Sequence[str],
    k_range: Sequence[int] = range(2, 11),
    *,
    seed: int = SEED,
    method: str = "exact",
) -> DataFrame:
    """``k, wcss, silhouette`` for each k; the rows are read once and all labelings share one
    pairwise pass."""
    rows = keep(df.select(*[num(c).alias(f"f{i}") for i, c in enumerate(features)]))
    names = [f"f{i}" for i in range(len(features))]
    fits = kmeans.fit_all(rows, names, list(k_range), seed=seed)
    costs = {k: cost for k, (_, cost) in fits.items()}
    labelled = keep(kmeans.assign(rows, names, {f"k{k}": centres for k, (centres, _) in fits.items()}))
    scores = silhouettes(labelled, names, [f"k{k}" for k in k_range], method=method)
    labelled.unpersist()
    rows.unpersist()
    table = [(k, costs[k], scores[f"k{k}"]) for k in k_range]
    return df.sparkSession.createDataFrame(table, "k int, wcss double, silhouette double")


def best_by_silhouette(sweep: DataFrame) -> int:
    """k with the highest silhouette, the smallest k on a tie."""
    return sweep.orderBy(F.desc_nulls_last("silhouette"), "k").first()["k"]


def elbow(sweep: DataFrame) -> DataFrame:
    """Row of the k farthest from the line between the first and the last point of the curve."""
    ends = sweep.agg(
        F.min("k").alias("k0"), F.max("k").alias("k1"),
        F.min_by("wcss", "k").alias("w0"), F.max_by("wcss", "k").alias("w1"),
    ).first()
    run, rise = float(ends.k1 - ends.k0), ends.w1 - ends.w0
    gap = F.abs(F.lit(rise) * (F.col("k") - ends.k0) - F.lit(run) * (F.col("wcss") - ends.w0))
    distance = gap / math.hypot(run, rise)
    return sweep.select("k", distance.alias("distance")).orderBy(F.desc("distance"), "k").limit(1)


def wcss(
    df: DataFrame, features: Sequence[str], label: str, centroids: Sequence[Sequence[float]]
) -> DataFrame:
    """Within-cluster sum of squares for labels 0..k-1 and their centroids."""
    parts = []
    for i, c in enumerate(features):
        centre = F.get(F.array(*[F.lit(float(m[i])) for m in centroids]), col(label))
        parts.append((num(c) - centre) * (num(c) - centre))
    return df.agg(F.coalesce(F.sum(total(parts)), F.lit(0.0)).alias("wcss"))


def cluster_profile(df: DataFrame, features: Sequence[str], label: str = "cluster") -> DataFrame:
    """Mean of every variable per cluster (two decimals) and the cluster size."""
    return df.groupBy(col(label)).agg(
        *[F.round(F.avg(num(c)), 2).alias(c) for c in features], F.count("*").alias("n")
    )


def cluster_by_season(df: DataFrame, label: str = "cluster", season: str = "season") -> DataFrame:
    """Rows and share of each season within each cluster."""
    counts = df.groupBy(col(label), col(season)).agg(F.count("*").alias("n"))
    sizes = counts.groupBy(col(label)).agg(F.sum("n").alias("_size"))
    return counts.join(sizes, label).select(
        label, season, "n", (F.col("n") / F.col("_size")).alias("share")
    )


def scatter_data(df: DataFrame, x: str, y: str, mark: str, keep_cols: Sequence[str] = ()) -> DataFrame:
    """Two variables and a category per row."""
    return df.select(*[col(c) for c in keep_cols], num(x).alias("x"), num(y).alias("y"),
                     col(mark).alias("mark"))


def imputation_cluster_impact(
    before: DataFrame,
    after: DataFrame,
    features: Sequence[str],
    k_range: Sequence[int] = range(2, 7),
    *,
    seed: int = SEED,
    method: str = "exact",
) -> DataFrame:
    """Best silhouette on complete rows before and on all rows after imputation.

    ``set, n, best_k, silhouette``; too few rows give NULL and -1.
    """
    present = set(after.columns)
    cols = [c for c in features if c in present]
    out = []
    for name, frame in (("complete-case", before), ("imputed", after)):
        rows = complete_cases(frame, cols)
        n = rows.count()
        if n <= max(k_range):
            out.append((name, n, -1, None))
            continue
        matrix = to_matrix(rows, cols)
        wide = keep(matrix.select(*[F.get("x", i).alias(f"f{i}") for i in range(len(cols))]))
        sweep = sweep_k(wide, wide.columns, k_range, seed=seed, method=method)
        best = sweep.orderBy(F.desc_nulls_last("silhouette"), "k").first()
        out.append((name, n, best.k, None if best.silhouette is None else round(best.silhouette, 4)))
        wide.unpersist()
    schema = "`set` string, n bigint, best_k int, silhouette double"
    return before.sparkSession.createDataFrame(out, schema)
