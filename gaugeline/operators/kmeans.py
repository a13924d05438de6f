"""K-means whose result does not depend on how rows are dealt to partitions.

Seeds come from a coreset: the distinct rows whose hashes are least, with their numbers of copies. Which rows these are
follows from the rows alone. Several weighted k-means++ starts run on this bounded sample; the cheapest one starts rounds
over all rows. A round is one pass for every k at once; sums are kept in whole numbers, which add up alike in any order,
and only k x p sums leave it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.columns import all_of, num
from ..functions.fixed_values import SEED
#: Distinct rows of the coreset.
CORESET = 4_096
#: Starts tried on the coreset for each k.
STARTS = 5
MAX_ROUNDS = 100
#: Rounds end when no centre moves farther.
TOLERANCE = 1e-4
#: Bits of a value in the whole-number sums, and of their lower limb.
BITS, LIMB = 45, 22
#: Distances held at once in a task.
SLICE = 2**21
#: Rows of a packed block at most, and tasks of a round for each core.
PACKED, TASKS_PER_CORE = 65_536, 2


def complete(features: Sequence[str]) -> Column:
    """True where every feature is a finite number; other rows take no part and get no label."""
    return all_of([F.coalesce(F.abs(num(c)) < float("inf"), F.lit(False)) for c in features])


def coreset(df: DataFrame, features: Sequence[str], *, size: int = CORESET, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, float]:
    """Points and copies of at most ``size`` distinct complete rows, the least by hash; and the largest absolute value."""
    names = [f"_x{i}" for i in range(len(features))]
    # Adding zero makes -0 and 0 one value.
    rows = df.filter(complete(features)).select(*[(num(c) + F.lit(0.0)).alias(x) for c, x in zip(features, names, strict=True)])
    rows = rows.withColumn("_h", F.xxhash64(F.lit(seed), *names))
    seen = rows.agg(F.approx_count_distinct("_h").alias("d"), *[F.max(F.abs(F.col(x))).alias(x) for x in names]).first()
    if not seen.d:
        return np.zeros((0, len(features))), np.zeros(0), 0.0
    # The share leaves twice the wanted number, so few rows besides are grouped.
    below = int(min(1.0, 2.0 * size / seen.d) * 2**64) - 2**63
    least = (
        rows.filter(F.col("_h") <= F.lit(min(below, 2**63 - 1)))
        .groupBy("_h", *names).agg(F.count(F.lit(1)).alias("_n")).orderBy("_h", *names).limit(size).toPandas()
    )
    return least[names].to_numpy(float), least["_n"].to_numpy(float), max(seen[x] for x in names)


def _gaps(columns: list[np.ndarray], centres: np.ndarray) -> np.ndarray:
    """Squared distances, centres by rows, added up feature by feature so that a row's are the same in any batch."""
    out = np.zeros((len(centres), len(columns[0])))
    for f, x in enumerate(columns):
        d = x[None, :] - centres[:, f][:, None]
        out += d * d
    return out


def _start(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> tuple[float, np.ndarray]:
    """One weighted k-means++ start, refined on the coreset."""
    chosen = [int(rng.choice(len(points), p=weights / weights.sum()))]
    near = ((points - points[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(k, len(points)):
        share = weights * near
        if share.sum() <= 0:
            break
        chosen.append(int(rng.choice(len(points), p=share / share.sum())))
        near = np.minimum(near, ((points - points[chosen[-1]]) ** 2).sum(1))
    centres, square = points[chosen], (points**2).sum(1)
    for _ in range(MAX_ROUNDS):
        own = (square[:, None] - 2 * points @ centres.T + (centres**2).sum(1)).argmin(1)
        size = np.bincount(own, weights, len(centres))
        sums = np.stack([np.bincount(own, weights * x, len(centres)) for x in points.T], axis=1)
        moved = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-300)[:, None], centres)
        far = ((moved - centres) ** 2).sum(1).max()
        centres = moved
        if far <= TOLERANCE**2:
            break
    cost = float((weights * _gaps(list(points.T), centres).min(0)).sum())
    return cost, centres


def _packed(rows: DataFrame) -> RDD[Row]:
    """The rows as blocks of doubles, feature by feature, which every round can read as they are; cached.

    Rounds are many and short: on plain blocks none of them has a query to plan.
    """
    p = len(rows.columns)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for start in range(0, len(batch), PACKED):
                part = batch.slice(start, PACKED)
                if n + len(part) > PACKED:
                    yield block(held)
                    held, n = [], 0
                held.append([c.to_numpy(zero_copy_only=False) for c in part.columns])
                n += len(part)
        if n:
            yield block(held)

    def block(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        whole = np.concatenate([np.concatenate([part[f] for part in held]) for f in range(p)], dtype=float)
        return pa.RecordBatch.from_arrays([pa.array([whole.tobytes()], pa.binary())], names=["block"])

    return rows.mapInArrow(pack, "block binary").rdd.persist(StorageLevel.MEMORY_AND_DISK)


def _pass(blocks: RDD[Row], p: int, centres: dict[int, np.ndarray], largest: float) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """For every k: rows of each cluster, their mean, and the cost under ``centres``; one job without a shuffle.

    Each task returns k x p sums, and there are as many tasks as keep the cores busy, however many rows there are.
    """
    # A power of two, so scaling is exact.
    scale = 2.0 ** (BITS - math.frexp(largest)[1]) if largest > 0 else 1.0
    stacked = np.concatenate(list(centres.values()))
    bounds = np.cumsum([0, *[len(c) for c in centres.values()]])
    spans = list(zip(bounds, bounds[1:], strict=False))
    step = max(1, SLICE // len(stacked))

    def tally(rows: Iterator[Row]) -> Iterator[tuple[np.ndarray, ...]]:
        size = np.zeros(len(stacked), np.int64)
        high, low = np.zeros((len(stacked), p), np.int64), np.zeros((len(stacked), p), np.int64)
        cost = np.zeros(len(stacked))
        for whole in (np.frombuffer(r.block).reshape(p, -1) for r in rows):
            for start in range(0, whole.shape[1], step):
                columns = list(whole[:, start : start + step])
                gaps = _gaps(columns, stacked)
                codes = [np.rint(x * scale).astype(np.int64) for x in columns]
                # Both limbs' sums stay below 2^53 in a block, where doubles are exact.
                limbs = [((q >> LIMB).astype(float), (q & (2**LIMB - 1)).astype(float)) for q in codes]
                for a, b in spans:
                    own = gaps[a:b].argmin(0)
                    size[a:b] += np.bincount(own, minlength=b - a)
                    cost[a:b] += np.bincount(own, gaps[a:b].min(0), b - a)
                    for f, (upper, lower) in enumerate(limbs):
                        high[a:b, f] += np.bincount(own, upper, b - a).astype(np.int64)
                        low[a:b, f] += np.bincount(own, lower, b - a).astype(np.int64)
        yield size, high.ravel(), low.ravel(), cost

    parts = blocks.coalesce(TASKS_PER_CORE * blocks.context.defaultParallelism).mapPartitions(tally).collect()
    size, cost, mean = np.zeros(len(stacked), np.int64), np.zeros(len(stacked)), stacked.copy()
    high, low = [0] * stacked.size, [0] * stacked.size
    for part_size, part_high, part_low, part_cost in parts:
        size += part_size
        cost += part_cost
        high, low = [x + y for x, y in zip(high, part_high.tolist(), strict=True)], [x + y for x, y in zip(low, part_low.tolist(), strict=True)]
    for at, (upper, lower) in enumerate(zip(high, low, strict=True)):
        c, f = divmod(at, p)
        if size[c]:
            # An emptied cluster keeps its centre.
            mean[c, f] = ((upper << LIMB) + lower) / int(size[c]) / scale
    return {k: (size[a:b], mean[a:b], float(cost[a:b].sum())) for k, (a, b) in zip(centres, spans, strict=True)}


def _sorted(centres: np.ndarray) -> np.ndarray:
    return np.array(sorted(centres.tolist())).reshape(centres.shape)


def fit_all(
    df: DataFrame, features: Sequence[str], ks: Sequence[int], *, seed: int = SEED, size: int = CORESET
) -> dict[int, tuple[list[list[float]], float]]:
    """Centroids in their own order and the within-cluster sum of squares, for every k; ``df`` is read once a round.

    There are fewer than k centroids where the coreset has fewer distinct rows, and none in a table without complete rows.
    """
    points, weights, largest = coreset(df, features, size=size, seed=seed)
    if not len(points):
        return {k: ([], 0.0) for k in ks}
    centres = {}
    for k in ks:
        starts = [_start(points, weights, k, np.random.default_rng([seed, k, s])) for s in range(STARTS)]
        centres[k] = _sorted(min(starts, key=lambda s: s[0])[1])
    p = len(features)
    blocks = _packed(df.filter(complete(features)).select(*[num(c).alias(f"_x{i}") for i, c in enumerate(features)]))
    moving = dict(centres)
    for _ in range(MAX_ROUNDS):
        for k, (_, mean, _) in _pass(blocks, p, moving, largest).items():
            if ((mean - centres[k]) ** 2).sum(1).max() <= TOLERANCE**2:
                del moving[k]
            else:
                moving[k] = mean
            centres[k] = mean
        if not moving:
            break
    centres = {k: _sorted(c) for k, c in centres.items()}
    last = _pass(blocks, p, centres, largest)
    blocks.unpersist()
    return {k: (centres[k].tolist(), cost) for k, (_, _, cost) in last.items()}


def lloyd_step(df: DataFrame, features: Sequence[str], centroids: Sequence[Sequence[float]]) -> DataFrame:
    """One round: ``cluster, n`` and the mean of every feature over the rows nearest to each centroid (none: the centroid)."""
    rows = df.filter(complete(features)).select(*[num(c).alias(f"_x{i}") for i, c in enumerate(features)])
    largest = rows.agg(F.greatest(F.lit(0.0), *[F.max(F.abs(F.col(x))) for x in rows.columns])).first()[0]
    blocks = _packed(rows)
    size, mean, _ = _pass(blocks, len(features), {0: np.array(centroids, float)}, largest)[0]
    blocks.unpersist()
    table = [(i, int(n), *map(float, m)) for i, (n, m) in enumerate(zip(size, mean, strict=True))]
    schema = ", ".join(["cluster int", "n bigint", *[f"`{c}` double" for c in features]])
    return df.sparkSession.createDataFrame(table, schema)


def assign(df: DataFrame, features: Sequence[str], centroids: dict[str, Sequence[Sequence[float]]]) -> DataFrame:
    """Add a column of nearest centroids (the first on a tie) for every entry; NULL where a feature is missing."""
    tables = {name: np.array(c, float) for name, c in centroids.items()}
    schema = ", ".join(f"c{i} int" for i in range(len(tables)))

    @F.pandas_udf(schema)
    def nearest(*columns: pd.Series) -> pd.DataFrame:
        xs = [c.to_numpy(dtype=float) for c in columns]
        missing = ~np.isfinite(sum(xs)) if len(xs[0]) else np.zeros(0, bool)
        out = {}
        for i, t in enumerate(tables.values()):
            own = np.zeros(len(xs[0]), np.int32)
            for start in range(0, len(own), step):
                if len(t):
                    own[start:start + step] = _gaps([x[start:start + step] for x in xs], t).argmin(0)
            out[f"c{i}"] = pd.arrays.IntegerArray(own, missing | (len(t) == 0))
        return pd.DataFrame(out)

    step = max(1, SLICE // max(1, *[len(t) for t in tables.values()]))
    marked = df.withColumn("_own", nearest(*[num(c) for c in features]))
    return marked.withColumns({name: F.col(f"_own.c{i}") for i, name in enumerate(tables)}).drop("_own")
