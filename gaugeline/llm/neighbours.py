"""Approximate nearest neighbours by largest inner product, over an inverted multi-index.

Each vector is cut into two halves that are quantised separately, so ``centroids`` centroids a half make ``centroids``
squared cells. For a query, the distance of a half's centroid is how far its inner product falls short of the best
one's; a heap walks the centroid pairs by rising sum of both distances until the cells visited hold ``share`` of all
rows. What they hold is scored exactly on the original vectors.

The walk needs the cells' sizes only (a table bounded by the number of cells). Its end is one number a query, the largest
sum visited, so any task can tell the cells that a query visits. Rows are dealt into shards, each with its own lists by
cell, and blocks of queries visit every shard; a shard and a block give at most ``k`` rows a query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col, finite_vector, store


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Centroids of the rows of ``x`` (Lloyd), at most ``k``; fewer where there are fewer rows."""
    rng = np.random.default_rng(seed)
    if len(x) <= k:
        return x.copy()
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        for d in range(x.shape[1]):
            total = np.bincount(near, x[:, d], k)
            c[n > 0, d] = total[n > 0] / n[n > 0]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Position of the nearest centroid of each row."""
    out = np.empty(len(x), np.int64)
    half = 0.5 * (c * c).sum(axis=1)
    for lo in range(0, len(x), 1024):
        out[lo : lo + 1024] = (np.einsum("nd,kd->nk", x[lo : lo + 1024], c) - half).argmax(axis=1)
    return out


def walk(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, wanted: int) -> float:
    """Sum of distances at which the visited cells hold ``wanted`` rows; cells at that sum are visited too.

    ``first`` and ``second`` are the query's distances to the centroids of each half, ``sizes[i, j]`` the rows of a cell.
    """
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    da, db = first[a], second[b]
    heap, held, reached = [(da[0] + db[0], 0, 0)], 0, -np.inf
    while heap:
        reached, i, j = heapq.heappop(heap)
        held += sizes[a[i], b[j]]
        if held >= wanted:
            break
        if j + 1 < len(db):
            heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(da):
            heapq.heappush(heap, (da[i + 1] + db[0], i + 1, 0))
    return float(reached)


def search(
    vectors: DataFrame,
    is_query: Column,
    *,
    id: str = "vec_id",
    vector: str = "embedding",
    k: int = 20,
    centroids: int = 32,
    share: float = 0.65,
    sample: int = 8192,
    seed: int = 5,
    shard_rows: int = 16_384,
    query_rows: int = 4096,
) -> DataFrame:
    """The ``k`` candidates found with the largest inner product for each row where ``is_query`` holds.

    Columns ``query_id``, ``rank`` (from 1), ``id`` and ``score`` (double), ties to the smaller id. Candidates are all rows
    but the query's own, so every row with another id; all of them if there are fewer than ``k``. Vectors that are null,
    zero, or hold null or non-finite components take no part, nor do rows with a null id. Vectors of different lengths have
    no inner product, so each length has an index of its own. Rows that repeat an id and its vector are found once each. ``sample`` rows (smallest id hash) fit the centroids;
    every row is indexed. ``share`` of the rows, and at least ``10 * k``, is visited whatever their number; a larger one
    finds more.
    """
    rows = vectors.withColumn("_is_query", F.coalesce(is_query, F.lit(False))).select(
        col(id).alias("_id"), col(vector).cast("array<double>").alias("_v"), "_is_query"
    )
    rows = rows.filter(finite_vector(F.col("_v")) & F.col("_id").isNotNull())
    lengths = {r[0]: r[1] for r in rows.groupBy(F.size("_v")).agg(F.count(F.lit(1))).collect()} or {0: 0}
    how = (k, centroids, share, sample, seed, shard_rows, query_rows)
    found = [_search(rows.filter(F.size("_v") == length), length, n, *how) for length, n in sorted(lengths.items())]
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "found"))
    return reduce(DataFrame.unionByName, found).withColumn("rank", rank).filter(F.col("rank") <= k).select(
        "query_id", "rank", F.col("found").alias(id), "score"
    )


def _search(
    rows: DataFrame, length: int, n: int, k: int, centroids: int, share: float, sample: int, seed: int, shard_rows: int, query_rows: int
) -> DataFrame:
    """``query_id, found, score`` of the ``n`` usable rows (``_id, _v, _is_query``) of one length: up to ``k`` a query and shard."""
    kind = rows.schema["_id"].dataType.simpleString()
    cut = (length + 1) // 2

    def matrix(column: pd.Series) -> np.ndarray:
        flat = np.concatenate([np.asarray(v, np.float64) for v in column]) if len(column) else np.empty(0)
        return flat.reshape(len(column), length)

    learn = matrix(rows.select("_v").orderBy(F.xxhash64("_id"), "_id").limit(sample).toPandas()["_v"])
    books = [k_means(learn[:, :cut], centroids, seed), k_means(learn[:, cut:], centroids, seed + 1)]

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                x = matrix(part["_v"])
                yield part.assign(first=nearest(x[:, :cut], books[0]), second=nearest(x[:, cut:], books[1]))

    indexed = store(rows.mapInPandas(place, f"_id {kind}, _v array<double>, _is_query boolean, first bigint, second bigint"), "index")
    sizes = np.zeros((max(1, len(books[0])), max(1, len(books[1]))), np.int64)
    for r in indexed.groupBy("first", "second").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r["first"], r["second"]] = r["n"]
    wanted = max(int(np.ceil(share * sizes.sum())), 10 * k)

    def distances(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = [np.stack([(h * c).sum(axis=1) for c in book], axis=1) for h, book in zip((x[:, :cut], x[:, cut:]), books, strict=True)]
        return tuple(p.max(axis=1, keepdims=True) - p for p in parts)

    def reach(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                first, second = distances(matrix(part["_v"]))
                yield part.assign(reach=[walk(a, b, sizes, wanted) for a, b in zip(first, second, strict=True)])

    shards = max(1, -(-n // shard_rows))
    blocks = max(1, -(-n // (20 * query_rows)))
    queries = indexed.filter("_is_query").select("_id", "_v").mapInPandas(reach, f"_id {kind}, _v array<double>, reach double")
    asked = queries.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "_id"), F.lit(blocks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    )
    stored = indexed.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "_id", "_v"), F.lit(shards)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )

    def visit(ask: pd.DataFrame, hold: pd.DataFrame) -> pd.DataFrame:
        q_id, q = ask["_id"].to_numpy(), matrix(ask["_v"])
        x_id, x = hold["_id"].to_numpy(), matrix(hold["_v"])
        first, second = distances(q)
        limit = ask["reach"].to_numpy() + 1e-12
        cell = hold["first"].to_numpy() * len(books[1]) + hold["second"].to_numpy()
        order = np.argsort(cell, kind="stable")
        x_id, x, cell = x_id[order], x[order], cell[order]
        i, j = cell // len(books[1]), cell % len(books[1])
        out = []
        for lo in range(0, len(q), 256):
            hi = min(lo + 256, len(q))
            score = q[lo:hi] @ x.T
            score[first[lo:hi][:, i] + second[lo:hi][:, j] > limit[lo:hi, None]] = -np.inf
            score[q_id[lo:hi, None] == x_id[None, :]] = -np.inf
            least = np.partition(score, max(0, len(x) - k), axis=1)[:, max(0, len(x) - k)] if len(x) else None
            for r in range(hi - lo):
                floor = least[r] - 1e-9 * max(1.0, abs(least[r])) if np.isfinite(least[r]) else -np.inf
                at = np.flatnonzero((score[r] >= floor) & np.isfinite(score[r]))
                exact = (x[at] * q[lo + r]).sum(axis=1)
                best = np.lexsort((x_id[at], -exact))[:k]
                out.append(pd.DataFrame({"query_id": q_id[lo + r], "found": x_id[at[best]], "score": exact[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "found": [], "score": []})

    return asked.groupBy("shard", "block").cogroup(stored.groupBy("shard", "block")).applyInPandas(
        visit, f"query_id {kind}, found {kind}, score double"
    )
