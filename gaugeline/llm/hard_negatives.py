"""Hard-negative mining: integer inner products by Strassen's recursion, candidates by mergeable heaps.

Anchors are a stated set of rows, met with all rows in blocks. Positives are searched in blocks of equal label only, then
negatives in all blocks under the score windows that the positives set, so every score is computed once in each of the
two kinds of blocks it can matter in.

Handling: rows with a null id, label or vector, or a null or non-finite component, take no part. Vectors of different
lengths have no inner product, so they never meet; empty vectors score 0. A row never meets a row of its own id. Repeated
candidates count as often as they occur; anchors that repeat a whole row are one. Products that could leave 64 bits are
computed with Python's unbounded integers; a score beyond 64 bits is returned as the nearest one that fits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import col, store

#: A product with a side of at most this many is computed directly.
_LEAF = 16


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = _LEAF) -> np.ndarray:
    """Exact product of integer matrices (int64, or Python integers as objects) by seven products of half size.

    Sides are padded with zeros to even lengths at each level. In int64 all additions are exact modulo 2**64, so the
    result is exact where the product itself fits; intermediate sums need not.
    """
    n, k, m = a.shape[0], a.shape[1], b.shape[1]
    if min(n, k, m) <= leaf:
        return _direct(a, b)
    h, i, j = (n + 1) // 2, (k + 1) // 2, (m + 1) // 2
    a = np.pad(a, ((0, 2 * h - n), (0, 2 * i - k)))
    b = np.pad(b, ((0, 2 * i - k), (0, 2 * j - m)))
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * h, 2 * j), a.dtype)
    out[:h, :j] = p1 + p4 - p5 + p7
    out[:h, j:] = p3 + p5
    out[h:, :j] = p2 + p4
    out[h:, j:] = p1 - p2 + p3 + p6
    return out[:n, :m]


def _direct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Plain product; in doubles where every partial sum is an integer below 2**53, hence exact and fast."""
    if a.dtype == object or not a.size or not b.size:
        return a.dot(b) if a.shape[1] else np.zeros((a.shape[0], b.shape[1]), a.dtype)
    reach = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if reach < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def quantise(vectors: pa.Array, dims: int, scale: int) -> np.ndarray:
    """Rows of ``floor(scale * x)``, x as double: int64, or Python integers where a component is beyond 2**31."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), dims)
    scaled = np.floor(flat * scale)
    if not scaled.size or np.abs(scaled).max() < 2.0**31:
        return scaled.astype(np.int64)
    # Scaling a huge double can overflow, so the integers are built from the parts.
    whole = [[int(v) if np.isfinite(v) else int(x) * scale for v, x in zip(r, s, strict=True)] for r, s in zip(scaled, flat, strict=True)]
    return np.array(whole, dtype=object).reshape(scaled.shape)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of the rows of ``a`` and ``b``, wide enough for the factors of the score windows."""
    if a.dtype != object and b.dtype != object and a.size and b.size:
        if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] * 100 >= 2.0**62:
            a = a.astype(object)
    if a.dtype == object or b.dtype == object:
        a, b = a.astype(object), b.astype(object)
    return strassen(a, np.ascontiguousarray(b.T))


def _first(score: np.ndarray, ids: np.ndarray, fits: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first ``k`` of a row by score descending, id ascending, among ``fits``: a bounded heap's content."""
    at = np.flatnonzero(fits)
    if len(at) > 4 * k and score.dtype != object:
        least = np.partition(score[at], len(at) - k)[len(at) - k]
        at = at[score[at] >= least]
    order = sorted(at.tolist(), key=lambda p: (-int(score[p]), int(ids[p]))) if score.dtype == object else at[np.lexsort((ids[at], -score[at]))]
    return np.asarray(order[:k], np.int64)


def merged(heap: list[tuple[int, int]], score: np.ndarray, ids: np.ndarray, fits: np.ndarray, k: int) -> list[tuple[int, int]]:
    """A bounded heap of (-score, id) joined with a row's fitting candidates: the first ``k`` of both."""
    new = [(-int(score[p]), int(ids[p])) for p in _first(score, ids, fits, k)]
    return heapq.nsmallest(k, heap + new) if heap else new


def _fit64(v) -> int:
    return max(-(2**63), min(2**63 - 1, int(v)))


def _chunks(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    *,
    id: str = "vec_id",
    vector: str = "embedding",
    label: Column | str = "label",
    positives: int = 5,
    negatives: int = 3,
    least: int = 50,
    most: int = 95,
    scale: int = 256,
    anchor_rows: int = 4096,
    candidate_rows: int = 8192,
    tile: tuple[int, int] = (512, 4096),
) -> DataFrame:
    """Hard negatives of each anchor and positive: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    A positive is one of the first ``positives`` other rows of the anchor's label by score (ties by smaller id), a negative
    one of the first ``negatives`` rows of other labels with ``least * p <= 100 * s <= most * p``. Blocks hold about
    ``anchor_rows`` and ``candidate_rows`` rows, dealt by hash, whatever the label's size; ``tile`` bounds one product.
    """
    mark = col(label) if isinstance(label, str) else label
    fine = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(
        col(id).cast("bigint").alias("_id"), mark.cast("bigint").alias("_label"), col(vector).alias("_v"), F.coalesce(is_anchor, F.lit(False)).alias("_anchor")
    ).filter(F.col("_id").isNotNull() & F.col("_label").isNotNull() & F.col("_v").isNotNull())
    if rows.schema["_v"].dataType.elementType not in (T.FloatType(), T.DoubleType()):
        rows = rows.withColumn("_v", F.col("_v").cast("array<double>"))
    # The dealing column is fixed here, so that a block keeps its rows when a lost task is run again.
    rows = store(rows.filter(fine).withColumns({"_dims": F.size("_v"), "_h": F.xxhash64(F.lit("deal"), "_id", "_v")}), "negatives-rows")
    kind = rows.schema["_v"].dataType.simpleString()
    anchors = rows.filter("_anchor").select("_dims", "_label", "_id", "_v").distinct().withColumn("_key", F.xxhash64("_id", "_label", "_v"))
    sizes = rows.groupBy("_dims", "_label").agg(F.count(F.lit(1)).alias("_n"), F.count_if("_anchor").alias("_m"))
    by_label = sizes.select("_dims", "_label", F.ceil(F.col("_n") / candidate_rows).alias("_c"), F.greatest(F.lit(1), F.ceil(F.col("_m") / anchor_rows)).alias("_a"))
    by_length = sizes.groupBy("_dims").agg(F.sum("_n").alias("_n"), F.sum("_m").alias("_m")).select(
        "_dims", F.ceil(F.col("_n") / candidate_rows).alias("_c"), F.greatest(F.lit(1), F.ceil(F.col("_m") / anchor_rows)).alias("_a")
    )

    def blocks(left: DataFrame, right: DataFrame, counts: DataFrame, on: list[str]):
        """Every block of anchors beside every block of candidates."""
        ask = left.join(counts, on).withColumn("_ab", F.pmod("_h", "_a").cast("int")).withColumn("_cb", F.explode(F.sequence(F.lit(0), F.col("_c").cast("int") - 1)))
        hold = right.select(*[col(c).alias(c) for c in right.columns]).join(counts, on).withColumn("_cb", F.pmod("_h", "_c").cast("int")).withColumn("_ab", F.explode(F.sequence(F.lit(0), F.col("_a").cast("int") - 1)))
        keys = [*on, "_ab", "_cb"]
        hold = hold.select(*[col(c).alias(c) for c in (*keys, *({"_id", "_label", "_v"} - set(keys)))])
        return ask.groupBy(*keys), hold.groupBy(*keys)

    def tiles(ask: pa.Table, hold: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        dims = ask["_dims"][0].as_py()
        q = quantise(ask["_v"].combine_chunks(), dims, scale)
        for lo in range(0, hold.num_rows, tile[1]):
            part = hold.slice(lo, tile[1])
            x = quantise(part["_v"].combine_chunks(), dims, scale)
            for at in range(0, len(q), tile[0]):
                yield np.arange(at, min(at + tile[0], len(q))), np.arange(lo, lo + part.num_rows), scores(q[at : at + tile[0]], x)

    def heads(ask: pa.Table, hold: pa.Table) -> pa.Table:
        """Per anchor the block's first positives."""
        out = []
        if ask.num_rows and hold.num_rows:
            key, own, ids = (t.to_numpy() for t in (ask["_key"], ask["_id"], hold["_id"]))
            heaps: list[list] = [[] for _ in key]
            for left, right, s in tiles(ask, hold):
                for r, a in enumerate(left):
                    heaps[a] = merged(heaps[a], s[r], ids[right], ids[right] != own[a], positives)
            out = [(key[a], own[a], i, _fit64(-s)) for a, heap in enumerate(heaps) for s, i in heap]
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("_key", "anchor_id", "positive_id", "positive_score"), cols, strict=True)})

    labelled = anchors.withColumn("_h", F.col("_key"))
    ask, hold = blocks(labelled, rows, by_label, ["_dims", "_label"])
    found = ask.cogroup(hold).applyInArrow(heads, "_key bigint, anchor_id bigint, positive_id bigint, positive_score bigint")
    place = F.row_number().over(W.partitionBy("_key").orderBy(F.desc("positive_score"), "positive_id"))
    chosen = found.withColumn("_place", place).filter(F.col("_place") <= positives)
    # A list of at most ``positives`` entries an anchor goes with the anchor into the second round.
    wanted = chosen.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_place", "positive_id", "positive_score"))).alias("_p"))
    asking = labelled.join(
        wanted.select("_key", F.col("_p._place").alias("_place"), F.col("_p.positive_id").alias("_pid"), F.col("_p.positive_score").alias("_ps")), "_key"
    )
    asking = store(asking.select("_key", "_h", "_dims", "_label", "_id", F.col("_v").cast(kind).alias("_v"), "_place", "_pid", "_ps"), "negatives-anchors")

    def windows(ask: pa.Table, hold: pa.Table) -> pa.Table:
        """Per anchor and positive the block's first negatives inside the positive's window."""
        out = []
        if ask.num_rows and hold.num_rows:
            key, own, mine_, ids, theirs = (t.to_numpy() for t in (ask["_key"], ask["_id"], ask["_label"], hold["_id"], hold["_label"]))
            wanted = [list(zip(*w, strict=True)) for w in zip(*(ask[c].to_pylist() for c in ("_place", "_pid", "_ps")), strict=True)]
            heaps: list[list[list]] = [[[] for _ in w] for w in wanted]
            for left, right, s in tiles(ask, hold):
                for r, a in enumerate(left):
                    other = (theirs[right] != mine_[a]) & (ids[right] != own[a])
                    for n, (_, _, score) in enumerate(wanted[a]):
                        lo, hi = -(-least * score // 100), most * score // 100  # ceil and floor: the same integers fit
                        if lo <= hi:
                            heaps[a][n] = merged(heaps[a][n], s[r], ids[right], other & (s[r] >= lo) & (s[r] <= hi), negatives)
            out = [
                (key[a], own[a], n, positive, i, score, _fit64(-s))
                for a, w in enumerate(wanted)
                for (n, positive, score), heap in zip(w, heaps[a], strict=True)
                for s, i in heap
            ]
        cols = list(zip(*out, strict=True)) if out else [[]] * 7
        names = ("_key", "anchor_id", "_place", "positive_id", "negative_id", "positive_score", "negative_score")
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, cols, strict=True)})

    ask, hold = blocks(asking, rows, by_length, ["_dims"])
    found = ask.cogroup(hold).applyInArrow(
        windows, "_key bigint, anchor_id bigint, _place bigint, positive_id bigint, negative_id bigint, positive_score bigint, negative_score bigint"
    )
    rank = F.row_number().over(W.partitionBy("_key", "_place").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
