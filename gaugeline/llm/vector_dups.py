"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors at cosine ``c`` or more lie within squared distance ``2 - 2c``. After a rotation that spreads the distance
evenly, the vector is split into blocks of few dimensions; if every block's squared distance passed its share of that
budget (in proportion to its dimensions), the whole would pass it too. So each linked pair is close in some block. Each
block is range-joined on its own: a block's cell says on which side of a middle value each coordinate lies, a vector is sent
home to its cell and to every later cell that its ball of the block's budget reaches, and pairs met there are verified
exactly. A pair counts in the first block whose share it keeps, so each link counts once and no pair leaves a task.

Equal vectors are one weighted row from the start; crowded cells are cut into blocks whose pairs all meet. A label is only
searched by cells where they send its vectors to fewer places than it takes for all its pairs to meet: a label whose
vectors fit one task meets there once, and on evenly spread vectors, where cells prune nothing, all labels do.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_pairs, col, components, finite_vector, local_components, sorted_groups, store

_EPS = 1e-9
#: Components of the vectors of a label that meet whole, and rows of a tile of products.
WHOLE, TILE_ROWS, TILE = 2**21, 256, 8_192
#: Links held before they are merged.
HELD = 2**20


def rotation(dims: int, seed: int) -> np.ndarray:
    """Seeded random orthogonal matrix (rows are the new axes), by Gram-Schmidt."""
    q = np.random.default_rng(seed).standard_normal((dims, dims))
    for i in range(dims):
        for _ in range(2):
            q[i] -= (q[:i] * (q[:i] @ q[i])[:, None]).sum(axis=0)
        q[i] /= np.sqrt((q[i] * q[i]).sum())
    return q


def rotate(unit: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Rotated rows; the same row gives the same bits whatever stands beside it."""
    return np.stack([(unit * axis).sum(axis=1) for axis in turn], axis=1)


def near_vectors(
    vectors: DataFrame,
    *,
    id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    threshold: float = 0.93,
    block_dims: int = 8,
    seed: int = 29,
    sample: int = 4096,
    block: int = 2048,
    whole: int | None = None,
) -> DataFrame:
    """One row per row of ``vectors``: ``id``, ``n_links`` (other rows linked directly), ``component_id`` (smallest id
    reachable over links, its own included) and ``kept`` (``id`` is its component's).

    Rows are linked where labels are equal and not null and the cosine, in double precision, is ``threshold`` or more.
    Vectors that are null, zero, or hold null or non-finite components link with nothing; so do rows with a null id.
    Vectors of different lengths have no cosine: each length is searched by itself. Repeated rows each count. ``id`` identifies a row: rows that share one share a
    component. ``sample`` vectors (those of smallest id hash) set the cells' middle values and have no say in the result.
    ``whole`` distinct vectors of a label, as many as hold ``WHOLE`` components unless it is given, meet without cells.
    """
    rows = vectors.select(col(id).alias("_id"), col(vector).alias("_v"), col(label).alias("_l"))
    fit = finite_vector(F.col("_v")) & F.col("_l").isNotNull() & F.col("_id").isNotNull()
    fine = rows.filter(fit)
    lengths = sorted(r[0] for r in fine.select(F.size("_v")).distinct().collect())
    found = [_linked(fine.filter(F.size("_v") == n), n, threshold, block_dims, seed, sample, block, whole or max(block, WHOLE // n)) for n in lengths]
    alone = rows.filter(~F.coalesce(fit, F.lit(False))).select("_id", F.lit(0).cast("bigint").alias("n_links"), F.col("_id").alias("component_id"))
    return reduce(DataFrame.unionByName, found, alone).select(
        F.col("_id").alias(id), "n_links", "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def _linked(able: DataFrame, length: int, threshold: float, block_dims: int, seed: int, sample: int, block: int, whole: int) -> DataFrame:
    """``_id, n_links, component_id`` of usable vectors (``_id, _v, _l``) of one length."""
    spark = able.sparkSession
    unique = store(able.groupBy("_l", "_v").agg(F.min("_id").alias("rep"), F.count(F.lit(1)).alias("w")), "vectors")
    turn = rotation(length, seed)
    edges = np.arange(0, length + block_dims, block_dims).clip(max=length)
    spans = [(int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]
    budget = 2 - 2 * threshold

    kind = {f.name: f.dataType.simpleString() for f in unique.schema}
    packed = "<f4" if kind["_v"] == "array<float>" else "<f8"

    def units(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        big = np.abs(raw).max(axis=1, keepdims=True)  # keeps the norm of very large or small vectors finite
        raw = raw / big
        return raw, raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))

    def stacked(column: pd.Series) -> np.ndarray:
        flat = np.concatenate([np.asarray(v, np.float64) for v in column]) if len(column) else np.empty(0)
        return flat.reshape(len(column), length)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                flat = np.ascontiguousarray(batch.column("_v").flatten().to_numpy(zero_copy_only=False), packed)
                ends = np.arange(len(batch) + 1, dtype=np.int32) * np.int32(length * flat.itemsize)
                x = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(ends), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("_l", "rep", "w")], x], names=["_l", "rep", "w", "x"])

    def middles() -> np.ndarray:
        learn = unique.select("_v").orderBy(F.xxhash64("rep"), "rep").limit(sample).toPandas()["_v"]
        return np.median(rotate(units(stacked(learn))[1], turn), axis=0)

    def cells(rows: DataFrame) -> DataFrame:
        """``rows`` in every cell they are sent to."""
        middle = middles()

        def send(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                if not len(part):
                    continue
                raw = np.frombuffer(b"".join(part["x"]), packed).astype(np.float64).reshape(len(part), length)
                turned = rotate(units(raw)[1], turn) - middle
                for b, (lo, hi) in enumerate(spans):
                    y = turned[:, lo:hi]
                    flips = ((np.arange(1 << (hi - lo))[:, None] >> np.arange(hi - lo)) & 1).astype(float)
                    home = ((y > 0) << np.arange(hi - lo)).sum(axis=1)
                    reached = (y * y) @ flips.T <= budget * (hi - lo) / length + _EPS
                    cell = home[:, None] ^ np.arange(1 << (hi - lo))
                    r, f = np.nonzero(reached & ((cell > home[:, None]) | (flips.sum(axis=1) == 0)))
                    out = part.iloc[r].reset_index(drop=True)
                    out["block"], out["cell"], out["guest"] = b, cell[r, f], f > 0
                    yield out

        return rows.mapInPandas(send, f"{fields}, block int, cell int, guest boolean")

    fields = f"_l {kind['_l']}, rep {kind['rep']}, w bigint, x binary"
    rows = unique.select("_l", "rep", "w", "_v").mapInArrow(pack, fields)
    places = ["_l", "block", "cell"]
    together = rows.withColumns({"block": F.lit(-1), "cell": F.lit(0), "guest": F.lit(False)})
    # A vector goes to a cell in each block at least, so only a label of more chunks than blocks can do better by cells.
    crowded = unique.groupBy("_l").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > whole * len(spans)).collect()
    if crowded:
        crowded = spark.createDataFrame(crowded, f"_l {kind['_l']}, _n bigint")
        sent = cells(rows.join(F.broadcast(crowded.select("_l")), "_l")).groupBy(*places).count()
        copies = F.col("count") * F.ceil(F.col("count") / block)
        by_cells = (
            sent.groupBy("_l").agg(F.sum(copies).alias("_sent")).join(F.broadcast(crowded), "_l")
            .filter(F.col("_sent") < F.col("_n") * F.ceil(F.col("_n") / whole)).select("_l").collect()
        )
        pruned = F.broadcast(spark.createDataFrame(by_cells, f"_l {kind['_l']}"))
        together = together.join(pruned, "_l", "left_anti")
    dealt = block_pairs(together, places, F.col("rep"), whole)
    if crowded and by_cells:
        dealt = dealt.unionByName(block_pairs(cells(rows.join(pruned, "_l")), places, F.col("rep"), block))
    keys = [*places, "_a", "_b"]
    # Of products of singles, how far they may be off.
    margin = (length + 16) * 2.0**-23

    def meet(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in sorted_groups(parts, keys):
            guest = group["guest"].to_numpy(bool)
            if guest.all():
                continue
            raw = np.frombuffer(b"".join(group["x"]), packed).astype(np.float64).reshape(len(group), length)
            raw, unit = units(raw)
            norm = np.sqrt((raw * raw).sum(axis=1))
            a, b, here = int(group["_a"].iloc[0]), int(group["_b"].iloc[0]), int(group["block"].iloc[0])
            turned = rotate(unit, turn) if here >= 0 else None
            unit = unit.astype(np.float32)
            w, n, root = group["w"].to_numpy(), np.zeros(len(group)), np.arange(len(group))
            side = group["_q"].to_numpy()
            rows, columns = (np.flatnonzero(side == a), np.flatnonzero(side == b)) if a != b else (np.arange(len(group)),) * 2
            left, right, held = [], [], 0
            for lo in range(0, len(rows), TILE_ROWS):
                mine = rows[lo : lo + TILE_ROWS]
                for at in range(lo if a == b else 0, len(columns), TILE):
                    others = columns[at : at + TILE]
                    product = unit[mine] @ unit[others].T
                    i, j = np.nonzero(product >= threshold - margin)
                    sure = product[i, j] >= threshold + margin
                    p, q = mine[i], others[j]
                    take = ~(guest[p] & guest[q])
                    if a == b:
                        take &= q > p
                    p, q, sure = p[take], q[take], sure[take]
                    for s in range(0, len(p), 65_536):
                        x, y, link = p[s : s + 65_536], q[s : s + 65_536], sure[s : s + 65_536].copy()
                        if not link.all():
                            open_x, open_y = x[~link], y[~link]
                            link[~link] = (raw[open_x] * raw[open_y]).sum(axis=1) / (norm[open_x] * norm[open_y]) >= threshold
                        x, y = x[link], y[link]
                        if here >= 0:
                            gap = (turned[x] - turned[y]) ** 2
                            within = np.stack([gap[:, u:v].sum(axis=1) <= budget * (v - u) / length + _EPS for u, v in spans])
                            first = within.argmax(axis=0) == here
                            x, y = x[first], y[first]
                        n += np.bincount(x, w[y], len(group)) + np.bincount(y, w[x], len(group))
                        left.append(x)
                        right.append(y)
                        held += len(x)
                        if held > HELD:
                            root = local_components(len(group), np.concatenate([root, *left]), np.concatenate([np.arange(len(group)), *right]))
                            left, right, held = [], [], 0
            linked = n > 0
            if not linked.any():
                continue
            root = local_components(len(group), np.concatenate([root, *left]), np.concatenate([np.arange(len(group)), *right]))
            rep = group["rep"].to_numpy()
            yield pd.DataFrame({"rep": rep[linked], "root": rep[root[linked]], "n": n[linked].astype(np.int64)})

    met = store(
        dealt.repartition(*keys).sortWithinPartitions(*keys)
        .mapInPandas(meet, f"rep {kind['rep']}, root {kind['rep']}, n bigint"),
        "vector-links",
    )
    links = met.groupBy("rep").agg(F.sum("n").alias("_n"))
    parts = components(met.select(F.col("rep").alias("src"), F.col("root").alias("dst")), "vector-parts")
    known = (
        unique.join(links, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
        .select("_l", "_v", (F.coalesce("_n", F.lit(0)) + F.col("w") - 1).alias("n_links"),
                F.coalesce("component", "rep").alias("component_id"))
    )
    return able.join(known, ["_l", "_v"]).select("_id", "n_links", "component_id")
