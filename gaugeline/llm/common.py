"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..functions.columns import col
from ..functions.session import checkpoint_dir, ship_package

#: Groups beyond a block that are broadcast at most.
_MOST_HOT = 10_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")  # texts may be long
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: the rows survive the loss of any executor and are computed once.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores behind it as it takes to differ from all columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def sortable(c: Column, kind: DataType) -> Column:
    """``c``, as text where its type has no order (maps, variants, intervals)."""
    return c.cast("string") if any(w in kind.simpleString() for w in ("map<", "variant", "interval")) else c


def mix64(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64), elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def finite_vector(c: Column) -> Column:
    """True where a vector is not null, holds only finite components and is not zero."""
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(c.isNotNull() & fine & F.exists(c, lambda x: x != 0), F.lit(False))


def block_pairs(df: DataFrame, keys: Sequence[str], member: Column, limit: int) -> DataFrame:
    """Split groups so that every pair of a group still meets exactly once, in at most ``2 * limit`` rows or so.

    Groups of up to ``limit`` rows stay whole. A larger one is dealt into chunks by a hash of ``member`` and each
    pair of chunks forms a block. Adds ``_q`` (the row's chunk), ``_a`` and ``_b`` (the block's chunks, ``_a <= _b``).
    Rows of equal ``member`` fall into one chunk, so ``member`` should tell the rows of a group apart.
    """
    hot = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > limit)
        .select(*[F.col(k).alias(f"_hot_{k}") for k in keys], F.ceil(F.col("_n") / limit).cast("int").alias("_c"))
    )
    # Few groups are large. Up to a fixed number they are broadcast, so the rows are shuffled once less; beyond it, joined.
    few = hot.limit(_MOST_HOT + 1).collect()
    if len(few) <= _MOST_HOT:
        hot = F.broadcast(df.sparkSession.createDataFrame(few, hot.schema))
    on = [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys]
    chunks = F.coalesce(F.col("_c"), F.lit(1))
    return (
        df.join(hot, on, "left")
        .withColumn("_q", F.pmod(F.xxhash64(F.lit("chunk"), member), chunks).cast("int"))
        .withColumn("_p", F.explode(F.sequence(F.lit(0), chunks - 1)))
        .withColumn("_a", F.least("_q", "_p"))
        .withColumn("_b", F.greatest("_q", "_p"))
        .drop("_c", "_p", *[f"_hot_{k}" for k in keys])
    )


def sorted_groups(parts: Iterator[pd.DataFrame], keys: list[str], least: int = 2) -> Iterator[pd.DataFrame]:
    """The groups of ``least`` or more rows of a stream of frames in which the rows of a group stand together.

    Far cheaper than one grouped call per group where groups are many and small. Holds one group and one frame.
    """
    carried: list[pd.DataFrame] = []
    for part in parts:
        if not len(part):
            continue
        change = np.zeros(len(part) - 1, bool)
        for k in keys:
            v = part[k]
            a, b = v.to_numpy()[:-1], v.to_numpy()[1:]
            change |= ~((a == b) | (v.isna().to_numpy()[:-1] & v.isna().to_numpy()[1:]))
        starts = np.concatenate([[0], np.flatnonzero(change) + 1, [len(part)]])
        if carried:
            before, now = carried[-1].iloc[-1], part.iloc[0]
            if all(before[k] == now[k] or (pd.isna(before[k]) and pd.isna(now[k])) for k in keys):
                carried.append(part.iloc[: starts[1]])
                if len(starts) == 2:
                    continue
                starts = starts[1:]
            if sum(map(len, carried)) >= least:
                yield pd.concat(carried, ignore_index=True)
            carried = []
        for lo, hi in zip(starts[:-2], starts[1:-1], strict=True):
            if hi - lo >= least:
                yield part.iloc[lo:hi].reset_index(drop=True)
        carried = [part.iloc[starts[-2] : starts[-1]]]
    if carried and sum(map(len, carried)) >= least:
        yield pd.concat(carried, ignore_index=True)


def local_components(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each of ``n`` positions over the given links."""
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """Connected components of ``edges`` (``src``, ``dst``): one row ``node``, ``component`` per node with an edge.

    ``component`` is the smallest node reachable. Every round maps each node to its smallest neighbour and
    contracts the edges, so nodes at least halve; each round's tables are written, none is collected.
    """
    found = None
    edges = store(edges.filter(~F.col("src").eqNullSafe(F.col("dst"))).select("src", "dst").distinct(), tag)
    while edges.take(1):
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        step = store(
            both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("_low"))
            .select("node", F.least("node", "_low").alias("up")),
            tag,
        )
        first = step.select(F.col("node").alias("src"), F.col("up").alias("_s"))
        second = step.select(F.col("node").alias("dst"), F.col("up").alias("_d"))
        edges = store(
            edges.join(first, "src").join(second, "dst")
            .filter(F.col("_s") != F.col("_d"))
            .select(F.least("_s", "_d").alias("src"), F.greatest("_s", "_d").alias("dst"))
            .distinct(),
            tag,
        )
        if found is None:
            found = step.select("node", F.col("up").alias("component"))
        else:
            onward = step.select(F.col("node").alias("component"), "up")
            found = found.join(onward, "component", "left").select(
                "node", F.coalesce("up", "component").alias("component")
            )
        found = store(found, tag)
    if found is None:
        found = edges.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return found


def text_key(text: Column) -> Column:
    """128-bit key of a text; null for null."""
    return F.unhex(F.md5(text))


__all__ = [
    "block_pairs", "col", "components", "finite_vector", "local_components", "mix64", "read", "sorted_groups",
    "store", "text_key",
]
