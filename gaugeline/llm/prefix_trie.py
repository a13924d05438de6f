"""Prefix trie of conversations: which turn sequences conversations share, and what sharing them saves.

Turns become 128-bit digests where they are read, so no text is shuffled. One streaming pass over sorted rows chains them
into prefix digests, a digest a node. Nodes are counted by one grouping, then the tree is cut: a subtree of at most
``shard_rows`` conversation turns is *light* and goes whole to one shard, the few nodes above are *heavy*. A shard
enumerates its digests, gives each a slot by a minimal perfect hash, checks each slot's digest, scatters the counts into
flat arrays and adds them up through the parents' slots, deepest first. What light subtrees add up to is summed per heavy
parent, and the heavy nodes go the same way.

Handling: rows of a null conversation id belong to no conversation and are left out. Null roles and texts are empty, a
null turn comes first; turns of one number are ordered by the digest of role and text, so repeated rows are turns of
their own. Texts are digested whole. An empty table gives no node, not even a root. Only the four named columns are read.
A conversation's turns and a group's base stay in one sorted stream that holds a few rows at a time.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import col, mix64, store

_ROOT = b"\0" * 16
_NODE = "digest binary, parent binary, depth int, conv_id bigint, n_convs bigint, chars bigint"


# ---- minimal perfect hash ----


class PerfectHash:
    """Minimal perfect hash of distinct 128-bit keys (two uint64 columns), built level by level.

    A level hashes the keys left into twice as many places; keys alone on their place stay there, others go on to the
    next level. A key's slot is the number of taken places before its own.
    """

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[int, np.ndarray]] = []
        self.table = np.zeros_like(keys)
        left, offset, at = keys, 0, 0
        while len(left):
            size = max(2, 2 * len(left))
            place = self._place(left, at, size)
            alone = np.bincount(place, minlength=size) == 1
            self.levels.append((size, offset + np.cumsum(alone) - alone.astype(np.int64)))
            stays = alone[place]
            self.levels[-1] = (size, np.where(alone, self.levels[-1][1], -1))
            offset, left, at = offset + int(alone.sum()), left[~stays], at + 1
            if at > 200:
                raise ValueError("keys of a perfect hash repeat")
        self.table[self._find(keys)] = keys

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        salt = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
        return (mix64(keys[:, 0] ^ mix64(keys[:, 1] + salt)) % np.uint64(size)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        slot = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (size, slots) in enumerate(self.levels):
            if not len(open_):
                break
            got = slots[self._place(keys[open_], level, size)]
            slot[open_[got >= 0]] = got[got >= 0]
            open_ = open_[got < 0]
        return slot

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slots of ``keys``, verified against the stored digests; -1 for keys that are not in the table."""
        slot = self._find(keys)
        known = slot >= 0
        known[known] = (self.table[slot[known]] == keys[known]).all(axis=1)
        return np.where(known, slot, -1)


def _keys(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)


def accumulate(nodes: pd.DataFrame) -> pd.DataFrame:
    """Subtree sums of a set of nodes in which every subtree is whole, but for what ``in_*`` columns bring along.

    Adds ``parent_conv_id`` (null where the parent is not here), ``n_children``, ``n_leaves`` and ``saved_tokens``.
    """
    keys, parents = _keys(nodes["digest"]), _keys(nodes["parent"])
    trie = PerfectHash(keys)
    slot, n = trie.slots(keys), len(nodes)
    above = trie.slots(parents)
    above[nodes["depth"].to_numpy() == 0] = -1

    def scattered(values: np.ndarray) -> np.ndarray:
        out = np.zeros(n, np.int64)
        out[slot] = values
        return out

    conv, depth = scattered(nodes["conv_id"].to_numpy()), scattered(nodes["depth"].to_numpy())
    parent = scattered(above)
    saved = scattered((nodes["n_convs"].to_numpy() - 1) * nodes["chars"].to_numpy() + nodes["in_saved"].to_numpy())
    children, leaves = scattered(nodes["in_children"].to_numpy()), scattered(nodes["in_leaves"].to_numpy())
    inside = np.flatnonzero(parent >= 0)
    np.add.at(children, parent[inside], 1)
    leaves[children == 0] = 1
    order = inside[np.argsort(-depth[inside], kind="stable")]
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    for level in np.split(order, cuts):
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    up = pd.array(conv[np.maximum(parent, 0)], dtype="Int64")
    up[parent < 0] = pd.NA
    return nodes.assign(
        parent_conv_id=up[slot], n_children=children[slot], n_leaves=leaves[slot], saved_tokens=saved[slot]
    )


# ---- rebuilding and chaining ----


def _heads(conv_id: int, modulus: int) -> int:
    """How many turns of its base a conversation opens with."""
    return zlib.crc32(str(conv_id).encode()) % modulus


def _chained(modulus: int):
    """Streams sorted turns of bases and conversations into one row per rebuilt prefix, the empty one included."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, base_turns = None, []
        conv, own, heads, opened, depth, digest, length = None, 0, 0, 0, 0, _ROOT, 0
        out: list[tuple] = []

        def put(turn: bytes, chars: int) -> None:
            nonlocal depth, digest
            before, depth = digest, depth + 1
            digest = hashlib.blake2b(before + turn, digest_size=16).digest()
            out.append((conv, depth, length, digest, before, chars))

        for part in parts:
            for b, c, rank, n, turn, chars in zip(*(part[x].tolist() for x in ("_base", "conv_id", "_rank", "_n", "_turn", "_chars")), strict=True):
                if b != base:
                    base, base_turns, conv = b, [], None
                if c != conv:
                    conv, own, heads = c, n, _heads(c, modulus)
                    # A base's own first turns come after its opening, which is the same turns.
                    opening = base_turns[:heads] if c != b else None
                    opened = len(opening) if c != b else min(heads, n)
                    length = opened + max(0, own - heads)
                    depth, digest = 0, _ROOT
                    out.append((conv, 0, length, _ROOT, _ROOT, 0))
                    for t, m in opening or []:
                        put(t, m)
                if c == b and rank <= modulus:
                    base_turns.append((turn, chars))
                if rank > heads or c == b:
                    put(turn, chars)
            if len(out) >= 10_000:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)

    return run


def _rows(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=["conv_id", "depth", "length", "digest", "parent", "chars"])


def prefixes(rows: DataFrame, *, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", group: int = 100, modulus: int = 6) -> DataFrame:
    """One row per rebuilt conversation and depth from 0: ``conv_id, depth, length, digest, parent, chars``.

    Conversation c opens with the first crc32(c) % ``modulus`` turns of conversation c - c % ``group``, its base.
    """
    name, said = F.coalesce(col(role).cast("string"), F.lit("")), F.coalesce(col(text).cast("string"), F.lit(""))
    # The role's length goes first, so that role and text can't run into each other.
    body = F.concat(F.octet_length(name).cast("string"), F.lit(":"), name, said)
    read = rows.filter(col(id).isNotNull()).select(
        col(id).cast("bigint").alias("conv_id"),
        col(turn).alias("_at"),
        F.unhex(F.substring(F.sha2(body, 256), 1, 32)).alias("_turn"),
        F.length(said).cast("bigint").alias("_chars"),
    )
    read = read.withColumn("_base", F.col("conv_id") - F.col("conv_id") % group).withColumn("_late", F.col("conv_id") != F.col("_base"))
    one = W.partitionBy("_base", "_late", "conv_id")
    # A base and its conversations share a partition, the base first, so no join is needed.
    placed = (
        read.repartition(F.col("_base"))
        .withColumn("_rank", F.row_number().over(one.orderBy(F.asc_nulls_first("_at"), "_turn")))
        .withColumn("_n", F.count(F.lit(1)).over(one))
        .sortWithinPartitions("_base", "_late", "conv_id", "_rank")
        .select("_base", "conv_id", "_rank", "_n", "_turn", "_chars")
    )
    return placed.mapInPandas(_chained(modulus), "conv_id bigint, depth int, length int, digest binary, parent binary, chars bigint")


# ---- members that end at a node ----


def _listed(block: int):
    """Runs of a node's ids as pieces of the comma-joined list."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, ids, out = None, [], []

        def close() -> None:
            if ids:
                out.append((node, ids[0], ",".join(map(str, ids))))

        for part in parts:
            for d, c in zip(part["digest"].tolist(), part["conv_id"].tolist(), strict=True):
                if d != node or len(ids) >= block:
                    close()
                    node, ids = d, []
                ids.append(c)
            if len(out) >= 5_000:
                yield pd.DataFrame(out, columns=["digest", "first", "ids"])
                out = []
        close()
        if out:
            yield pd.DataFrame(out, columns=["digest", "first", "ids"])

    return run


def _hashed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each node's pieces joined by commas, fed piece by piece."""
    node, state = None, None
    for part in parts:
        out = []
        for d, ids in zip(part["digest"].tolist(), part["ids"].tolist(), strict=True):
            if d != node:
                if state is not None:
                    out.append((node, state.hexdigest()))
                node, state = d, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield pd.DataFrame(out, columns=["digest", "ends_sha256"])
    if state is not None:
        yield pd.DataFrame([(node, state.hexdigest())], columns=["digest", "ends_sha256"])


def ends(paths: DataFrame, block: int = 4096) -> DataFrame:
    """``digest`` and ``ends_sha256`` of the nodes at which a conversation ends.

    Ids are range-sorted, so the many ids of a hot node are listed by many tasks; one task only hashes the lists.
    """
    at = paths.filter(F.col("depth") == F.col("length")).select("digest", "conv_id")
    lists = at.repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id").mapInPandas(
        _listed(block), "digest binary, first bigint, ids string"
    )
    return lists.repartition(F.col("digest")).sortWithinPartitions("digest", "first").mapInPandas(
        _hashed, "digest binary, ends_sha256 string"
    )


# ---- the tree ----


def _shards(limit: int):
    """Whole subtrees that stand together, as many at a time as fill ``limit`` nodes."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        n = 0
        for part in parts:
            if not len(part):
                continue
            if n + len(part) >= limit:
                # Up to the last subtree's start all subtrees are whole.
                part = pd.concat([*held, part], ignore_index=True)
                top = part["shard"].to_numpy()
                start = np.flatnonzero(top != top[-1])
                cut = int(start[-1]) + 1 if len(start) else 0
                if cut:
                    yield accumulate(part.iloc[:cut].reset_index(drop=True)).drop(columns=["shard"])
                held, n = [part.iloc[cut:]], len(part) - cut
            else:
                held.append(part)
                n += len(part)
        if n:
            yield accumulate(pd.concat(held, ignore_index=True)).drop(columns=["shard"])

    return run


def trie(rows: DataFrame, *, shard_rows: int | None = None, **names) -> DataFrame:
    """All nodes: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    A light subtree has at most ``shard_rows`` conversation turns: unless told, 65,536, or 8 times the root of their number
    where that is more, so that both a shard and the heavy nodes of a depth grow with the root of the table's size only.
    """
    paths = store(prefixes(rows, **names), "trie-paths")
    limit = shard_rows or max(65_536, 8 * math.isqrt(paths.count()))
    nodes = store(
        paths.groupBy("digest").agg(
            F.any_value("parent").alias("parent"), F.any_value("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
            F.count(F.lit(1)).alias("n_convs"), F.any_value("chars").alias("chars"),
            F.sum(F.col("length") - F.col("depth") + 1).alias("weight"),
        ),
        "trie-nodes",
    )
    heavy = (F.col("depth") == 0) | (F.col("weight") > limit)
    top = nodes.filter(heavy)
    # Along a conversation's path nodes only get lighter, so its first light node is the top of its shard.
    marks = paths.filter("depth > 0").join(top.select("digest", F.lit(True).alias("_heavy")), "digest", "left")
    below = marks.filter(F.col("_heavy").isNull()).groupBy("conv_id").agg(F.min_by("digest", "depth").alias("shard"))
    sums = {c: F.lit(0).cast("bigint") for c in ("in_children", "in_leaves", "in_saved")}
    light = nodes.filter(~heavy).join(below, "conv_id").drop("weight").withColumns(sums)
    schema = f"{_NODE}, in_children bigint, in_leaves bigint, in_saved bigint, parent_conv_id bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"
    order = ["digest", "parent", "depth", "conv_id", "n_convs", "chars", "in_children", "in_leaves", "in_saved"]
    done = store(
        light.select(*order, "shard").repartition(F.col("shard")).sortWithinPartitions("shard").mapInPandas(_shards(limit), schema), "trie-light"
    )
    tops = done.filter(F.col("parent_conv_id").isNull())
    brought = tops.groupBy(F.col("parent").alias("digest")).agg(
        F.count(F.lit(1)).alias("in_children"), F.sum("n_leaves").alias("in_leaves"), F.sum("saved_tokens").alias("in_saved")
    )
    joined = top.drop("weight").join(brought, "digest", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in sums})
    above = store(joined.select(*order, F.lit(b"").alias("shard")).repartition(1).mapInPandas(_shards(2**62), schema), "trie-heavy")
    hung = tops.drop("parent_conv_id").join(above.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent")
    every = done.filter(F.col("parent_conv_id").isNotNull()).unionByName(hung).unionByName(above)
    return every.join(ends(paths), "digest", "left").select(
        "conv_id", F.col("depth").cast("bigint").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
