"""Near-duplicate texts by DartMinHash.

A text is a weighted set: its shingles of five words with their numbers of occurrence. Every unit of weight owns a fixed
random stream of darts; a dart has a rank and falls on one of ``bands * rows`` coordinates. The darts below a rank that
shrinks with the text's total weight are thrown, so a text costs about one dart per shingle plus a fixed number, and the
earliest dart per coordinate is the signature: two texts agree in a coordinate with probability equal to their weighted
Jaccard similarity. Bands of signatures bring candidates together; all links are verified on the shingles.

Equal texts are one node from the start. Within a band's bucket a search over estimated similarity links the members with
few comparisons; the groups so found are then searched again on exact similarity. Groups of any size are cut into blocks
whose pairs all meet, so no task holds an unbounded group, and only a group's linking edges leave a task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import block_pairs, col, components, fresh, mix64, sortable, sorted_groups, store, text_key

_WORDS = re.compile(r"\w+")
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class WordHashes(dict):
    """64-bit hash of a word, cached up to ``limit`` words."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return out


def shingles(texts: list[str | None], hashes: WordHashes, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Row number and hash of every shingle of ``size`` lower-cased words, with repeats.

    A text of fewer words is one shingle of them all; a null text or one without words has none.
    """
    parts, owners = [], []
    for row, t in enumerate(texts):
        words = _WORDS.findall(t.lower()) if t else ()
        if not words:
            continue
        w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
        if len(w) < size:
            w = np.concatenate([w, np.full(size - len(w), 1, np.uint64)])
        parts.append(w)
        owners.append((row, len(w)))
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    words = np.concatenate(parts)
    n = len(words) - size + 1
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h = h * _ODD[1] + mix64(words[i : i + n] + _ODD[i % 5])
    h = mix64(h)
    lengths = np.array([k for _, k in owners])
    rows = np.repeat(np.array([r for r, _ in owners]), lengths)
    last = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(words))  # words left in the text, this one included
    whole = (last >= size)[:n]
    return rows[:n][whole], h[whole]


def dart_signatures(rows: np.ndarray, h: np.ndarray, n_rows: int, k: int) -> np.ndarray:
    """Signatures (``n_rows`` x ``k``, uint64) of weighted sets given as row numbers and element hashes with repeats.

    Rows without elements get zeros.
    """
    order = np.lexsort((h, rows))
    rows, h = rows[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    at = np.arange(len(h))
    copy = at - np.maximum.accumulate(np.where(new, at, 0))  # the how-manieth unit of this element
    unit = mix64(h + copy.astype(np.uint64) * _ODD[2])
    weight = np.bincount(rows, minlength=n_rows)
    out = np.zeros((n_rows, k), np.uint64)
    reach = np.where(weight > 0, (k * np.log(k) + 2 * k) / np.maximum(weight, 1), 0.0)
    todo = weight > 0
    while todo.any():
        mine = todo[rows]
        u, r = unit[mine], rows[mine]
        rank = np.zeros(len(u))
        slots, ranks, darts = [], [], []
        m = 0
        while len(u):
            m += 1
            x = mix64(u + np.uint64(m * int(_ODD[0]) % 2**64))
            rank = rank - np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            hit = rank <= reach[r]
            u, r, rank, x = u[hit], r[hit], rank[hit], x[hit]
            dart = mix64(x + _ODD[3])
            slots.append(r * k + (dart % np.uint64(k)).astype(np.int64))
            ranks.append(rank)
            darts.append(dart)
        slot, at_rank, dart = np.concatenate(slots), np.concatenate(ranks), np.concatenate(darts)
        late_first = np.lexsort((dart, at_rank))[::-1]  # later writes win, so the earliest dart stays
        flat = np.zeros(n_rows * k, np.uint64)
        filled = np.zeros(n_rows * k, bool)
        flat[slot[late_first]] = dart[late_first]
        filled[slot] = True
        full = filled.reshape(n_rows, k).all(axis=1) & todo
        out[full] = flat.reshape(n_rows, k)[full]
        todo &= ~full
        reach = reach * 2
    return out


def _chunks(texts: pa.Array, chars: int = 4_000_000) -> Iterator[tuple[int, list[str | None]]]:
    start, size, part = 0, 0, []
    for i, t in enumerate(texts):
        t = t.as_py()
        part.append(t)
        size += len(t or "")
        if size > chars:
            yield start, part
            start, size, part = i + 1, 0, []
    if part:
        yield start, part


def sketch(docs: DataFrame, *, id: str = "doc_id", text: str = "text", bands: int = 20, rows: int = 5, size: int = 5) -> DataFrame:
    """``node`` (128-bit key of the text), ``_id``, ``marks`` (a byte per coordinate) and ``buckets`` (a hash per band).

    Null texts are left out; texts without words have no buckets.
    """
    k = bands * rows
    given = docs.filter(col(text).isNotNull()).select(text_key(col(text)).alias("node"), col(id).alias("_id"), col(text).alias("_t"))
    kind = given.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        salt = np.arange(1, bands + 1, dtype=np.uint64) * _ODD[4]
        for batch in batches:
            marks, buckets = [], []
            for _, part in _chunks(batch.column(2)):
                r, h = shingles(part, hashes, size)
                sig = dart_signatures(r, h, len(part), k)
                some = np.bincount(r, minlength=len(part)) > 0
                b = np.zeros((len(part), bands), np.uint64)
                for i in range(rows):
                    b = mix64(b * _ODD[1] + sig[:, i::rows])
                b = mix64(b + salt).view(np.int64)
                marks += [m.tobytes() for m in (sig >> np.uint64(40)).astype(np.uint8)]
                buckets += [x if ok else [] for x, ok in zip(b.tolist(), some, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(marks, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))],
                names=["node", "_id", "marks", "buckets"],
            )

    return given.mapInArrow(run, f"node binary, _id {kind}, marks binary, buckets array<bigint>")


def _search(n: int, alike: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges that span the parts connected by ``alike``: each node meets only the nodes not reached yet."""
    waiting, edges = np.arange(n), []
    while len(waiting) > 1:
        frontier = [int(waiting[0])]
        waiting = waiting[1:]
        while frontier and len(waiting):
            v = frontier.pop()
            met = alike(v, waiting)
            for w in waiting[met].tolist():
                edges.append((v, w))
                frontier.append(w)
            waiting = waiting[~met]
    return edges


def near_duplicates(
    docs: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    threshold: float = 0.8,
    slack: float = 0.14,
    bands: int = 20,
    rows: int = 5,
    size: int = 5,
    block: int = 2048,
) -> DataFrame:
    """Classes of near-duplicate texts: one row per different text that is not null, with ``node`` (its key), ``class`` (the
    key its class goes by), ``rep_id`` (smallest id with this text), ``class_id`` (smallest id in the class) and
    ``class_node`` (a key of the text that holds it).

    Texts are linked where the weighted Jaccard similarity of their word shingles is ``threshold`` or more, and a class is
    what links connect. Candidates share a band and differ from the threshold by no more than ``slack`` in the
    signature's estimate (over three standard deviations). Equal texts are one row whatever their words; texts without words
    link with nothing else. Ties and repeated rows change nothing; an empty table gives no rows.
    """
    sketched = sketch(docs, id=id, text=text, bands=bands, rows=rows, size=size)
    nodes = store(
        sketched.groupBy("node").agg(F.min("_id").alias("rep_id"), F.any_value("marks").alias("marks"),
                                     F.any_value("buckets").alias("buckets")),
        "near-nodes",
    )
    in_bands = nodes.select("node", F.explode("buckets").alias("bucket"))
    shared = in_bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("bucket")
    members = in_bands.join(shared, "bucket").join(nodes.select("node", "marks"), "node")

    def by_estimate(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in sorted_groups(parts, ["bucket", "_a", "_b"]):
            marks = np.frombuffer(b"".join(group["marks"]), np.uint8).reshape(len(group), -1)
            least = (threshold - slack) * marks.shape[1]
            edges = _search(len(group), lambda v, rest: (marks[rest] == marks[v]).sum(axis=1) >= least)  # noqa: B023
            if edges:
                name = group["node"].to_numpy()
                yield pd.DataFrame({"src": name[[a for a, _ in edges]], "dst": name[[b for _, b in edges]]})

    dealt = block_pairs(members, ["bucket"], F.col("node"), block).select("bucket", "_a", "_b", "node", "marks")
    near = (
        dealt.repartition("bucket", "_a", "_b").sortWithinPartitions("bucket", "_a", "_b")
        .mapInPandas(by_estimate, "src binary, dst binary")
    )
    groups = components(near, "near-groups")

    texts = docs.filter(col(text).isNotNull()).select(
        text_key(col(text)).alias("node"), col(id).alias("_id"), col(text).alias("_t")
    )
    wanted = groups.join(nodes.select("node", "rep_id", "marks"), "node")
    # One copy of each text: rows of the smallest id, and of these one per text.
    held = (
        texts.join(wanted.withColumnRenamed("node", "_node"), (F.col("node") == F.col("_node")) & F.col("_id").eqNullSafe(F.col("rep_id")))
        .select("component", "node", "marks", "_t")
    )

    def by_shingles(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for group in sorted_groups(parts, ["component", "_a", "_b"]):
            group = group.drop_duplicates("node")
            if len(group) < 2:
                continue
            marks = np.frombuffer(b"".join(group["marks"]), np.uint8).reshape(len(group), -1)
            least = (threshold - slack) * marks.shape[1]
            sets = []
            for t in group["_t"]:
                _, h = shingles([t], hashes, size)
                sets.append(np.unique(h, return_counts=True))

            def alike(v: int, rest: np.ndarray) -> np.ndarray:
                met = (marks[rest] == marks[v]).sum(axis=1) >= least  # noqa: B023
                mine, times = sets[v]  # noqa: B023
                total = times.sum()
                for i in np.flatnonzero(met):
                    other, often = sets[rest[i]]  # noqa: B023
                    there = np.searchsorted(other, mine)
                    there[there == len(other)] = 0
                    both = np.minimum(times, often[there])[other[there] == mine].sum()
                    met[i] = both >= threshold * (total + often.sum() - both)
                return met

            edges = _search(len(group), alike)
            if edges:
                name = group["node"].to_numpy()
                yield pd.DataFrame({"src": name[[a for a, _ in edges]], "dst": name[[b for _, b in edges]]})

    blocks = block_pairs(held, ["component"], F.col("node"), block // 2).select("component", "_a", "_b", "node", "marks", "_t")
    linked = (
        blocks.repartition("component", "_a", "_b").sortWithinPartitions("component", "_a", "_b")
        .mapInPandas(by_shingles, "src binary, dst binary")
    )
    classes = components(linked, "near-classes").withColumnRenamed("component", "_c")
    found = nodes.select("node", "rep_id").join(classes, "node", "left").withColumn("class", F.coalesce("_c", "node"))
    first = found.groupBy("class").agg(F.min(F.struct(F.col("rep_id").isNull().alias("none"), "rep_id", "node")).alias("_first"))
    return found.join(first, "class").select(
        "node", "class", "rep_id", F.col("_first.rep_id").alias("class_id"), F.col("_first.node").alias("class_node")
    )


def class_of_rows(docs: DataFrame, classes: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id``, ``class_id`` and ``kept`` (its id is its class's). A null text is a class alone."""
    rows = docs.select(col(id).alias("_id"), text_key(col(text)).alias("node"))
    known = rows.join(classes.select("node", "class_id"), "node", "left")
    alone = F.when(F.col("node").isNull(), F.col("_id")).otherwise(F.col("class_id"))
    return known.select(F.col("_id").alias(id), alone.alias("class_id"), F.col("_id").eqNullSafe(alone).alias("kept"))


def keep_one(docs: DataFrame, classes: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` less all but one of each class: of rows with the kept id and text, the first by the other columns.

    Rows with a null text stay; columns of any name and type pass unchanged; an empty table gives no rows.
    """
    key, place = fresh(docs, "_key", "_row")

    def named(node: Column, number: Column) -> Column:
        return F.concat(F.hex(node), F.lit(":"), F.coalesce(number.cast("string"), F.lit("null")))

    keepers = classes.select(named(F.col("class_node"), F.col("class_id")).alias(key)).distinct()
    with_key = docs.filter(col(text).isNotNull()).withColumn(key, named(text_key(col(text)), col(id)))
    rest = [sortable(col(c), docs.schema[c].dataType) for c in docs.columns if c not in (id, text)]
    one = F.row_number().over(W.partitionBy(key).orderBy(*rest or [F.lit(1)]))
    kept = with_key.join(keepers, key, "left_semi").withColumn(place, one).filter(F.col(place) == 1)
    return kept.select(*[col(c) for c in docs.columns]).unionByName(docs.filter(col(text).isNull()))
