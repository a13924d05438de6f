"""Language-model scores by stupid backoff, from n-gram counts over all documents and all words.

S(w | v) = c(v w) / c(v) if the pair v w is seen, else ``backoff`` * c(w) / N. A document is scored by the counts of all other
documents: its own occurrences are taken off, so no text vouches for itself.

Words and pairs are keyed by 64-bit hashes; among a thousand million keys a clash is expected in one table of forty. Texts are written once
as chunks of a bounded number of words, numbered within the chunk. Each chunk sends its distinct words and pairs with their
counts, partitioned by ranges of the key; a partition adds them up and answers every chunk with the totals, and chunks are
scored by themselves. A key travels once per chunk at most, so no partition fills with one frequent word or pair, and
keys and counts travel as compressed column blocks of a few bytes each.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, mix64, store

_WORD = re.compile(r"\w+")


def pack_columns(*columns: np.ndarray) -> bytes:
    """Columns of unsigned numbers, all of one length, as one compressed block of byte planes."""
    return zstandard.compress(b"".join(c.view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns), 1)


def unpack_columns(block: bytes, *kinds: str) -> list[np.ndarray]:
    flat = np.frombuffer(zstandard.decompress(block), np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n = len(flat) // sum(sizes)
    edges = np.cumsum([0, *sizes]) * n
    return [np.ascontiguousarray(flat[at : at + n * s].reshape(s, n).T).view(k).reshape(n) for k, s, at in zip(kinds, sizes, edges, strict=False)]


class WordKeys(dict):
    """64-bit key of a lower-cased word; 0 for a word that is not in ``known``, where that is given."""

    def __init__(self, known: set[str] | None = None, limit: int = 400_000):
        super().__init__()
        self.known, self.limit = known, limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        fits = self.known is None or word in self.known
        out = self[word] = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little") if fits else 0
        return out


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """64-bit keys of pairs of word keys."""
    return mix64(mix64(first ^ np.uint64(0x9E3779B97F4A7C15)) + second)


def frequent_words(docs: DataFrame, text: str, size: int) -> set[str]:
    """The lower-cased words that are more frequent than the one of rank ``size + 1``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for t in batch.column(0):
                seen.update(_WORD.findall((t.as_py() or "").lower()))
            if len(seen) > 500_000:
                yield out()
                seen.clear()
        yield out()

    counted = docs.select(col(text)).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counted = store(counted, "word-counts")
    # How many words have each count: at most about the root of twice the number of words.
    spread = counted.groupBy("n").agg(F.count(F.lit(1)).alias("k")).toPandas().sort_values("n", ascending=False)
    fits = spread["n"].to_numpy()[np.cumsum(spread["k"].to_numpy()) <= size]
    if not len(fits):
        return set()
    return {r["word"] for r in counted.filter(F.col("n") >= int(fits[-1])).select("word").collect()}  # at most ``size`` rows


def _chunks(batches: Iterator[pa.RecordBatch], look: WordKeys, words: int = 1_000_000):
    """Chunks of texts (``_uid``, ``_id``, text): the first row's number, the ids, and the word keys of each text."""
    uid, ids, parts, size = None, [], [], 0
    for batch in batches:
        for u, i, t in zip(*batch.columns, strict=True):
            found = _WORD.findall((t.as_py() or "").lower())
            uid = u.as_py() if uid is None else uid
            ids.append(i.as_py())
            parts.append(np.fromiter(map(look.__getitem__, found), np.uint64, len(found)))
            size += len(found)
            if size >= words or len(ids) >= 50_000:
                yield uid, ids, parts
                uid, ids, parts, size = None, [], [], 0
    if ids:
        yield uid, ids, parts


class Chunk:
    """A chunk's words and pairs: ``local`` (number of each word), ``doc`` (its text's place), ``second`` (places of words that end
    a pair), ``pair`` (their pair's number), ``keys`` (of the ``n_words`` distinct words, then of the pairs) and ``times``."""

    def __init__(self, keys: bytes, words: bytes, sizes: np.ndarray):
        word_keys = np.cumsum(unpack_columns(keys, "<u8")[0], dtype=np.uint64)
        self.local = unpack_columns(words, "<u4")[0].astype(np.int64)
        self.n_words = n = len(word_keys)
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.second = np.flatnonzero(self.doc[1:] == self.doc[:-1]) + 1
        code = self.local[self.second - 1] * n + self.local[self.second]
        pairs, self.pair, times = np.unique(code, return_inverse=True, return_counts=True)
        self.keys = np.concatenate([word_keys, pair_keys(word_keys[pairs // max(n, 1)], word_keys[pairs % max(n, 1)])])
        self.times = np.concatenate([np.bincount(self.local, minlength=n), times])


def score_documents(
    docs: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    vocabulary: int | None = None,
    backoff: float = 0.4,
    heavy: float = 1e-4,
    part_words: int = 4_000_000,
) -> DataFrame:
    """One row per row: ``id``, ``n_words``, ``n_backoff`` (words scored by backoff), ``log_score`` (sum of log S; a text's first word
    is scored as backoff without its factor) and ``mean_log_score`` (per word, null without words).

    All words are counted. Only where a caller gives a ``vocabulary``, words outside that many most frequent ones count as one
    unknown word. A count that is 0 once the document's own occurrences are off counts as 1. Null and empty texts have no words and a
    log score of 0. Repeated rows are scored each, by all others; an empty table gives no rows. ``part_words`` sets the
    number of hash partitions from the number of words; it changes no score. ``heavy`` is accepted for older callers and has no effect:
    frequent pairs need no path of their own.
    """
    known = None if vocabulary is None else docs.sparkSession.sparkContext.broadcast(frequent_words(docs, text, vocabulary))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = WordKeys(None if known is None else known.value)
        for uid, ids, parts in _chunks(batches, look):
            keys, local = np.unique(np.concatenate(parts), return_inverse=True)
            yield pa.RecordBatch.from_arrays([
                pa.array([uid], pa.int64()), pa.array([ids], pa.list_(pa.string())), pa.array([[len(p) for p in parts]], pa.list_(pa.int64())),
                pa.array([len(local)], pa.int64()), pa.array([pack_columns(np.diff(keys, prepend=np.uint64(0)))], pa.binary()),
                pa.array([pack_columns(local.astype("<u4"))], pa.binary()),
            ], names=["chunk", "ids", "sizes", "n", "keys", "words"])

    # Ids travel as text, because numbers beside a null would become floating point.
    rows = docs.select(F.monotonically_increasing_id().alias("_uid"), col(id).cast("string").alias("_id"), col(text).alias("_t"))
    kind = docs.select(col(id)).schema[0].dataType.simpleString()
    chunks = store(
        rows.mapInArrow(encode, "chunk bigint, ids array<string>, sizes array<bigint>, n bigint, keys binary, words binary"), "lm-chunks")
    total = int(chunks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    parts_n = max(1, -(-total // part_words))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, sizes, keys, words in zip(*batch.columns, strict=True):
                c = Chunk(keys.as_py(), words.as_py(), np.array(sizes.as_py(), np.int64))
                order = np.argsort(c.keys)
                keys, times = c.keys[order], c.times[order].astype("<u4")
                part = ((keys >> np.uint64(32)) * np.uint64(parts_n) >> np.uint64(32)).astype(np.int64)
                edges = [0, *(np.flatnonzero(np.diff(part)) + 1), len(part)] if len(part) else [0]
                cuts = list(zip(edges[:-1], edges[1:], strict=True))
                yield pa.RecordBatch.from_arrays([
                    pa.array([part[a] for a, _ in cuts], pa.int64()), pa.array([chunk.as_py()] * len(cuts), pa.int64()),
                    pa.array([pack_columns(np.diff(keys[a:b], prepend=np.uint64(0)), times[a:b]) for a, b in cuts], pa.binary()),
                ], names=["part", "chunk", "block"])

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        """The totals of each chunk's keys, in the order of the keys."""
        both = [unpack_columns(b, "<u8", "<u4") for b in group["block"]]
        keys, back = np.unique(np.concatenate([np.cumsum(d, dtype=np.uint64) for d, _ in both]), return_inverse=True)
        totals = np.bincount(back, np.concatenate([n for _, n in both]), len(keys)).astype("<u8")
        edges = np.cumsum([0, *[len(d) for d, _ in both]])
        return pd.DataFrame({"chunk": group["chunk"], "part": group["part"],
                             "block": [pack_columns(totals[back[a:b]]) for a, b in zip(edges[:-1], edges[1:], strict=True)]})

    def score(asked: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        ids, sizes, keys, words = asked[["ids", "sizes", "keys", "words"]].iloc[0]
        sizes = np.asarray(sizes, np.int64)
        c = Chunk(keys, words, sizes)
        totals = np.empty(len(c.keys), np.int64)
        if len(totals):
            blocks = answers.sort_values("part")["block"]
            totals[np.argsort(c.keys)] = np.concatenate([unpack_columns(b, "<u8")[0] for b in blocks])
        others = np.maximum(total - sizes, 1)[c.doc]
        _, back, mine = np.unique(c.doc * c.n_words + c.local, return_inverse=True, return_counts=True)
        rest = np.maximum(totals[c.local] - mine[back], 1)  # of each word among the other documents
        log = np.log(rest / others)
        doc, n_pairs = c.doc[c.second], len(c.keys) - c.n_words
        _, back, mine = np.unique(doc * n_pairs + c.pair, return_inverse=True, return_counts=True)
        seen = totals[c.n_words :][c.pair] - mine[back]
        log[c.second] = np.where(seen > 0, np.log(np.maximum(seen, 1) / rest[c.second - 1]), np.log(backoff) + log[c.second])
        backs = np.ones(len(log), np.int64)
        backs[c.second] = seen <= 0
        return pd.DataFrame({
            "_id": pd.Series(list(ids), dtype=object), "n_words": sizes, "n_backoff": np.bincount(c.doc, backs, len(sizes)).astype(np.int64),
            "log_score": np.bincount(c.doc, log, len(sizes)),
        })

    answers = (
        chunks.select("chunk", "sizes", "keys", "words").mapInArrow(ask, "part bigint, chunk bigint, block binary")
        .groupBy("part").applyInPandas(answer, "chunk bigint, part bigint, block binary")
    )
    return (
        chunks.groupBy("chunk").cogroup(answers.groupBy("chunk"))
        .applyInPandas(score, "_id string, n_words bigint, n_backoff bigint, log_score double")
        .select(F.col("_id").cast(kind).alias(id), "n_words", "n_backoff", "log_score",
                (F.col("log_score") / F.nullif("n_words", F.lit(0))).alias("mean_log_score"))
    )
