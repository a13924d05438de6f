"""Packing documents into fixed sequences by cutting-stock column generation.

The lengths of all pieces form a histogram of at most ``classes`` bins. A linear program over patterns (how many pieces of
each bin share one sequence) covers it: a knapsack dynamic program prices new patterns with the current duals until no
pattern can lower the number of sequences by more than ``gap``. Patterns are rounded down, what is left is filled by
the same dynamic program bin by bin, and every pattern's places are dealt to the documents of a bin by their rank.
Only the histogram and the patterns, bounded by ``classes``, pass through the driver.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col, store

#: Texts with a blank beside another one, or other white space, or at an end.
_ODD_BLANKS = r"[\s\x0b\x1c-\x1f\x{85}\pZ] | [\s\x0b\x1c-\x1f\x{85}\pZ]|^ | $"


class BatchIds:
    """Ids of a batch of texts: every distinct unit of the batch is encoded once, all in one call.

    A unit of byte-level BPE is cut at single blanks between two other characters, where no token crosses, and starts
    with its blank; in the ids of all units in a row, each token that starts with a blank opens a unit. First units, units
    that hold a special string and texts with other blanks are encoded by themselves.
    """

    def __init__(self, name: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(name if "/" in name else public_tokenizers.path(name))
        self.specials = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.fast, self.opens = None, None
        if name == "byte_bpe_50k.json":  # a faster encoder over the same vocabulary
            import tiktoken

            with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ordinary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.opens = np.zeros(max(ranks.values()) + 1, bool)
            self.opens[[i for token, i in ranks.items() if token.startswith(b" ")]] = True

    def encode(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.specials):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different units, each with its blank, in a row, and how many each has."""
        own = np.full(len(units), self.fast is None)
        for s in self.specials:
            own |= pc.match_substring(units, s).to_numpy(zero_copy_only=False)
        ids, size = np.empty(0, np.uint32), np.zeros(len(units), np.int64)
        if not own.all():
            plain = units.filter(pa.array(~own))
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(plain)], pa.int32()), plain), " ")[0].as_py()
            ids = np.asarray(self.fast.encode_ordinary(" " + joined), np.uint32)
            size[~own] = np.diff(np.append(np.flatnonzero(self.opens[ids]), len(ids)))
        if own.any():
            parts = [self.encode(" " + u) for u in units.filter(pa.array(own)).to_pylist()]
            size[own] = [len(p) for p in parts]
            every = np.empty(size.sum(), np.uint32)
            mine = np.repeat(own, size)
            every[mine], every[~mine] = np.concatenate([np.asarray(p, np.uint32) for p in parts]), ids
            ids = every
        return ids, size

    def texts(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with ``end_id`` behind them, and where each text's ids start (one entry more than texts)."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _ODD_BLANKS).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")  # an odd text stands as one empty first unit
        flat, bounds = split.flatten(), split.offsets.to_numpy()
        bounds = bounds - bounds[0]
        first = np.zeros(len(flat), bool)
        first[bounds[:-1]] = True
        coded = flat.filter(pa.array(~first)).dictionary_encode()
        known, size = self.units(coded.dictionary)
        heads = [self.encode(h) for h in pc.if_else(pa.array(odd), texts, flat.filter(pa.array(first))).to_pylist()]
        # One pool of ids: the distinct units, then the heads, then the end.
        pool = np.concatenate([known, *[np.asarray(h, np.uint32) for h in heads], [end_id]]).astype("<u4")
        size = np.concatenate([size, [len(h) for h in heads], [1]]).astype(np.int64)
        start = np.cumsum(size) - size
        code = np.empty(len(flat), np.int64)
        code[~first] = coded.indices.to_numpy()
        code[first] = len(coded.dictionary) + np.arange(len(heads))
        code = np.insert(code, bounds[1:], len(size) - 1)
        taken = size[code]
        after = np.cumsum(taken)
        ids = pool[np.repeat(start[code] - after + taken, taken) + np.arange(after[-1] if len(after) else 0)]
        return ids, np.concatenate([[0], after[bounds[1:] + np.arange(len(texts))]])


@lru_cache(maxsize=2)
def _batch_ids(name: str) -> BatchIds:
    """Loaded once a worker."""
    return BatchIds(name)


def cut_pieces(docs: DataFrame, *, id: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.json",
               capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of at most ``capacity`` ids: ``id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``.

    A document's ids are its text's ids and ``end_id``. It is cut at multiples of ``capacity``, so only its last piece is
    shorter. Null and empty texts hold ``end_id`` alone.
    """
    rows = docs.select(col(id).alias("_id"), col(text).alias("_t"))
    kind = rows.schema["_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _batch_ids(tokenizer)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, begin = ids_of.texts(batch.column(1), end_id)
            total = np.diff(begin)
            pieces = -(-total // capacity)
            row = np.repeat(np.arange(len(total)), pieces)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
            length = np.minimum(capacity, total[row] - start)
            raw, at = memoryview(ids).cast("B"), 4 * (begin[row] + start)
            crc = [zlib.crc32(raw[lo:hi]) for lo, hi in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
            columns = [pa.array(x, pa.int64()) for x in (start, length, crc, total[row])]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *columns],
                                             names=[id, "start", "length", "ids_crc32", "doc_tokens"])

    return rows.mapInArrow(
        run, f"`{id}` {kind.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    )


def priced_patterns(values: np.ndarray, sizes: np.ndarray, capacity: int, top: int = 1) -> list[np.ndarray]:
    """Unbounded knapsack by dynamic programming: the ``top`` best patterns with different first pieces, best first."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := upto[c]:
            got = best[c - sizes[:k]] + values[:k]
            i = int(got.argmax())
            if got[i] > best[c] + 1e-12:
                best[c], pick[c] = got[i], i
    out = []
    fits = int(upto[capacity])
    for first in np.argsort(-(best[capacity - sizes[:fits]] + values[:fits]), kind="stable")[:top]:
        pattern = np.zeros(len(sizes), int)
        pattern[first] = 1
        c = capacity - int(sizes[first])
        while c > 0:
            if pick[c] < 0:
                c -= 1
            else:
                pattern[pick[c]] += 1
                c -= int(sizes[pick[c]])
        out.append(pattern)
    return out


def best_fit(sizes: np.ndarray, left: np.ndarray, room: int) -> np.ndarray:
    """How many of each size to take, at most ``left`` of each, to fill ``room`` best."""
    best = np.zeros(room + 1, np.int64)
    kept = []
    for i, size in enumerate(sizes):
        rest, lot = int(min(left[i], room // size)), 1
        while rest > 0:  # lots of 1, 2, 4, ... make every number up to the limit
            n = min(lot, rest)
            rest, lot = rest - n, lot * 2
            w = int(size) * n
            new = best.copy()
            np.maximum(best[w:], best[: room + 1 - w] + w, out=new[w:])
            kept.append((i, n, w, new > best))
            best = new
    out, c = np.zeros(len(sizes), np.int64), room
    for i, n, w, better in reversed(kept):
        if better[c]:
            out[i] += n
            c -= w
    return out


def _inverse(basis: np.ndarray) -> np.ndarray:
    """Inverse by Gauss-Jordan elimination: small, and free of the thread pools of linear algebra libraries."""
    n = len(basis)
    work = np.hstack([basis, np.eye(n)])
    for j in range(n):
        p = j + int(np.abs(work[j:, j]).argmax())
        if p != j:
            work[[j, p]] = work[[p, j]]
        work[j] /= work[j, j]
        factor = work[:, j].copy()
        factor[j] = 0
        rows = np.flatnonzero(factor)
        work[rows] -= factor[rows, None] * work[j]
    return work[:, n:]


def _first_patterns(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """A feasible start: patterns of the largest size left, filled best, each run until one of its sizes is used up.

    Every run ends a different size and holds none that ended before, so the patterns are a triangular basis.
    """
    m = len(sizes)
    basis, amounts, left = np.zeros((m, m)), np.zeros(m), counts.astype(float)
    alive = np.ones(m, bool)
    for _ in range(m):
        at = np.flatnonzero(alive)
        pattern = np.zeros(m)
        pattern[at[-1]] = 1
        room = capacity - int(sizes[at[-1]])
        # Sizes of which much is left are worth a little more, so no size ends early without need.
        much = left[at] / left[at].max()
        fill = priced_patterns(sizes[at] * (1 + 1e-3 * much), sizes[at], room)[0] if room >= sizes[at[0]] else 0
        pattern[at] += fill
        used = np.flatnonzero(pattern)
        ends = used[np.argmin(left[used] / pattern[used])]
        amounts[ends] = left[ends] / pattern[ends]
        basis[:, ends] = pattern
        left = np.maximum(left - amounts[ends] * pattern, 0)
        alive[ends] = False
    return basis, amounts


def cutting_stock(sizes: np.ndarray, counts: np.ndarray, capacity: int, gap: float = 1e-3,
                  rounds: int = 400) -> list[tuple[int, np.ndarray]]:
    """Patterns with their numbers of sequences, covering ``counts`` pieces of each of ``sizes`` (rising) exactly.

    The linear program over patterns is solved by column generation with a revised simplex, its solution is rounded down,
    and the rest is filled one sequence after the other: the largest piece left and the best fit beside it. Generation
    ends when no pattern can lower the number of sequences by more than ``gap``, or after ``rounds`` pricings: every basis
    on the way is a full solution.
    """
    m = len(sizes)
    basis, amounts = _first_patterns(sizes, counts, capacity)  # columns are patterns
    inverse = _inverse(basis)
    least = float(sizes @ counts) / capacity
    # Duals swing widely at first; pricing near the worth by size alone saves most rounds. A round that finds nothing
    # there prices with less and less of it, last with the true duals.
    by_size, smooth, pivots = sizes / capacity, 0.9, 0
    for _ in range(rounds):
        if amounts.sum() <= (1 + gap) * least:
            break
        duals = inverse.sum(axis=0)
        priced = False
        for pattern in priced_patterns(smooth * by_size + (1 - smooth) * duals, sizes, capacity, top=8):
            # The optimum is at least the present number of sequences divided by the best pattern's worth.
            if float(inverse.sum(axis=0) @ pattern) <= 1 + gap:
                continue
            step = inverse @ pattern
            rising = step > 1e-9
            ratio = np.where(rising, amounts / np.where(rising, step, 1), np.inf)
            out = int(ratio.argmin())
            amounts = np.maximum(amounts - ratio[out] * step, 0)
            amounts[out] = ratio[out]
            basis[:, out] = pattern
            row = inverse[out] / step[out]
            inverse -= np.outer(step, row)
            inverse[out] = row
            priced, pivots = True, pivots + 1
            if pivots % 256 == 0:
                inverse = _inverse(basis)
                amounts = np.maximum(inverse @ counts, 0)
        if not priced:
            if not smooth:
                break
            smooth = smooth / 2 if smooth > 0.1 else 0.0
    left = counts.astype(np.int64).copy()
    found: list[tuple[int, np.ndarray]] = []
    for j in np.argsort(-amounts):
        pattern = basis[:, j].astype(np.int64)
        used = pattern > 0
        n = int(min(np.floor(amounts[j] + 1e-9), (left[used] // pattern[used]).min()))
        if n > 0:
            found.append((n, pattern))
            left -= n * pattern
    while left.any():
        first = int(np.flatnonzero(left)[-1])
        pattern = np.zeros(m, np.int64)
        pattern[first] = 1
        pattern += best_fit(sizes, left - pattern, capacity - int(sizes[first]))
        used = pattern > 0
        n = int((left[used] // pattern[used]).min())
        found.append((n, pattern))
        left -= n * pattern
    return found


def _places(patterns: list[tuple[int, np.ndarray]], m: int) -> dict[str, np.ndarray]:
    """Runs of ranks: within a bin, ranks from ``rank`` on take ``copies`` places from ``slot`` in every sequence from ``sequence``."""
    rank = np.zeros(m, np.int64)
    runs, sequence = [], 0
    for n, pattern in patterns:
        slot = 0
        for i in np.flatnonzero(pattern)[::-1]:
            runs.append((i, rank[i], sequence, pattern[i], slot))
            rank[i] += n * pattern[i]
            slot += pattern[i]
        sequence += n
    runs.sort(key=lambda r: (r[0], r[1]))
    return {k: np.array([r[j] for r in runs], np.int64) for j, k in enumerate(("bin", "rank", "sequence", "copies", "slot"))}


def pack(
    docs: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    tokenizer: str = "byte_bpe_50k.json",
    capacity: int = 2048,
    end_id: int = 1,
    classes: int = 256,
    gap: float = 1e-3,
    rank_rows: int = 8192,
) -> DataFrame:
    """All documents packed into sequences of at most ``capacity`` ids; one row per piece.

    Columns: ``id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``. Each id of each
    document lies in one piece; the pieces of a sequence follow each other without a gap from offset 0.

    Where pieces have more than ``classes`` different lengths, lengths are rounded up to a common grain for planning; real
    lengths then leave less than a grain per piece unused. Null and empty texts are packed as one end id, repeated rows each
    for themselves, an empty table gives no rows; other columns are not read. Ranks are dealt per bin and hash bucket of
    about ``rank_rows`` rows, so a length that many documents share is spread over tasks.
    """
    pieces = store(cut_pieces(docs, id=id, text=text, tokenizer=tokenizer, capacity=capacity, end_id=end_id), "pieces")
    lengths = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    grain = 1 if len(lengths) <= classes else -(-capacity // classes)
    counts: dict[int, int] = {}
    for length, n in lengths.items():
        counts[-(-length // grain)] = counts.get(-(-length // grain), 0) + n
    bins = np.array(sorted(counts), np.int64)
    if not len(bins):
        return pieces.withColumns({"sequence_id": F.lit(0).cast("bigint"), "offset": F.lit(0).cast("bigint")})
    patterns = cutting_stock(bins, np.array([counts[b] for b in bins.tolist()]), capacity // grain, gap)
    runs = _places(patterns, len(bins))

    buckets = max(1, sum(lengths.values()) // rank_rows)
    order = [id, "start", "length", "ids_crc32", "doc_tokens"]
    dealt = pieces.withColumn("_bin", F.ceil(F.col("length") / grain).cast("bigint")).withColumn(
        "_bucket", F.pmod(F.xxhash64(F.lit("rank"), *[col(c) for c in order]), F.lit(buckets)).cast("int")
    )
    before = W.partitionBy("_bin").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = (
        dealt.groupBy("_bin", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .select("_bin", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    )
    ranked = (
        dealt.withColumn("_rank", F.row_number().over(W.partitionBy("_bin", "_bucket").orderBy(*[col(c) for c in order])) - 1)
        .join(bases, ["_bin", "_bucket"])
        .select(*[col(c) for c in order], "_bin", (F.col("_base") + F.col("_rank")).cast("bigint").alias("_rank"))
    )

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wide = int(runs["rank"].max()) + 2**40
        starts = runs["bin"] * wide + runs["rank"]
        for part in parts:
            b = np.searchsorted(bins, part["_bin"].to_numpy(np.int64))
            rank = part["_rank"].to_numpy(np.int64)
            r = np.searchsorted(starts, b * wide + rank, side="right") - 1
            n = rank - runs["rank"][r]
            out = part.drop(columns=["_bin", "_rank"])
            out["sequence_id"] = runs["sequence"][r] + n // runs["copies"][r]
            out["_slot"] = runs["slot"][r] + n % runs["copies"][r]
            yield out

    kind = pieces.schema[id].dataType.simpleString()
    placed = ranked.mapInPandas(
        place, f"`{id}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, _slot bigint"
    )
    ahead = W.partitionBy("sequence_id").orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0))).drop("_slot")
