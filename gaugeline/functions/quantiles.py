"""Exact quantiles of whole columns by radix selection.

A number's 64 bits, turned so that their order is the number's, are read from the front. A pass counts, for every
column and every bracket of values still in question, the values by their next digit; counts are added up inside each
task before a row is shuffled, and the digit that holds a wanted rank becomes the next bracket. Sixteen bits a pass make
four passes at most, for all columns and ranks together and whatever the values are (five or six where so many columns and
ranks are asked for that digits are shorter). A bracket of few rows is listed instead, which ends its search. Nothing is
sorted, sketched or sampled; tasks and driver hold a fixed number of counters, and a value that fills a large share of the
rows is one counter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Counters per bracket and pass.
COUNTERS = 65_536
#: A bracket of at most so many rows is listed by value.
LIST_ROWS = 262_144
#: Counters and listed values of a pass over all columns; digits get shorter where there are many brackets.
_IN_ALL = 2**21

_TOP = np.uint64(1 << 63)


def to_code(values: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the values: of 64-bit integers, or of doubles with -0 as 0 and NaN last."""
    if values.dtype.kind == "f":
        values = np.where(np.isnan(values), np.nan, values + 0.0)
        bits = values.view(np.int64)
        return np.where(bits < 0, ~bits.view(np.uint64), bits.view(np.uint64) | _TOP)
    return values.astype(np.int64).view(np.uint64) ^ _TOP


def from_code(code: int, floating: bool) -> float | int:
    """The value of a code."""
    if not floating:
        return code - 2**63
    bits = code - 2**63 if code >= 2**63 else 2**64 - 1 - code
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def _tally(df: DataFrame, columns: list[Column], brackets: list[list[tuple[int, int, bool]]], digit: int) -> DataFrame:
    """``c, g, d, n``: number of values by column, bracket and next digit (or whole code, where the bracket is listed).

    A bracket is the codes that start with ``known`` bits of ``prefix``.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense: dict[tuple[int, int], np.ndarray] = {}
        listed: dict[tuple[int, int], list] = {}
        for batch in batches:
            for c, groups in enumerate(brackets):
                column = batch.column(c).drop_null()
                if not groups or not len(column):
                    continue
                code = to_code(column.to_numpy(zero_copy_only=False))
                for g, (prefix, known, whole) in enumerate(groups):
                    mine = code[code >> np.uint64(64 - known) == np.uint64(prefix)] if known else code
                    if whole:
                        values, n = np.unique(mine, return_counts=True)
                        listed.setdefault((c, g), []).append((values, n))
                    else:
                        width = min(digit, 64 - known)
                        place = (mine >> np.uint64(64 - known - width) & np.uint64((1 << width) - 1)).astype(np.int64)
                        dense.setdefault((c, g), np.zeros(1 << width, np.int64))
                        dense[c, g] += np.bincount(place, minlength=1 << width)
        parts = []
        for key, counters in dense.items():
            at = np.flatnonzero(counters)
            parts.append((key, at.astype(np.int64), counters[at]))
        for key, found in listed.items():
            values, at = np.unique(np.concatenate([v for v, _ in found]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([m for _, m in found]), minlength=len(values)).astype(np.int64)
            parts.append((key, (values ^ _TOP).view(np.int64), n))
        for (c, g), place, n in parts:
            if len(n):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), c, np.int32)), pa.array(np.full(len(n), g, np.int32)), pa.array(place), pa.array(n)],
                    names=["c", "g", "d", "n"],
                )

    values = df.select(*[x.alias(f"v{i}") for i, x in enumerate(columns)])
    return values.mapInArrow(count, "c int, g int, d bigint, n bigint").groupBy("c", "g", "d").agg(F.sum("n").alias("n"))


def order_statistics(
    df: DataFrame,
    columns: dict[str, Column],
    ranks: dict[str, Sequence[int]],
    counts: dict[str, int],
    *,
    accuracy: int = COUNTERS,
    budget: int = LIST_ROWS,
) -> dict[tuple[str, int], float]:
    """Value at each zero-based rank of each column (NULLs are not ranked).

    ``accuracy`` is the number of counters per bracket and pass, ``budget`` the rows of a bracket that is listed.
    """
    digit = max(1, min(16, int(math.log2(accuracy))))
    labels = list(columns)
    whole_numbers = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    kinds = df.select(*[columns[x].alias(f"v{i}") for i, x in enumerate(labels)]).schema
    floating = {x: not isinstance(kinds[i].dataType, whole_numbers) for i, x in enumerate(labels)}
    casts = [columns[x].cast("double" if floating[x] else "bigint") for x in labels]
    found: dict[tuple[str, int], float] = {}
    # (prefix, known bits, ranked before the bracket, rows in the bracket)
    state = {
        (label, r): (0, 0, 0, counts[label]) for label, rs in ranks.items() for r in set(rs) if 0 <= r < counts[label]
    }
    while state:
        several = len({(label, s[0], s[1]) for (label, _), s in state.items()})
        width = max(1, min(digit, int(math.log2(max(2, _IN_ALL // several)))))
        short = min(budget, _IN_ALL // several)
        brackets: list[list[tuple[int, int, bool]]] = [[] for _ in labels]
        asked = {}
        for (label, r), (prefix, known, below, inside) in state.items():
            c = labels.index(label)
            bracket = (prefix, known, inside <= short)
            if bracket not in brackets[c]:
                brackets[c].append(bracket)
            asked[label, r] = (c, brackets[c].index(bracket), r - below)
        tally = _tally(df, casts, brackets, digit)
        # At most ``_IN_ALL`` counters, whatever the table's size.
        table = _tally(df, casts, brackets, width).toArrow().to_pandas().sort_values(["c", "g", "d"])
        groups = {key: (part["d"].to_numpy(), np.cumsum(part["n"].to_numpy())) for key, part in table.groupby(["c", "g"])}
        following = {}
        for (label, r), (c, g, at) in asked.items():
            digits, upto = groups[c, g]
            row = int(np.searchsorted(upto, at, side="right"))
            value, before = int(digits[row]), int(upto[row - 1]) if row else 0
            prefix, known, below, _ = state[label, r]
            if brackets[c][g][2]:
                found[label, r] = from_code(value + 2**63, floating[label])
                continue
            bits = min(width, 64 - known)
            prefix, known = prefix << bits | value, known + bits
            if known == 64:
                found[label, r] = from_code(prefix, floating[label])
            else:
                following[label, r] = (prefix, known, below + before, int(upto[row]) - before)
        state = following
    return found


def exact_quantiles(
    df: DataFrame,
    columns: dict[str, Column],
    probs: Sequence[float],
    *,
    counts: dict[str, int] | None = None,
    accuracy: int = COUNTERS,
    budget: int = LIST_ROWS,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of every column, ignoring NULLs.

    Returns, per label, one value per entry of ``probs`` (``None`` for an empty column).
    """
    if counts is None:
        labels = list(columns)
        row = df.agg(*[F.count(columns[lb]).alias(f"n{i}") for i, lb in enumerate(labels)]).first()
        counts = {lb: row[i] for i, lb in enumerate(labels)}
    places = {
        lb: [(p * (n - 1), math.floor(p * (n - 1)), math.ceil(p * (n - 1))) for p in probs]
        for lb, n in counts.items()
        if n
    }
    values = order_statistics(
        df,
        columns,
        {lb: [r for _, a, b in ps for r in (a, b)] for lb, ps in places.items()},
        counts,
        accuracy=accuracy,
        budget=budget,
    )
    out: dict[str, list[float | None]] = {lb: [None] * len(probs) for lb in columns}
    for lb, ps in places.items():
        out[lb] = [
            _blend(values[(lb, a)], values[(lb, b)], at - a) for at, a, b in ps
        ]
    return out


def _blend(a: float, b: float, share: float) -> float:
    return a if share == 0 or a == b else a + (b - a) * share


def medians(df: DataFrame, columns: dict[str, Column], **kw) -> dict[str, float | None]:
    return {k: v[0] for k, v in exact_quantiles(df, columns, [0.5], **kw).items()}
