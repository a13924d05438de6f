"""Token counts by a two-tier lookup on the map side.

A text is cut at blanks into units that no piece of the vocabulary crosses, so its token count is the sum of its units'
counts. The counts of the most frequent units travel to the workers in one compact table; other units are encoded where
they are met and kept in a bounded cache of the worker. No unit is shuffled; only each task's bounded list of frequent
units is, to build the table, over all documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col

_RUNS = re.compile(r" *[^ ]+| +")


def units_of(text: str) -> list[str]:
    """Units of a text for a piece model that marks word starts.

    A unit is a word with the blanks before it, less the one that the mark stands for; blanks that end the text are a
    unit of their own. The mark itself counts as a blank, as it does for the model.
    """
    if not text:
        return []
    if "▁" in text:
        text = text.replace("▁", " ")
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [u[1:] if u[-1] != " " else u for u in _RUNS.findall(" " + text)]


@lru_cache(maxsize=4)
def _model(name: str):
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=name if "/" in name else public_tokenizers.path(name))


class UnitLengths(dict):
    """Token count of a unit: the frequent table first, then a cache that is emptied when it holds ``limit`` more."""

    def __init__(self, model: str, frequent: dict[str, int], limit: int):
        super().__init__(frequent)
        self.model, self.frequent, self.limit = _model(model), frequent, limit + len(frequent)

    def __missing__(self, unit: str) -> int:
        if unit.strip(" "):
            n = len(self.model.encode(unit))
        else:
            n = len(self.model.encode("x" + unit)) - len(self.model.encode("x"))
        if len(self) >= self.limit:
            self.clear()
            self.update(self.frequent)
        if len(unit) <= 64:
            self[unit] = n
        return n


def frequent_units(docs: DataFrame, *, text: str = "text", size: int = 32_768, per_task: int = 16_384) -> list[str]:
    """The ``size`` most frequent units over all documents, most frequent first.

    Each task counts its units (dropping the rarest half whenever it holds ``16 * per_task``) and sends its
    ``per_task`` most frequent, so a unit rare everywhere may be miscounted; that only costs speed.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column(0):
                seen.update(u for u in units_of(t.as_py() or "") if len(u) <= 64)
                if len(seen) > 16 * per_task:
                    seen = Counter(dict(seen.most_common(8 * per_task)))
        top = seen.most_common(per_task)
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())],
                                         names=["unit", "n"])

    counted = docs.select(col(text).alias("_t")).mapInArrow(count, "unit string, n bigint")
    top = counted.groupBy("unit").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "unit").limit(size)
    return [r.unit for r in top.select("unit").collect()]


def count_tokens(
    docs: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    model: str = "piece_bpe_32k.model",
    table_size: int = 32_768,
    cache_size: int = 400_000,
) -> DataFrame:
    """``id``, ``n_bytes``, ``n_tokens`` per row, over whole texts; one row out per row in.

    Null and empty texts have no bytes and no tokens. Repeated rows are counted each; an empty table gives an empty
    result. Other columns are not read, so clashing names do no harm. ``table_size`` bounds the table sent to workers,
    ``cache_size`` each worker's cache; neither changes a count.
    """
    spark = docs.sparkSession
    units = frequent_units(docs, text=text, size=table_size)
    plain = UnitLengths(model, {}, 0)
    table = spark.sparkContext.broadcast(dict(zip(units, (plain.__missing__(u) for u in units), strict=True)))
    rows = docs.select(col(id).alias("_id"), F.coalesce(F.octet_length(col(text)), F.lit(0)).cast("bigint").alias("_b"),
                       col(text).alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = UnitLengths(model, table.value, cache_size)
        length = lengths.__getitem__
        for batch in batches:
            n = [sum(map(length, units_of(t.as_py() or ""))) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())],
                                             names=[id, "n_bytes", "n_tokens"])

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id}` {kind}, n_bytes bigint, n_tokens bigint")
