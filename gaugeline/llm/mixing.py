"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Targets: every source gets a share of the whole by its weight; one whose share passes ``max_epochs`` times its size is
clamped there and the excess is dealt to the others by weight, until none is above. Sorted by size per weight, the
clamped sources are a prefix, so running sums give the end state of these rounds directly.

Sampling: a source's target is taken as whole repetitions of all its documents and a fractional rest. The rest is the
first part of the source in a seeded hash order. Hash buckets keep running sums small: only within a bucket are documents
summed one after the other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col, sortable

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words: maximal runs without ASCII white space. Null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def water_fill(sources: DataFrame, *, weights: Sequence[float] = (5.0, 2.0, 1.0), max_epochs: float = 3.0,
               source: str = "source") -> DataFrame:
    """Targets of ``sources`` (``source``, ``source_size``): adds ``target`` (double).

    Weights repeat over the sources in code point order, null last. Targets add up to the sum of all sizes wherever
    the clamps allow. One row per source is expected (an aggregate); a source of size 0 gets 0.
    """
    place = F.row_number().over(W.orderBy(col(source).asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    # In this order the clamped sources come first; ``_level`` is the weight unit's worth once all before are clamped.
    # It rises over the clamped ones and falls after them, so its largest value is the final one.
    before = W.orderBy((F.col("_cap") / F.col("_w")).asc(), col(source).asc_nulls_last()).rowsBetween(
        W.unboundedPreceding, -1
    )
    everything = W.partitionBy()
    return (
        sources.withColumn("_w", F.element_at(cycle, (F.pmod(place, F.lit(len(weights))) + 1).cast("int")))
        .withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("_total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("_weights", F.sum("_w").over(everything))
        .withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
                    / (F.col("_weights") - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
        .withColumn("_level", F.max("_level").over(everything))
        .withColumn("target", F.least(F.col("_level") * F.col("_w"), F.col("_cap")))
        .drop("_w", "_cap", "_total", "_weights", "_level")
    )


def mix_sources(
    docs: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    max_epochs: float = 3.0,
    seed: int = 17,
    buckets: int = 4096,
    carry: Sequence[str] = (),
) -> DataFrame:
    """The mix: one row per document with ``size``, ``source_size``, ``target``, ``epochs`` (whole repetitions), ``part``
    (words of one more, partial repetition, taken from the start of the text) and ``taken`` words in all.

    A source takes exactly its rounded target. Null and empty texts have size 0 and are taken 0 times; a null source is
    a source of its own, last in order; repeated rows count each. The order within a source is a hash of ``seed``, id and
    text, so reruns agree. ``buckets`` (at most 4096) hash buckets a source bound the running sums; they only set where
    in the order a document stands.
    """
    extra = [sortable(F.col(f"_carry_{c}"), docs.schema[c].dataType) for c in carry]
    row_key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(col(id).cast("string"), F.lit("null")), F.md5(col(text)))
    rows = docs.select(
        col(id).alias("_id"), col(source).alias("_source"), word_count(col(text)).alias("size"), F.md5(row_key).alias("_h"),
        *[col(c).alias(f"_carry_{c}") for c in carry],
    )
    hashed = rows.withColumn("_bucket", (F.conv(F.substring("_h", 1, 3), 16, 10).cast("int") % buckets))
    sums = hashed.groupBy("_source", "_bucket").agg(F.sum("size").alias("_words"))
    targets = water_fill(
        sums.groupBy("_source").agg(F.sum("_words").alias("source_size")), weights=weights, max_epochs=max_epochs,
        source="_source",
    )
    earlier = W.partitionBy("_source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    spans = (
        sums.withColumn("_from", F.coalesce(F.sum("_words").over(earlier), F.lit(0)))
        .join(targets.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s")))
        .select(F.xxhash64(F.lit("span"), "_source", "_bucket").alias("_span"), F.col("_source").alias("_s"),
                F.col("_bucket").alias("_k"), "_from", "source_size", "target")
    )
    goal = F.floor(F.col("target") + 0.5).cast("bigint")
    placed = (
        hashed.withColumn("_span", F.xxhash64(F.lit("span"), "_source", "_bucket"))
        .join(spans, "_span")
        .filter(F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_k")))
        .withColumn("_at", F.col("_from") + F.sum("size").over(
            W.partitionBy("_span", "_source", "_bucket").orderBy("_h", "_id", "size", *extra)
            .rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("CAST(floor(target + 0.5) AS BIGINT) div source_size"))
                    .otherwise(F.lit(0)).cast("bigint"))
        .withColumn("_rest", goal - F.col("epochs") * F.col("source_size"))
        .withColumn("part", F.least(F.greatest(F.col("_rest") - F.col("_at"), F.lit(0)), F.col("size")))
        .withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))
    )
    return placed.select(
        F.col("_id").alias(id), F.col("_source").alias(source), "size", "source_size", "target", "epochs", "part", "taken",
        *[F.col(f"_carry_{c}").alias(c) for c in carry],
    )


def apply_mix(docs: DataFrame, *, id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``: each as often as it is taken whole, and where a partial
    repetition is due, once more with its text's first words, that many, joined by blanks. Documents without words go;
    columns of any name and type pass unchanged."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    whole = names[text]
    carry = [n for c, n in names.items() if c not in (id, source)]
    mixed = mix_sources(docs.toDF(*names.values()), id=names[id], text=whole, source=names[source], carry=carry, **options)
    copies = F.concat(
        F.array_repeat(F.lit(-1).cast("bigint"), F.when(F.col("size") > 0, F.col("epochs")).otherwise(0).cast("int")),
        F.when(F.col("part") > 0, F.array(F.col("part"))).otherwise(F.array().cast("array<bigint>")),
    )
    words = F.expr(f"array_join(slice(regexp_extract_all({whole}, '[^\\\\x20\\\\x09-\\\\x0D]+', 0), 1, CAST(_words AS INT)), ' ')")
    return (
        mixed.withColumn("_words", F.explode(copies))
        .withColumn(whole, F.when(F.col("_words") < 0, F.col(whole)).otherwise(words))
        .select(*[F.col(n).alias(c) for c, n in names.items()])
    )
