"""The corpus pipeline and its stages: brute force on a small table, nulls, empty tables, columns of any name and type."""

import collections
import itertools
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gaugeline.llm import mixing, near_dups, secret_scan
from gaugeline.llm.common import read, store

STAGES = dict(corpus_pipeline.STAGES)


def shingled(text):
    """Counts of the five-word shingles of a text, by the operator's own shingle function."""
    _, hashes = near_dups.shingles([text], near_dups.WordHashes(), 5)
    return collections.Counter(hashes.tolist())


def alike(a, b):
    both, total = sum((a & b).values()), sum((a | b).values())
    return total > 0 and both >= 0.8 * total


def classes_by_force(rows):
    """Class of each id: what links of similarity 0.8 or equal texts connect, by all pairs."""
    texts = sorted({t for _, t in rows if t is not None})
    sets = [shingled(t) for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if alike(sets[i], sets[j]):
            root[top(i)] = top(j)
    place = {t: top(i) for i, t in enumerate(texts)}
    least = {}
    for i, t in rows:
        if t is not None:
            least[place[t]] = min(least.get(place[t], i), i)
    return {i: i if t is None else least[place[t]] for i, t in rows}


def test_near_duplicates_against_all_pairs(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text")
    more = docs.unionByName(docs.limit(30).select((F.col("doc_id") + 10**6).alias("doc_id"), F.concat("text", F.lit(" and one more end")).alias("text")))
    more = store(more, "pairs")
    rows = [(r["doc_id"], r["text"]) for r in more.collect()]
    got = near_dups.class_of_rows(more, near_dups.near_duplicates(more)).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == classes_by_force(rows)


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with nulls, copies and columns that bear the operators' own names, one of them a map."""
    long = " ".join(f"word{i % 97} item{i}" for i in range(400))
    rows = [(1, long, "a"), (2, long + " end", "a"), (2, long + " end", "a"), (3, None, "b"), (4, "", None), (None, "no id at all", "b"),
            (5, "password = Zx81kLq0vTn4Rw7YbC2d", "b"), (6, "a calm text of a few words", "c"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    return docs.withColumns({
        "_key": F.lit("k"), "_node": F.lit(7), "_kid": F.lit("kid"), "_row": F.lit(1.5), "_leak": F.lit("x"), "size": F.lit(3), "part": F.lit("p"),
        "_words": F.lit("w"), "taken": F.lit(2), "_carry_text": F.lit("c"), "c0": F.lit("d"), "tags": F.create_map(F.lit("m"), F.lit(1)),
    })


def test_stages_keep_columns_of_any_name(spark, sf, odd):
    docs, ids = odd, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = store(stage(spark, docs, sf), f"odd-{name}")
        assert docs.columns == odd.columns
        assert docs.schema.simpleString() == odd.schema.simpleString()
        rows = docs.collect()
        ids[name] = collections.Counter(r["doc_id"] for r in rows)
        for r in rows:
            assert (r["_key"], r["_node"], r["_kid"], r["_row"], r["_leak"], r["size"], r["part"], r["_words"], r["taken"], r["_carry_text"],
                    r["c0"], r["tags"]) == ("k", 7, "kid", 1.5, "x", 3, "p", "w", 2, "c", "d", {"m": 1})
    assert ids["toxicity"] == collections.Counter([1, 2, 2, 3, 4, 5, 6, None, None])
    assert ids["near_duplicates"] == collections.Counter([1, 3, 4, 5, 6, None, None])
    assert ids["secrets"] == collections.Counter([1, 3, 4, 6, None, None])
    assert set(ids["mixing"]) <= {1, 6, None}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.groupBy("doc_id").count().count() == len(ids["mixing"])


def test_stages_of_an_empty_table(spark, sf, odd):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd.limit(0), sf)
        assert out.count() == 0, name
        assert name == "packing" or out.columns == odd.columns


def test_run_against_brute_force(spark, sf):
    docs = read(spark, sf, "documents")
    clean = store(STAGES["toxicity"](spark, docs, sf), "run-clean")
    one = store(STAGES["near_duplicates"](spark, clean, sf), "run-one")
    of = classes_by_force([(r["doc_id"], r["text"]) for r in clean.select("doc_id", "text").collect()])
    assert sorted(r["doc_id"] for r in one.select("doc_id").collect()) == sorted(i for i, c in of.items() if i == c)
    safe = store(STAGES["secrets"](spark, one, sf), "run-safe")
    leaking = {r["doc_id"] for r in secret_scan.scan(one).filter("is_secret").select("doc_id").collect()}
    assert {r["doc_id"] for r in safe.select("doc_id").collect()} == {r["doc_id"] for r in one.select("doc_id").collect()} - leaking
    mixed = store(STAGES["mixing"](spark, safe, sf), "run-mixed")
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(safe).collect() if r["taken"]}
    got = collections.Counter()
    for r in mixed.select("doc_id", "text").collect():
        got[r["doc_id"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert dict(got) == taken
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in rows} == set(taken)
    held = collections.Counter()
    ends = collections.defaultdict(list)
    for r in rows:
        held[r["sequence_id"]] += r["length"]
        ends[r["sequence_id"]].append((r["offset"], r["length"]))
    assert max(held.values()) <= 2048
    for places in ends.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
