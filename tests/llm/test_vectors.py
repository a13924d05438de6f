"""Vector operators against brute force, with unusable vectors, ties, copies and clashing columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.llm import neighbours, vector_dups

SCHEMA = "vec_id bigint, embedding array<float>, label int"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 20))
    x[50:90] = x[50] + 0.12 * rng.normal(size=(40, 20))  # a dense group
    x[90:100] = x[90]  # copies
    x[100] = 7 * x[90]
    rows = [(i, v.tolist(), int(i // 7 % 3) if i < 50 or i > 110 else 1) for i, v in enumerate(x.astype(np.float32))]
    bad = [(400, None, 1), (401, [0.0] * 20, 1), (402, [float("nan")] * 20, 1), (403, [None] * 20, 1), (404, [float("inf")] + [1.0] * 19, 1),
           (405, [1.0, 2.0], 1), (None, rows[90][1], 1), (406, rows[90][1], None), (407, rows[90][1], 2), (91, rows[91][1], 1)]
    return spark.createDataFrame(rows + bad, SCHEMA).withColumns({"w": F.lit(1), "rep": F.lit(2), "block": F.lit(3), "first": F.lit(4), "_id": F.lit(5)})


@pytest.mark.parametrize("block", [2048, 8])
def test_near_vectors(vectors, block):
    rows = vectors.select("vec_id", "embedding", "label").collect()
    use = [i for i, r in enumerate(rows) if r[0] is not None and r[0] < 400 or r[0] in (407,)]
    x = np.array([rows[i][1] for i in use], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([rows[i][2] for i in use])
    link = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    ids = np.array([rows[i][0] for i in use])
    root = ids.copy()
    for _ in range(len(ids)):
        root = np.array([root[link[i]].min() for i in range(len(ids))])
        for v in set(ids):
            root[ids == v] = root[ids == v].min()
    want = sorted((int(i), int(n) - 1, int(c), bool(i == c)) for i, n, c in zip(ids, link.sum(axis=1), root, strict=True))
    got = [tuple(r) for r in vector_dups.near_vectors(vectors, block=block).collect()]
    assert len(got) == len(rows)
    alone = {400, 401, 402, 403, 404, 405, 406, None}
    assert sorted(r for r in got if r[0] not in alone) == want
    assert all(r[1] == 0 and r[2] == r[0] and r[3] for r in got if r[0] in alone)
    assert vector_dups.near_vectors(vectors.limit(0)).count() == 0


def test_search(spark, vectors):
    found = neighbours.search(vectors, F.col("vec_id") % 20 == 0, k=20, share=1.0, shard_rows=100).collect()
    rows = [(r[0], np.array(r[1], float)) for r in vectors.select("vec_id", "embedding").collect() if r[0] is not None and (r[0] < 400 or r[0] in (406, 407))]
    for q, v in rows:
        if q % 20 == 0:
            want = sorted(((-float((v * x).sum()), i) for i, x in rows if i != q))[:20]
            got = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q)
            assert [r[1] for r in got] == [i for _, i in want]
            assert np.allclose([r[2] for r in got], [-s for s, _ in want])
    few = neighbours.search(vectors.filter("vec_id IN (20, 21, 22)"), F.col("vec_id") % 20 == 0)
    assert few.count() == 2
    assert neighbours.search(vectors.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_search_recall(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    pdf = table.toPandas()
    x, ids = np.array(pdf["embedding"].tolist(), float), pdf["vec_id"].to_numpy()
    found = neighbours.search(table, F.col("vec_id") % 20 == 0).toPandas()
    hits = total = 0
    for q, group in found.groupby("query_id"):
        s = x @ x[ids == q][0]
        best = [i for i in ids[np.lexsort((ids, -s))] if i != q][:20]
        hits, total = hits + len(set(best) & set(group["vec_id"])), total + len(best)
    assert hits / total >= 0.9


def test_three_lengths(spark):
    """Vectors of other lengths neither join a search nor end one."""
    rng = np.random.default_rng(11)
    rows = [(i, rng.normal(size=(5, 8, 9)[i % 3]).tolist(), i % 2) for i in range(120)]
    rows[9], rows[15] = (9, rows[3][1], 1), (15, rows[3][1], 1)
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    linked = {r["vec_id"]: r for r in vector_dups.near_vectors(table).collect()}
    found = neighbours.search(table, F.col("vec_id") % 20 == 0, share=1.0).collect()
    assert len(linked) == 120
    for i, v, g in rows:
        same = [(j, np.array(w)) for j, w, h in rows if len(w) == len(v) and j != i]
        v = np.array(v)
        near = [j for j, w in same if rows[j][2] == g and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93]
        assert linked[i]["n_links"] == len(near)
        if i % 20 == 0:
            want = [j for _, j in sorted((-float((v * w).sum()), j) for j, w in same)][:20]
            assert [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == i] == want


def test_few_copies(spark, monkeypatch):
    """Evenly spread vectors, which no cell prunes, go to few places each; crowded labels that cells prune give the same links."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(3000, 32))
    x[::10] = x[1::10] + 0.05 * rng.normal(size=(300, 32))
    table = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x.astype(np.float32))], SCHEMA)
    sent = []
    deal = vector_dups.block_pairs
    monkeypatch.setattr(vector_dups, "block_pairs", lambda *a: sent.append(deal(*a)) or sent[-1])
    got = sorted(tuple(r) for r in vector_dups.near_vectors(table).collect())
    assert sum(d.count() for d in sent) <= 2 * 3000
    unit = np.array([r[1] for r in table.orderBy("vec_id").collect()], float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    link = (unit @ unit.T >= 0.93) & (np.arange(3000) % 2 == np.arange(3000)[:, None] % 2)
    assert [r[1] for r in got] == (link.sum(axis=1) - 1).tolist()
    assert sorted(tuple(r) for r in vector_dups.near_vectors(table, whole=500).collect()) == got
    monkeypatch.setattr(vector_dups, "HELD", 3)
    # Vectors that lie close together, label by label: there the cells send less.
    far = np.zeros((400, 16))
    far[np.arange(400), np.arange(400) // 25] = 5.0
    tight = far + 0.02 * rng.normal(size=(400, 16))
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(tight.astype(np.float32))], SCHEMA)
    sent.clear()
    by_cells = sorted(tuple(r) for r in vector_dups.near_vectors(table, whole=4, block=100).collect())
    assert {r[0] for d in sent for r in d.select("block").distinct().collect()} == {0, 1}
    assert by_cells == sorted(tuple(r) for r in vector_dups.near_vectors(table).collect())
    assert {r[1] for r in by_cells} == {24}
