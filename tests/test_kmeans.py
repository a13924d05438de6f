"""K-means: the same result in any layout, no worse than the built-in one, and its rounds against brute force."""

import numpy as np
import pandas as pd
import pytest
from conftest import frame
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from catalog.base import embedding_columns
from gaugeline.operators import cluster, kmeans


def test_layouts_agree_and_cost_is_low(spark):
    rows, names = embedding_columns(spark, "/root/testdata/sf0.01")
    found = []
    for n in (3, 50):
        fit = cluster.kmeans_fit(rows.repartition(n, F.rand(n)), names, 6)
        labels = {r.vec_id: r.cluster for r in fit.table.select("vec_id", "cluster").collect()}
        found.append((fit.centroids, labels, fit.wcss))
    assert found[0][:2] == found[1][:2] and found[0][2] == pytest.approx(found[1][2], rel=1e-12)
    vectors = rows.select(array_to_vector(F.array(*names)).alias("v"))
    builtin = KMeans(k=6, seed=42, featuresCol="v", maxIter=100).fit(vectors).summary.trainingCost
    assert found[0][2] <= builtin * 1.01


def test_copies_gaps_and_few_rows(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(60, 2)), np.full((90, 2), 7.0), [[-0.0, 0.0], [0.0, 0.0]]])
    pdf = pd.DataFrame(x, columns=["a b", "v"]).assign(id=range(len(x)))
    pdf.loc[3, "v"], pdf.loc[4, "a b"] = np.nan, np.inf
    df = frame(spark, pdf)
    points, weights, largest = kmeans.coreset(df, ["a b", "v"])
    assert len(points) == 60 - 2 + 1 + 1 and weights.max() == 90 and largest == 7.0
    few, _, _ = kmeans.coreset(df.repartition(7), ["a b", "v"], size=10)
    again, _, _ = kmeans.coreset(df.repartition(2), ["a b", "v"], size=10)
    assert few.shape == (10, 2) and (few == again).all()
    fit = cluster.kmeans_fit(df, ["a b", "v"], 2)
    got = fit.table.orderBy("id").toPandas()
    assert got.cluster.isna().tolist() == [i in (3, 4) for i in range(len(x))] and (got.cluster[60:150] == 1).all()
    same = cluster.kmeans_fit(df.filter("id >= 60"), ["a b", "v"], 5)
    assert same.centroids == [[0.0, 0.0], [7.0, 7.0]] and same.wcss == 0
    none = cluster.kmeans_fit(df.limit(0), ["a b", "v"], 2)
    assert none.centroids == [] and none.table.count() == 0


def test_step_and_saved_centroids(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3)) * [1, 1e3, 1e-3]
    df = frame(spark, pd.DataFrame(x, columns=list("uvw")))
    start = x[:4]
    own = ((x[:, None] - start) ** 2).sum(2).argmin(1)
    got = kmeans.lloyd_step(df, list("uvw"), start).orderBy("cluster").toPandas()
    assert got.n.tolist() == np.bincount(own, minlength=4).tolist()
    want = np.stack([x[own == i].mean(0) for i in range(4)])
    assert np.abs(got[list("uvw")].to_numpy() - want).max() < 1e-9
    fit = cluster.kmeans_fit(df, list("uvw"), 3)
    fit.save(spark, str(tmp_path / "k"))
    names, centres = cluster.load_centroids(spark, str(tmp_path / "k"))
    assert names == list("uvw") and centres == fit.centroids
    far = kmeans.assign(df, names, {"again": centres})
    assert sorted(r.again for r in far.collect()) == sorted(r.cluster for r in fit.table.collect())


def test_clusters_of_all_labels_are_counted_in_one_job(spark):
    """Labels of one type are counted together, NULL included and in their order; a round of k-means plans no query."""
    rows = [(float(i), i % 3 if i % 5 else None, i % 2, "ab"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "u double, `a` int, `b.c` int, s string")
    queries = []
    counting = type(df).collect

    def counted(self):
        queries.append(self)
        return counting(self)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(df), "collect", counted)
        sizes = cluster._cluster_sizes(df, ["a", "b.c", "s"])
        assert len(queries) == 2
        blocks = kmeans._packed(df.select("u"))
        for _ in range(3):
            assert kmeans._pass(blocks, 1, {2: np.array([[0.0], [40.0]])}, 59.0)[2][0].tolist() == [21, 39]
        assert len(queries) == 2
    assert list(sizes["a"].items()) == [(None, 12), (0, 16), (1, 16), (2, 16)]
    assert list(sizes["b.c"].items()) == [(0, 30), (1, 30)] and list(sizes["s"].items()) == [("a", 30), ("b", 30)]


def test_rounds_read_packed_rows(spark, monkeypatch):
    """Rounds read blocks of rows, which cut the rows anywhere, and need no shuffle."""
    monkeypatch.setattr(kmeans, "PACKED", 64)
    x = np.random.default_rng(6).normal(size=(1000, 2))
    rows = frame(spark, pd.DataFrame(x, columns=["u", "v"])).repartition(3)
    blocks = kmeans._packed(rows)
    assert 16 <= blocks.count() <= 22
    size, mean, cost = kmeans._pass(blocks, 2, {4: x[:4]}, float(np.abs(x).max()))[4]
    gaps = ((x[:, None] - x[:4]) ** 2).sum(2)
    own = gaps.argmin(1)
    assert size.tolist() == np.bincount(own).tolist() and cost == pytest.approx(gaps.min(1).sum())
    assert np.abs(mean - np.stack([x[own == i].mean(0) for i in range(4)])).max() < 1e-9
