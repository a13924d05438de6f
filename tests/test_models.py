"""Clustering, classification, streaming use of fitted operators and whole runs."""

import numpy as np
import pandas as pd
import pytest
from conftest import frame
from pyspark.sql import Observation
from pyspark.sql import functions as F

from gaugeline.operators import classify, cluster, limits
from gaugeline.operators.descriptive import Scaler, pca_project
from gaugeline.operators.iforest import IsolationForest


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(-5, size=(50, 2)), rng.normal(5, size=(50, 2))])
    pdf = pd.DataFrame(x, columns=["u", "v"])
    pdf.insert(0, "id", np.arange(100))
    return frame(spark, pdf), x


def brute_silhouette(x, labels):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i, own in enumerate(labels):
        mine = labels == own
        if mine.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, mine].sum() / (mine.sum() - 1)
        b = min(d[i, labels == c].mean() for c in set(labels) if c != own)
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_two_blobs(blobs):
    df, x = blobs
    sweep = cluster.sweep_k(df, ["u", "v"], range(2, 6))
    rows = sweep.orderBy("k").collect()
    assert cluster.best_by_silhouette(sweep) == 2 and rows[0].silhouette > 0.5
    assert all(a.wcss >= b.wcss for a, b in zip(rows, rows[1:]))
    fit = cluster.kmeans_fit(df, ["u", "v"], 2)
    labels = fit.table.orderBy("id").toPandas().cluster.to_numpy()
    assert labels.tolist() == [0] * 50 + [1] * 50
    assert cluster.wcss(fit.table, ["u", "v"], "cluster", fit.centroids).first()[0] == pytest.approx(fit.wcss)


@pytest.mark.parametrize("block", [8192, 30])
def test_silhouette_is_exact(blobs, spark, block):
    df, x = blobs
    x = x.copy()
    x[10:40] = x[10]
    labels = np.arange(100) % 4
    labels[3] = 9
    pdf = pd.DataFrame(x, columns=["u", "v"]).assign(l=labels, one=0)
    got = cluster.silhouettes(frame(spark, pdf), ["u", "v"], ["l", "one"], block=block)
    assert got["l"] == pytest.approx(brute_silhouette(x, labels), abs=1e-6) and got["one"] is None


def test_silhouette_blocks_grow_with_the_table(blobs, spark, monkeypatch):
    """Rows are sent once per block: their copies must not grow with the table, and tiles keep tasks small."""
    assert [cluster._blocks(n, 8192) for n in (0, 8192, 80_000, 500_000, 5_000_000)] == [1, 1, 10, 20, 20]
    df, x = blobs
    monkeypatch.setattr(cluster, "BLOCKS", 2)
    monkeypatch.setattr(cluster, "TILE", 7)
    x = x.copy()
    x[10:20] = x[10] + 1e-9 * np.arange(10)[:, None]
    labels = np.arange(100) % 3
    pdf = pd.DataFrame(x, columns=["u", "v"]).assign(l=labels)
    assert cluster.silhouettes(frame(spark, pdf), ["u", "v"], ["l"], block=5)["l"] == pytest.approx(brute_silhouette(x, labels), abs=1e-9)
    sums = cluster._distance_sums(x[:60], x[60:], np.eye(3)[labels[:60]], np.eye(3)[labels[60:]], False)
    d = np.sqrt(((x[:60, None] - x[None, 60:]) ** 2).sum(-1))
    assert np.allclose(sums[0], d @ np.eye(3)[labels[60:]]) and np.allclose(sums[1], d.T @ np.eye(3)[labels[:60]])


def test_distance_sums_of_many_sets_of_columns(monkeypatch):
    """Few or many sets of clusters, weights, close points and tiles that end anywhere give the sums of every pair."""
    monkeypatch.setattr(cluster, "TILE_ROWS", 8)
    rng = np.random.default_rng(4)
    for tile, ks in ((200, (2, 3)), (31, (2, 3)), (31, (9, 8, 7))):
        monkeypatch.setattr(cluster, "TILE", tile)
        x, y = rng.normal(size=(90, 3)), rng.normal(size=(120, 3))
        y[5:25] = x[5:25] + 1e-9
        of_x, of_y = (
            np.concatenate([np.eye(k)[rng.integers(0, k, len(p))] for k in ks], axis=1) * rng.integers(1, 4, (len(p), 1)) for p in (x, y)
        )
        d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1))
        to_x, to_y = cluster._distance_sums(x, y, of_x, of_y, False)
        assert np.allclose(to_x, d @ of_y, rtol=1e-12) and np.allclose(to_y, d.T @ of_x, rtol=1e-12)
        own = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        assert np.allclose(cluster._distance_sums(x, x, of_x, of_x, True)[0], own @ of_x, rtol=1e-12)


def test_elbow_of_a_known_curve(spark):
    curve = [2492.20, 2137.0, 1959.0, 1803.0, 1690.0, 1592.0, 1515.0, 1440.0, 1381.58]
    df = spark.createDataFrame([(k, w) for k, w in enumerate(curve, 2)], "k int, wcss double")
    x = np.arange(2, 11)
    gap = abs((curve[-1] - curve[0]) * (x - 2) - 8 * (np.array(curve) - curve[0]))
    assert cluster.elbow(df).first().k == x[int(np.argmax(gap))]


def test_metrics_of_a_known_confusion(spark):
    rows = [(0, 0)] * 24 + [(0, 1)] * 2 + [(1, 0)] * 10 + [(1, 1)] * 3
    df = spark.createDataFrame(rows, "y int, p int")
    assert tuple(classify.classification_metrics(df, "y", "p").first()) == (0.6923, 0.6, 0.2308, 0.3333)
    grid = [tuple(r) for r in classify.confusion_matrix(df, "y", "p").collect()]
    assert grid == [("real_adequate", 24, 2), ("real_inadequate", 10, 3)]


def test_split_counts():
    assert classify.split_sizes({0: 126, 1: 66}, 0.2) == {0: 26, 1: 13}


def test_forest_and_split(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(192, 2))
    y = (x[:, 0] + rng.normal(scale=0.3, size=192) > 0.4).astype(int)
    pdf = pd.DataFrame(x, columns=["f.1", "g"]).assign(id=np.arange(192), y=y)
    df = frame(spark, pdf)
    got = classify.train_forest(df, ["id"], ["f.1", "g"], "y", n_trees=10, depth=4, folds=3)
    assert got.predictions.count() == 39 and got.metrics.first().accuracy > 0.7
    assert got.importances.first().variable == "f.1" and got.cv.count() == 3
    folds = classify.stratified_folds(df, ["id"], "y", 3).groupBy("y", "fold").count().toPandas()
    assert (folds.groupby("y")["count"].agg(lambda s: s.max() - s.min()) <= 1).all()
    assert classify.train_forest(df.withColumn("y", F.lit(1)), ["id"], ["g"], "y") is None


def test_forest_scores_after_an_observation(spark):
    """A session that has observed anything cannot be sent to a task; the model must not hold it."""
    seen = Observation()
    spark.range(9).observe(seen, F.count(F.lit(1)).alias("n")).count()
    df = spark.range(200).selectExpr("id", "cast(id % 7 as double) a", "cast(id % 5 as double) b", "cast(id % 7 > 3 as int) y")
    got = classify.train_forest(df, ["id"], ["a", "b"], "y", n_trees=3, depth=4, folds=2)
    assert got.predictions.filter("prediction <> y").count() == 0 and got.cv.count() == 2


def test_forest_rounds_have_few_tasks(spark, monkeypatch):
    """Each task sends counts for all open nodes, so tasks must not grow in number with the table's partitions; every fold is scored."""
    seen = []

    class Classifier:
        def fit(self, rows):
            seen.append((rows.rdd.getNumPartitions(), rows.count()))
            return real(1, 3, 2).fit(rows)

    real = classify._classifier
    monkeypatch.setattr(classify, "_classifier", lambda *a: Classifier())
    df = spark.range(400).selectExpr("id", "cast(id % 7 as double) a", "cast(id % 7 > 3 as int) y").repartition(300, "id")
    got = classify.cv_f1(df, ["id"], ["a"], "y").collect()
    assert [r.fold for r in got] == list(range(5)) and all(r.f1 == 1.0 for r in got)
    assert len(seen) == 5 and sum(n for _, n in seen) == 4 * 400
    assert {p for p, _ in seen} == {classify.TASKS_PER_CORE * spark.sparkContext.defaultParallelism}


def test_saved_models_score_as_the_fitted_ones(spark, sf):
    from catalog import tables
    from catalog.base import MULTI, scaled_panel

    got = tables.models_back(spark, sf).first()
    assert got.asDict() == {"n": scaled_panel(spark, sf).dropna(subset=MULTI).count(), "n_label_diff": 0, "n_score_diff": 0}


def test_scaler_and_projection(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(80, 3)) @ np.diag([3, 1, 0.1]) + 5
    pdf = pd.DataFrame(x, columns=["a.b", "c", "d"]).assign(flat=2.0, id=np.arange(80))
    df = frame(spark, pdf)
    scaler = Scaler.fit(df, ["a.b", "c", "d", "flat"])
    z = scaler.transform(df).toPandas()
    assert np.allclose(z["a.b"].std(ddof=0), 1) and (z.flat == 0).all()
    scaler.save(spark, str(tmp_path / "s"))
    assert Scaler.load(spark, str(tmp_path / "s")) == scaler
    assert np.allclose(scaler.inverse(scaler.transform(df)).orderBy("id").toPandas()["c"], pdf["c"])
    out, share = pca_project(df, ["a.b", "c", "d"], ["id"])
    s = np.linalg.svd((x - x.mean(0)) / x.std(0), compute_uv=False) ** 2
    assert np.allclose(share, (s / s.sum())[:2]) and out.columns == ["id", "pc1", "pc2"]


def test_fitted_operators_run_on_a_stream(spark, tmp_path, blobs):
    df, _ = blobs
    where = str(tmp_path / "in")
    df.write.parquet(where)
    scaler = Scaler.fit(df, ["u", "v"])
    model = IsolationForest(n_trees=10).fit(df, ["id"], ["u", "v"])
    stream = spark.readStream.schema(df.schema).parquet(where)
    marked = limits.violation_count(stream, (limits.Limit("u", None, 5.0),))
    query = (
        model.score(scaler.transform(marked)).writeStream.format("memory").queryName("marked")
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    got = spark.table("marked")
    assert got.count() == 100 and got.filter("iforest_score is null").count() == 0
    assert got.filter("n_violations = 1").count() == df.filter("u > 5").count()


def test_summary_query_reports_the_trained_run(spark, sf, monkeypatch):
    from catalog import learned
    from gaugeline.sources.tables import read_table

    out = []
    trained = learned._trained
    monkeypatch.setattr(learned, "_trained", lambda *a: out.append(trained(*a)) or out[-1])
    got = {(r.section, r.metric): r.value for r in learned.summary(spark, sf).collect()}
    folder, tables = out[0]
    best = tables["k_sweep"].orderBy(F.desc_nulls_last("silhouette"), "k").first()
    assert (got["k-means", "best_k"], got["k-means", "silhouette"]) == (best.k, best.silhouette)
    forest = tables["classifier_metrics"].first().asDict()
    assert {m: v for (s, m), v in got.items() if s == "random forest"} == forest
    calibrated = read_table(spark, "contamination_calibration", f"{folder}/tables").orderBy(F.desc("stability_jaccard"), "contamination").first()
    assert got["isolation forest", "calibrated_contamination"] == calibrated.contamination
    impact = {r["set"]: r.silhouette for r in read_table(spark, "imputation_impact", f"{folder}/tables").collect()}
    assert (got["imputation", "silhouette_complete"], got["imputation", "silhouette_imputed"]) == (impact["complete-case"], impact["imputed"])
