"""Univariate rules, neighbours, forest and votes."""

import numpy as np
import pandas as pd
import pytest
from conftest import frame

from gaugeline.operators import ensemble, iforest, neighbors
from gaugeline.operators import univariate as u
from gaugeline.operators.medcouple import medcouple_values


def series(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, x double")


def marks(df, name):
    return [r[0] for r in df.orderBy("id").select(name).collect()]


def test_iqr_flags_only_the_extreme(spark):
    df = series(spark, [*map(float, range(1, 10)), 1000.0])
    assert marks(u.flag_iqr(df, ["x"]), "iqr_x") == [False] * 9 + [True]
    assert marks(u.flag_iqr(df, ["x"], min_obs=30), "iqr_x") == [False] * 10


def test_gaps_are_never_flagged(spark):
    out = marks(u.flag_iqr(series(spark, [1.0, 2.0, None, 4.0, float("nan")]), ["x"]), "iqr_x")
    assert None not in out and not out[2] and not out[4]


def test_zero_mad(spark):
    df = series(spark, [1.0] * 6 + [5.0, 9.0])
    assert not any(marks(u.flag_mad(df, ["x"]), "mad_x"))
    assert marks(u.flag_mad(df, ["x"], zero_mad="epsilon"), "mad_x") == [False] * 6 + [True] * 2


def test_most_extreme_takes_the_first_on_a_tie(spark):
    df = spark.createDataFrame([(1, 2.0, 2.0), (2, 0.0, 0.0), (3, 1.0, 1.0)], "id int, a double, b double")
    assert marks(u.most_extreme(df, ["a", "b"]), "top_variable") == ["a"] * 3


def brute_medcouple(x):
    x = x[~np.isnan(x)]
    m = np.median(x)
    a, b = x[x >= m][:, None], x[x <= m][None, :]
    ok = (a != b) & ~((a == m) & (b == m))
    h = ((a - m) - (m - b))[ok] / (a - b)[ok]
    return float(np.median(h)) if len(h) else 0.0


@pytest.mark.parametrize("limit", [50_000, 300])
def test_medcouple_matches_all_pairs(spark, limit):
    rng = np.random.default_rng(0)
    n = 900
    pdf = pd.DataFrame({
        "a.x": rng.normal(size=n), "skewed": rng.exponential(size=n),
        "grid": rng.integers(0, 7, n).astype(float),
        "hot": np.where(rng.random(n) < 0.4, 3.0, rng.lognormal(size=n)),
    })
    pdf.loc[:50, "skewed"] = np.nan
    got = medcouple_values(frame(spark, pdf), list(pdf), list_limit=limit)
    for c in pdf:
        assert got[c] == pytest.approx(brute_medcouple(pdf[c].to_numpy()), abs=1e-12), c


def test_medcouple_of_few_values(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0)], "x double, y double")
    assert medcouple_values(df, ["x", "y"]) == {"x": 0.0, "y": 0.0}


@pytest.fixture(scope="module")
def cloud(spark):
    """Three coordinates; a third of the rows are copies of one row."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(420, 3))
    x[:140] = x[0]
    x[300:304] = x[299]
    ids = rng.permutation(len(x))
    pdf = pd.DataFrame(x, columns=["a", "b.x", "c"])
    pdf.insert(0, "id", ids)
    d = np.sqrt(sum((x[:, None, i] - x[None, :, i]) ** 2 for i in range(3)))
    return frame(spark, pdf), ids, d


F3 = ["a", "b.x", "c"]


@pytest.mark.parametrize("alone", [True, False])
def test_knn_join_is_exact(cloud, alone):
    df, ids, d = cloud
    got = neighbors.knn_join(df, df, F3, 5, query_id="id", base_id="id", exclude_self=alone, cell_rows=40)
    got = got.toPandas().sort_values(["id", "rank"], ignore_index=True)
    want = []
    for i in range(len(ids)):
        near = sorted((d[i, j], ids[j]) for j in range(len(ids)) if not alone or j != i)[:5]
        want += [(ids[i], n) for _, n in near]
    want.sort(key=lambda r: r[0])
    assert list(zip(got["id"], got.neighbor_id)) == want


def test_knn_flags(cloud):
    df, ids, d = cloud
    got = neighbors.flag_knn(df, ["id"], F3, cell_rows=40).toPandas().set_index("id").loc[ids]
    score = np.sort(d, axis=1)[:, 5]
    assert np.allclose(got.knn_score, score, atol=1e-12)
    assert (got.flag_KNN.to_numpy() == (score > np.quantile(score, 0.93))).all()


def test_lof_scores(cloud):
    df, ids, d = cloud
    k, n = 20, len(ids)
    near = [sorted((d[i, j], ids[j], j) for j in range(n) if j != i)[:k] for i in range(n)]
    idx = np.array([[r[2] for r in row] for row in near])
    dist = np.array([[r[0] for r in row] for row in near])
    lrd = 1 / (np.maximum(dist, dist[:, -1][idx]).mean(1) + 1e-10)
    want = lrd[idx].mean(1) / lrd
    got = neighbors.lof_scores(df, ["id"], F3, cell_rows=40).toPandas().set_index("id").loc[ids]
    assert np.allclose(got.lof_score, want, rtol=1e-9)


def test_forest_finds_the_planted_point(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(100, 2))
    x[0] = 20
    pdf = pd.DataFrame(x, columns=["u", "v"])
    pdf.insert(0, "id", np.arange(100))
    df = frame(spark, pdf)
    found = iforest.detect_anomalies(df, ["id"], ["u", "v"], 0.05)
    table = found.table.toPandas().set_index("id")
    assert table.anomaly[0] and table.anomaly_score[0] < 0 and 0 < found.rate < 0.2
    assert (table.anomaly == (table.anomaly_score < 0)).all()
    again = iforest.detect_anomalies(df.repartition(5), ["id"], ["u", "v"], 0.05).table.toPandas()
    assert (again.set_index("id").anomaly_score.sort_index() == table.anomaly_score.sort_index()).all()
    detail = iforest.anomaly_details(found.table, df, ["id"], ["u", "v"]).collect()
    assert detail[0].id == 0 and len(detail) == table.anomaly.sum()


def test_forest_on_one_feature(spark):
    df = series(spark, [*map(float, range(60)), 1000.0])
    found = iforest.detect_anomalies(df, ["id"], ["x"], 0.02, forest=iforest.IsolationForest(n_trees=30))
    # The cut lies between the second and third lowest of 61 scores.
    marked = found.table.filter("anomaly").orderBy("anomaly_score").collect()
    assert len(marked) == 2 and marked[0].id == 60


def test_calibration_grid(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 3))
    x[:8] += 10
    pdf = pd.DataFrame(x, columns=list("abc"))
    pdf.insert(0, "id", np.arange(120))
    out = iforest.calibrate_contamination(
        frame(spark, pdf), ["id"], list("abc"), [0.05, 0.07, 0.10], folds=3,
        forest=iforest.IsolationForest(n_trees=50),
    ).collect()
    assert {r.contamination for r in out} == {0.05, 0.07, 0.10}
    assert all(0 <= r.stability_jaccard <= 1 and r.rate > 0 for r in out)
    assert [r.stability_jaccard for r in out] == sorted((r.stability_jaccard for r in out), reverse=True)


def test_filled_trees_give_the_paths_of_the_grown_ones():
    """All trees are walked in one layout; every row ends with the path of its leaf."""
    rng = np.random.default_rng(5)
    grown = [(t, *n) for t in range(9) for n in iforest.grow(np.round(rng.standard_normal((20, 2)), t % 3), np.random.default_rng(t))]
    model = iforest.IsolationForestModel(["a", "b"], 20, pd.DataFrame(grown, columns=["tree", "node", "feature", "cut", "below", "above", "path"]))
    x = np.vstack([np.round(rng.standard_normal((50, 2)), 1), [[np.inf, -np.inf]]])
    want = np.zeros(len(x))
    for t in range(9):
        nodes = model.nodes[model.nodes.tree == t].set_index("node")
        for i, row in enumerate(x):
            n = nodes.loc[0]
            while n.feature >= 0:
                n = nodes.loc[n.below if row[int(n.feature)] <= n.cut else n.above]
            want[i] += n.path
    assert (iforest.mean_path(x, *model.arrays(5)) == want / 9).all()


def test_calibration_counts_pairs_per_kind_of_row(spark):
    """Counts equal those of the single rows, also for a long grid and rows without a score."""
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.standard_normal((300, 2)), columns=["a", "b"]).assign(id=range(300))
    pdf.loc[:4, "a"] = np.nan
    grid, forest, folds = [round(0.01 * g, 2) for g in range(1, 36)], iforest.IsolationForest(6, 32), 3
    df = frame(spark, pdf)
    got = {r.contamination: r for r in iforest.calibrate_contamination(df, ["id"], ["a", "b"], grid, folds=folds, forest=forest).collect()}
    key = iforest.F.pmod(iforest.F.xxhash64("id", iforest.F.lit(forest.seed + 1)), iforest.F.lit(folds)).alias("fold")
    masks = [iforest.F.lit(True), *[iforest.F.col("fold") != f for f in range(folds)]]
    rows = df.select("*", key)
    scores = rows.select("fold", iforest.score_columns(forest.fit_many(rows, ["id"], ["a", "b"], masks)).alias("s")).toPandas()
    known = scores[scores.s.notna()]
    s, fold = -np.stack(known.s.to_list()), known.fold.to_numpy()
    for c in grid:
        marks = [s[:, 0] < np.quantile(s[:, 0], c)] + [s[:, f + 1] < np.quantile(s[fold != f, f + 1], c) for f in range(folds)]
        shares = [(marks[i] & marks[j]).sum() / max(1, (marks[i] | marks[j]).sum()) for i in range(1, 4) for j in range(i + 1, 4)]
        assert got[c].n_flags == marks[0].sum() and got[c].rate == round(marks[0].sum() / 300, 4)
        assert got[c].stability_jaccard == pytest.approx(np.mean(shares), abs=1e-4)


def test_votes_of_detectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(100, 3))
    x[:5] += 12
    pdf = pd.DataFrame(x, columns=list("abc"))
    pdf.insert(0, "id", np.arange(100))
    out = ensemble.ensemble_outliers(
        frame(spark, pdf), ["id"], list("abc"), forest=iforest.IsolationForest(n_trees=100)
    ).toPandas()
    assert len(out) == 100 and out.votes.between(0, 3).all()
    assert (out.outlier == (out.votes >= 2)).all() and out.outlier.sum() >= 1
    assert ensemble.anomaly_rate(spark.createDataFrame([], "f boolean"), "f").first().rate == 0.0


def test_one_search_serves_both_neighbour_detectors(spark):
    import numpy as np

    from gaugeline.operators.neighbors import knn_scores, lof_scores, self_search

    x = np.random.default_rng(3).normal(size=(60, 2))
    x[5] = x[6] = x[7]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id int, a double, b double")
    shared = self_search(df, ["id"], ["a", "b"], 12)
    for fn, k, name in ((knn_scores, 3, "knn_score"), (lof_scores, 8, "lof_score")):
        own = {r["id"]: r[name] for r in fn(df, ["id"], ["a", "b"], k).collect()}
        got = {r["id"]: r[name] for r in fn(df, ["id"], ["a", "b"], k, searched=shared).collect()}
        assert len(got) == 60 and all(abs(got[i] - own[i]) < 1e-9 for i in own)


def test_lof_deals_neighbours_once(spark):
    """Neighbours are dealt by their id in one shuffle for both joins, and densities are worked out once."""
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(np.random.default_rng(12).normal(size=(300, 3)))], "id int, a double, b double, c double")
    plan = neighbors.lof_scores(rows, ["id"], ["a", "b", "c"], 6)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "greatest(" not in plan
    assert plan.count("Exchange hashpartitioning(nid") - plan.count("REPARTITION_BY_NUM") <= 1  # the densities themselves
