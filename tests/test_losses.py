"""Rows and values that must not be lost: headers, white space, gaps, clashing ids, far origins."""

import pytest
from pyspark.sql import functions as F

from gaugeline.operators.cluster import silhouettes
from gaugeline.operators.descriptive import box_stats
from gaugeline.operators.iforest import IsolationForest
from gaugeline.operators.neighbors import impute_knn, knn_join, knn_scores, lof_scores
from gaugeline.sources.sheets import fill_down_period
from gaugeline.sources.tables import read_text_table


def test_files_with_other_headers_are_read_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("A,B\n1,2\n")
    (tmp_path / "b.csv").write_text("B,A\n20,10\n")
    (tmp_path / "c.csv").write_text("A,C\n100,300\n")
    rows = {tuple(r[c] for c in "ABC") for r in read_text_table(spark, f"{tmp_path}/*.csv").collect()}
    assert rows == {("1", "2", None), ("10", "20", None), ("100", None, "300")}


def test_periods_with_any_white_space(spark):
    cells = [["Jan"], ["Fev\n"], ["\tMar"], [" "], [" Abr "]]
    rows = spark.createDataFrame([(1, i, c) for i, c in enumerate(cells)], "page_id int, row_no int, cells array<string>")
    got = [r["period"] for r in fill_down_period(rows, ["Jan", "Fev", "Mar", "Abr"]).orderBy("row_no").collect()]
    assert got == ["Jan", "Fev", "Mar", "Mar", "Abr"]


@pytest.fixture()
def points(spark):
    rows = [(i, float(i), None if i == 5 else float(i % 3)) for i in range(12)]
    return spark.createDataFrame(rows, "id int, a double, b double")


def test_rows_with_a_gap_keep_their_neighbours(points):
    near = knn_join(points, points, ["a", "b"], 2, query_id="id", base_id="id", exclude_self=True)
    assert near.select("id").distinct().count() == 12
    assert knn_scores(points, ["id"], ["a", "b"], 2).count() == 12
    assert lof_scores(points, ["id"], ["a", "b"], 3).count() == 12


def test_compound_ids_do_not_clash(spark):
    rows = [("x|y", "z", 0.0, 1.0), ("x", "y|z", 1.0, 2.0), ("x", None, 9.0, None), ("x", "\\N", 20.0, 4.0)]
    df = spark.createDataFrame(rows, "k string, l string, a double, b double")
    got = {(r["k"], r["l"]): r["knn_score"] for r in knn_scores(df, ["k", "l"], ["a"], 1).collect()}
    assert got == {("x|y", "z"): 1.0, ("x", "y|z"): 1.0, ("x", None): 8.0, ("x", "\\N"): 11.0}
    filled = {r["a"]: r["b"] for r in impute_knn(df, ["k", "l"], ["a", "b"], k=1).collect()}
    assert filled == {0.0: 1.0, 1.0: 2.0, 9.0: 2.0, 20.0: 4.0}


@pytest.mark.parametrize("method", ["exact", "squared"])
def test_silhouette_far_from_the_origin(spark, method):
    rows = [(g, g * 1.0 + 0.01 * i, 0.02 * (i % 4)) for g in (0, 1) for i in range(20)] + [(2, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "c int, x double, y double")
    far = df.withColumns({"x": F.col("x") + 1e6, "y": F.col("y") - 1e6})
    here = silhouettes(df, ["x", "y"], ["c"], method=method)["c"]
    assert silhouettes(far, ["x", "y"], ["c"], method=method)["c"] == pytest.approx(here, abs=1e-6)


def test_constant_variable_has_box_statistics(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(9)], "a double, b double")
    got = {r["variable"]: r["z_median"] for r in box_stats(df, ["a", "b"]).collect()}
    assert got["a"] is None and got["b"] == pytest.approx(0.0)


def test_forest_gives_no_score_to_a_gap(points):
    model = IsolationForest(n_trees=5).fit(points.filter("b IS NOT NULL"), ["id"], ["a", "b"])
    got = {r["id"]: r["iforest_score"] for r in model.score(points).collect()}
    assert got[5] is None and all(v is not None for i, v in got.items() if i != 5)


def test_annual_rows_are_no_coverage(spark):
    from gaugeline.operators.missing import coverage

    df = spark.createDataFrame([(2020, "Ano", 5.0), (2020, "Jan", None), (2021, "Jan", 1.0), (2021, None, None)], "y int, m string, a double")
    assert {r["y"]: r["a"] for r in coverage(df, ["a"], "y", month="m").collect()} == {2020: 0, 2021: 1}
    assert {r["y"]: r["a"] for r in coverage(df, ["a"], "y").collect()} == {2020: 1, 2021: 1}
