"""Agreement, scorecards, layers and confirmation."""

import pytest
from conftest import SF
from pyspark.sql import functions as F

from gaugeline.operators import compare as c
from gaugeline.operators import limits
from gaugeline.operators.panel import build_panel, drop_leaky, join_confirmed


def masks(spark, rows):
    return spark.createDataFrame(rows, "id int, a boolean, b boolean")


def test_jaccard_limits(spark):
    same = masks(spark, [(i, m, m) for i, m in enumerate([True, False, True, False])])
    apart = masks(spark, [(i, m, not m) for i, m in enumerate([True, False, True, False])])
    empty = masks(spark, [(1, False, None)])
    assert c.jaccard(same, "a", "b").first()[0] == 1.0
    assert c.jaccard(apart, "a", "b").first()[0] == 0.0
    assert c.jaccard(empty, "a", "b").first()[0] == 1.0


def test_scorecard_window(spark):
    rows = [(2013, True, False), (2014, True, True), (2015, False, True), (2017, False, False)]
    df = spark.createDataFrame(rows, "year int, a boolean, b boolean")
    card = {r.method: r for r in c.method_scorecard(df, {"A": "a", "B": "b"}, "year", target=0.25).collect()}
    assert card["A"].n_flags == 2 and card["A"].window_recall == 0.5 and card["A"].window_precision == 0.5
    assert card["B"].window_recall == 1.0 and card["B"].calibration_distance == 0.25
    assert card["A"].mean_agreement == pytest.approx(0.333)
    best = c.best_calibrated(c.method_scorecard(df, {"A": "a", "B": "b"}, "year", target=0.25), ["A", "B"])
    assert best.first().method == "A"


def test_layers(spark):
    rows = [(1, True, True, True), (2, True, False, True), (3, False, True, True),
            (4, False, False, True), (5, True, False, False), (6, False, False, False)]
    df = spark.createDataFrame(rows, "id int, u boolean, m boolean, full boolean")
    got = [r.category for r in c.classify_layers(df, "u", "m", "full").orderBy("id").collect()]
    assert got == ["strong", "uni_only", "multi_only", "clean", "uni_only", "incomplete"]
    counts = {r.category: r.n for r in c.category_counts(c.classify_layers(df, "u", "m", "full")).collect()}
    assert counts == {"strong": 1, "uni_only": 2, "multi_only": 1, "incomplete": 1, "clean": 1}


LIM = (limits.Limit("x.y", None, 5.0), limits.Limit("z", 1.0, 3.0), limits.Limit("fe", None, 0.3, True))


@pytest.fixture(scope="module")
def limited(spark):
    rows = [(1, 6.0, 2.0, 0.5), (2, None, 0.5, 0.1), (3, 5.0, 3.0, None), (4, 9.0, 4.0, 0.4)]
    return spark.createDataFrame(rows, "id int, `x.y` double, z double, fe double")


def test_limits(limited):
    n = [r.n_violations for r in limits.violation_count(limited, LIM).orderBy("id").collect()]
    strict = limits.violation_count(limited, LIM, exclude_indicative=True).orderBy("id").collect()
    assert n == [2, 1, 0, 3] and [r.n_violations for r in strict] == [1, 1, 0, 2]
    label, used = limits.label_any(limited, LIM)
    assert used == ["x.y", "z", "fe"] and [r.inadequate for r in label.orderBy("id").collect()] == [1, 1, 0, 1]
    severe, _ = limits.label_severity(limited, LIM)
    assert [r.severity_high for r in severe.orderBy("id").collect()] == [1, 0, 0, 1]
    assert drop_leaky(["a", "x.y", "b"], used) == ["a", "b"]


def test_limits_table(limited, spark):
    table = spark.createDataFrame([tuple(x) for x in LIM], "variable string, low double, high double, indicative boolean")
    assert limits.limits_from_table(table, ["fe", "z"]) == (LIM[2], LIM[1])
    with pytest.raises(ValueError):
        limits.limits_from_table(table.union(table), ["fe", "z"])


def test_confirmed_needs_votes_and_violation(limited):
    df = limited.selectExpr("*", "id <> 3 as f", "id <> 2 as g", "id > 2 as h")
    wide = c.outlier_wide(df, ["f", "g", "h"], LIM)
    flags = {"F": "f", "G": "g", "H": "h"}
    got = c.confirmed_outliers(wide, flags, min_methods=2).orderBy("id").collect()
    assert [(r.id, r.methods) for r in got] == [(1, "F, G"), (4, "F, G, H")]
    long = c.outlier_long(wide, ["id"], flags, ["z"]).collect()
    assert len(long) == sum(r.n_methods for r in wide.collect())
    joined = join_confirmed(limited, c.confirmed_outliers(wide, flags, min_methods=2), ["id"], ["n_methods"])
    assert {(r.id, r.n_methods) for r in joined.collect()} == {(1, 2), (4, 3)}


def test_few_observations_are_insufficient(limited):
    rows = c.best_method_per_variable(limited, ["x.y"], LIM).collect()
    assert {r.criterion for r in rows} == {"insufficient"} and not any(r.winner for r in rows)


def test_panel_shape(spark):
    rows = [(2010, m, s, 1.0) for m in ["Jan", "Abr", "Ano"] for s in ["Mín.", "Méd.", "Máx."]]
    df = spark.createDataFrame(rows, "Ano int, Mes string, Calc string, pH double")
    got = build_panel(df, features=["pH"], sort=True).collect()
    assert [(str(r.date), r.month_no, r.quarter, r.season) for r in got] == [
        ("2010-01-01", 1, 1, "wet"), ("2010-04-01", 4, 2, "dry")]


def test_registry_is_consistent(spark):
    import duckdb

    from __spark_entry__ import entry, oracle_sql, queries
    from catalog.check import normal

    q, o = queries(), oracle_sql()
    assert set(o) <= set(q)
    assert entry(spark).count() == 7
    duck = duckdb.connect()
    for t in ("lineitem", "orders", "events", "documents", "embeddings", "labels"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    import pandas as pd

    for name in ("io_03_normalize_numbers", "ft_02_build_panel", "ms_06_missing_summary", "ms_10_impute_knn",
                 "st_01_describe", "st_03_corr_spearman", "lm_04_label_severity", "ou_05_flag_mad",
                 "ou_08_flag_adjusted_box", "nn_02_flag_knn", "nn_03_flag_lof", "cm_07_method_scorecard",
                 "cl_03_silhouette", "cl_07_stratified_split"):
        cur = duck.execute(o[name])
        want = pd.DataFrame(cur.fetchall(), columns=[d[0] for d in cur.description], dtype=object)
        got = q[name](spark, SF).toPandas().astype(object)
        assert normal(got).equals(normal(want)), name


def test_pairs_counted_by_kind_of_row(spark):
    """Counts over kinds of rows equal those over the rows, unknown marks and empty tables included."""
    rows = [(a, b) for a in (True, False, None) for b in (True, False, None) for _ in range(1 + (a is None) + 2 * bool(b))]
    for some in (rows, []):
        df = spark.createDataFrame(some, "a boolean, b boolean")
        marks = {x: F.col(x) for x in ("a", "b")}
        kinds = df.groupBy("a", "b").agg(F.count("*").alias("n"))
        assert kinds.agg(*c._pair_counts(marks, c._rows_where)).first() == df.agg(*c._pair_counts(marks)).first()
