"""Files to tables: heads of files, counted unions, and the tables of the outlier study against their own operators."""

import numpy as np
import pandas as pd
import pytest

from conftest import frame
from gaugeline.operators.iforest import IsolationForest
from gaugeline.operators.limits import Limit
from gaugeline.plans import runs
from gaugeline.plans.manifest import Run, finished_tables
from gaugeline.sources import sheets, tables


def test_headers_in_any_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n3,4\n")
    (tmp_path / "b.csv").write_text("y,x,z\n5,6,7\n")
    (tmp_path / "c.csv").write_text("")
    got = tables.read_text_table(spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.select("x", "y", "z").collect()) == sorted([("1", "2", None), ("3", "4", None), ("6", "5", "7")], key=str)


def test_union_counts_itself(spark, tmp_path):
    def page(number, year=True, header=True):
        rows = [["Ano: 1999"]] if year else [["no year"]]
        rows += [["Mes", "", "COR (ppm PtCo)", "pH"]] if header else [["Mes"]]
        rows += [["Jan", "Mín.", "1", "2"], [None, "Méd.", "3", "4"], ["", " "]]
        return [(number, i, r) for i, r in enumerate(rows)]

    cells = [*page(1), *page(2, year=False), *page(3, header=False), *page(4, year=False, header=False), *page(5)]
    df = spark.createDataFrame(cells, "page_id int, row_no int, cells array<string>")
    done = sheets.union_sheets(df, "all", str(tmp_path))
    assert (done.rows, done.pages, done.without_year, done.without_header) == (4, 5, 2, 1)
    assert spark.read.parquet(done.location).count() == done.rows


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(4)
    n = 120
    pdf = pd.DataFrame({"id": range(n), **{c: rng.normal(size=n) for c in "abc"}})
    pdf.loc[:5, ["a", "b", "c"]] += 12
    pdf.loc[7:9, "a"] = np.nan
    return frame(spark, pdf).selectExpr("*", "2010 + cast(id / 12 as int) AS Ano", "make_date(2010 + cast(id / 12 as int), 1 + id % 12, 1) AS date")


def study(df, out, **kw):
    return runs.run_outlier_study(df, ["id"], str(out), list("abc"), [Limit("a", None, 5.0, False)], window=(2010, 2010),
                                  grid=[0.05], folds=2, forest=IsolationForest(n_trees=8), **kw)


@pytest.fixture(scope="module")
def whole(panel, tmp_path_factory):
    return study(panel, tmp_path_factory.mktemp("whole"))


def test_outlier_study_tables(panel, whole):
    assert sorted(map(str, whole["flags_per_variable"].collect())) == sorted(map(str, runs.variable_flags(panel, list("abc")).collect()))
    assert whole["flags_per_variable"].filter("variable = 'a'").first()["IQR"] >= 6
    confirmed = {r["id"]: r for r in whole["confirmed"].collect()}
    timeline = {r["id"]: r for r in whole["confirmed_timeline"].collect()}
    assert set(confirmed) == set(timeline) and confirmed
    for i, r in timeline.items():
        assert abs(r["at"] - (2010 + i // 12 + (i % 12) / 12)) < 1e-9 and r["n_methods"] == confirmed[i]["n_methods"]


def test_broken_study_goes_on(spark, panel, whole, tmp_path, monkeypatch):
    def rows(table):
        return sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in table.collect())

    calls = []
    real = runs.detector_flags
    monkeypatch.setattr(runs, "detector_flags", lambda *a, **k: calls.append(1) or real(*a, **k))
    with monkeypatch.context() as broken:
        broken.setattr(runs.compare, "category_counts", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            study(panel, tmp_path, resume="first")
    with pytest.raises(ValueError, match="no finished run"):
        finished_tables(spark, str(tmp_path))
    done = study(panel, tmp_path, resume="first")
    assert len(calls) == 1 and set(done) == set(whole)
    stored = finished_tables(spark, str(tmp_path))
    assert set(stored) == {*done, "flags"}
    for name, table in whole.items():
        assert rows(table) == rows(done[name]) == rows(stored[name])


def test_manifest(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    out = str(tmp_path)
    for name, settings, times in (("a", [1], 1), ("a", [1], 1), ("a", [2], 2), ("b", [2], 3), (None, [2], 4), (None, [2], 5)):
        run = Run(spark, out, name, settings)
        assert run.table("t", make).count() == 3 and len(made) == times
    with pytest.raises(ValueError, match="no finished run"):
        finished_tables(spark, out)
    run.finish()
    assert finished_tables(spark, out)["t"].count() == 3
