"""Number parsing, reading, writing and sheets."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from gaugeline.functions.fixed_values import FEATURES
from gaugeline.functions.numbers import parse_locale_number
from gaugeline.sources import sheets, tables

CASES = {
    "3,23": 3.23, "23.000": 23000.0, "2.400.000": 2400000.0, "30.000,00": 30000.0, "7.2": 7.2,
    " 5 ": 5.0, "-3,5": -3.5, "1e3": 1000.0, "--": None, "---": None, "-": None, "": None,
    "1d": None, "NaN": None, "inf": None, "abc": None, "1,2,3": None,
}


def test_locale_numbers(spark):
    df = spark.createDataFrame([(k,) for k in [*CASES, None]], "s string")
    got = dict(df.select("s", parse_locale_number(F.col("s"))).collect())
    assert got == {**CASES, None: None}


def test_read_observations(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        'Ano,Mes,Calc,"pH",TURB.(FTU)\n2009,Jan,Méd.,"7,1",1.200\n2009,Fev,Méd.,--,\n', encoding="utf-8"
    )
    df = tables.read_observations(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["Ano", "Mes", "Calc", *FEATURES]
    assert dict(df.dtypes)["Ano"] == "int" and dict(df.dtypes)["pH"] == "double"
    first = df.filter("Mes = 'Jan'").first()
    assert first["pH"] == 7.1 and first["TURB.(FTU)"] == 1200.0 and first["F(ppm F)"] is None
    kept = tables.read_observations(spark, str(tmp_path / "a.csv"), drop_empty=True)
    assert [r.Mes for r in kept.collect()] == ["Jan"]
    with pytest.raises(AnalysisException):
        tables.read_observations(spark, str(tmp_path / "none.csv"))


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, 2.5), (2, None)], "id int, x double")
    tables.write_table(df, "t", str(tmp_path), fmt=fmt)
    again = tables.read_table(spark, "t", str(tmp_path), fmt=fmt)
    assert sorted(again.collect()) == sorted(df.collect())
    assert tables.read_table(spark, "missing", str(tmp_path), fmt=fmt, optional=True) is None


def page(page_id, rows):
    return [(page_id, i, r) for i, r in enumerate(rows)]


def test_sheets(spark):
    rows = page(1, [
        [None, "Rio  Ano: 2011"],
        ["", "", ""],
        ["Mes", "", "COR\n(ppm PtCo)", "TURB. (FTU)", "COR(ppm Pt Co)", "unknown"],
        [None, "Mín.", "9"],
        ["Jan", "Mín.", " 1 ", "2", "3", "4"],
        [None, "M?d.", "5", None, "6"],
        [None, "Max.", "7"],
        ["  ", None],
        ["note", "xyz", "8"],
        ["Ano", "Med.", "9", "10"],
    ]) + page(2, [["no year"], ["COR"], ["Jan", "Min.", "1"]]) + page(3, [["Ano: 2012"], ["Jan", "Min.", "1"]])
    df = spark.createDataFrame(rows, "page_id int, row_no int, cells array<string>")
    out = sheets.harmonise_sheets(df, features=["COR(ppm Pt Co)", "TURB.(FTU)", "pH"]).orderBy("row_no").collect()
    assert [tuple(r)[2:] for r in out] == [
        (2011, "Jan", "Mín.", "1", "2", ""),
        (2011, "Jan", "Méd.", "5", "", ""),
        (2011, "Jan", "Máx.", "7", "", ""),
        (2011, "Ano", "Méd.", "9", "10", ""),
    ]


def test_fill_down_does_not_depend_on_ranges(spark):
    names = ["Jan", None, None, "x", "Fev", None, None, None, None, "Mar", None]
    df = spark.createDataFrame([(1, i, [n]) for i, n in enumerate(names)], "page_id int, row_no int, cells array<string>")
    want = ["Jan"] * 4 + ["Fev"] * 5 + ["Mar"] * 2
    for size in (1, 3, 100):
        got = sheets.fill_down_period(df, chunk_rows=size).orderBy("row_no").collect()
        assert [r.period for r in got] == want


def test_lines_are_dealt_by_size(spark, monkeypatch):
    """Tasks grow in number with the table; equal keys stay together."""
    from catalog import base

    monkeypatch.setattr(base, "DEALT", 50)
    lines = base.dealt(spark.range(2000).withColumn("k", F.col("id") % 7), F.col("k"))
    assert lines.rdd.getNumPartitions() == 40
    assert lines.select("k", F.spark_partition_id()).distinct().count() == 7


def test_long_statistics_group_lines_dealt_once(spark, tmp_path, monkeypatch):
    """Months and years come from one shuffle, in tasks that grow in number with the table; missing keys are groups too."""
    import datetime

    from catalog import base

    monkeypatch.setattr(base, "LONG_DEALT", 50)
    rows = [
        (i % 9 or None, float(i % 50), i + 0.25, (i % 11) / 100, datetime.datetime(1995 + i % 3, 1 + i % 12, 3) if i % 13 else None)
        for i in range(2000)
    ]
    schema = "l_suppkey bigint, l_quantity double, l_extendedprice double, l_discount double, l_shipdate timestamp"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "lineitem.parquet"))
    found = base.long_stats(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() % 40 == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(") == plan.count("REPARTITION_BY_NUM") > 0
    groups = {}
    for supplier, quantity, _, _, date in rows:
        year, month = (date.year, base.MONTHS[date.month - 1]) if date else (None, None)
        for name in (month, base.ANNUAL):
            groups.setdefault((supplier, year, name), []).append(quantity)
    got = {(r.supplier, r.Ano, r.Mes, r.Calc): r["Qty.(u)"] for r in found.collect()}
    assert found.count() == len(got) == 3 * len(groups)
    for key, values in groups.items():
        want = (min(values), sum(values) / len(values), max(values))
        assert [got[(*key, c)] for c in base.STATISTICS] == pytest.approx(want)
