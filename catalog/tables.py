"""Reading and writing, sheet harmonisation, panel building and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.functions.columns import col
from gaugeline.functions.fixed_values import ANNUAL, MONTHS, STATISTICS
from gaugeline.functions.numbers import normalize_numbers
from gaugeline.functions.session import keep
from gaugeline.operators import iforest, kmeans, limits, panel
from gaugeline.operators.classify import load_model, save_model, train_forest
from gaugeline.operators.cluster import kmeans_fit, load_centroids
from gaugeline.operators.descriptive import Scaler
from gaugeline.sources import sheets, tables

from .base import (
    FEATS,
    IDS,
    LIMITS,
    LONG_FEATS,
    LONG_SQL,
    MULTI,
    PANEL_SQL,
    complete,
    long_stats,
    per_variable,
    q,
    rounded,
    scaled_panel,
    scratch,
    table,
    with_sql,
)
from .base import panel as load

ID_TYPES = {"supplier": "bigint", "Ano": "int", "Mes": "string", "Calc": "string"}


# --- sources and sinks ----------------------------------------------------------


def _locale(c: str, digits: int = 8) -> F.Column:
    """Number as text with comma decimals and dot thousands; gaps become a marker."""
    return F.coalesce(F.translate(F.format_number(col(c), digits), ",.", ".,"), F.lit("--"))


def read_observations(spark: SparkSession, sf: str) -> DataFrame:
    text = long_stats(spark, sf).select(
        *ID_TYPES, *[_locale(c).alias(c) for c in LONG_FEATS[:2]]
    )
    where = tables.write_table(text, "observations", scratch(spark, "io"), fmt="csv")
    # The third feature is absent from the file and comes back empty.
    return tables.read_observations(spark, where, LONG_FEATS, ID_TYPES, drop_empty=True)


READ_SQL = with_sql(
    LONG_SQL,
    body=f"""SELECT supplier, Ano, Mes, Calc, round({q(LONG_FEATS[0])}, 8) AS {q(LONG_FEATS[0])},
    round({q(LONG_FEATS[1])}, 8) AS {q(LONG_FEATS[1])}, CAST(NULL AS DOUBLE) AS {q(LONG_FEATS[2])}
    FROM long_stats""",
)


def conform(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "lineitem").select(
        *[F.col(c).cast("string").alias(c) for c in ("l_tax", "l_orderkey", "l_linenumber", "l_quantity")]
    )
    ids = {"l_orderkey": "bigint", "l_linenumber": "int"}
    return tables.conform(raw, ["l_quantity", "l_absent", "l_tax"], ids)


CONFORM_SQL = """SELECT l_orderkey, l_linenumber, CAST(l_quantity AS VARCHAR) AS l_quantity,
  CAST(NULL AS VARCHAR) AS l_absent, CAST(l_tax AS VARCHAR) AS l_tax FROM lineitem"""


def normalize(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    grouped = F.translate(F.format_number("l_extendedprice", 2), ",.", ".,")
    whole = F.translate(F.format_number(F.floor("l_extendedprice"), 0), ",", ".")
    text = lines.select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_linenumber") == 3, "--").otherwise(F.concat(F.lit(" "), grouped)).alias("price"),
        whole.alias("whole_price"),
        F.replace(F.col("l_quantity").cast("string"), F.lit("."), F.lit(",")).alias("quantity"),
        F.when(F.col("l_tax") == 0, "abc").otherwise(F.col("l_tax").cast("string")).alias("tax"),
    )
    return normalize_numbers(text, ["price", "whole_price", "quantity", "tax"])


NORMALIZE_SQL = """SELECT l_orderkey, l_linenumber,
  CASE WHEN l_linenumber = 3 THEN NULL ELSE round(l_extendedprice, 2) END AS price,
  floor(l_extendedprice) AS whole_price, l_quantity AS quantity,
  CASE WHEN l_tax = 0 THEN NULL ELSE l_tax END AS tax FROM lineitem"""


def drop_all_missing(spark: SparkSession, sf: str) -> DataFrame:
    sparse = ["tax_big", "max_price_lowdisc", "rev_R"]
    return tables.drop_all_missing(load(spark, sf), sparse).select(*IDS, *sparse)


def read_back(spark: SparkSession, sf: str) -> DataFrame:
    where = scratch(spark, "back")
    totals = load(spark, sf).groupBy("supplier").agg(F.count("*").alias("months"))
    tables.write_table(totals, "months", where, fmt="csv")
    assert tables.read_table(spark, "absent", where, fmt="csv", optional=True) is None
    return tables.read_table(spark, "months", where, fmt="csv").select(
        F.col("supplier").cast("bigint").alias("supplier"), F.col("months").cast("bigint").alias("months")
    )


def write_back(spark: SparkSession, sf: str) -> DataFrame:
    where = scratch(spark, "write")
    tables.write_table(load(spark, sf).select(*IDS, *MULTI), "panel", where)
    return tables.read_table(spark, "panel", where)


def scaler_back(spark: SparkSession, sf: str) -> DataFrame:
    where = scratch(spark, "scaler")
    Scaler.fit(load(spark, sf), MULTI).save(spark, where)
    again = Scaler.load(spark, where)
    return again.transform(load(spark, sf)).select(
        *IDS, *[F.round(c, 6).alias(c) for c in MULTI]
    )


SCALER_SQL = with_sql(
    PANEL_SQL,
    "st AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in MULTI) + " FROM panel)",
    body="SELECT supplier, month, "
    + ", ".join(f"{rounded(f'({c} - m_{c}) / s_{c}', 6)} AS {c}" for c in MULTI)
    + " FROM panel, st",
)


def models_back(spark: SparkSession, sf: str) -> DataFrame:
    """Saved and reloaded models score as the fitted ones do: no row may differ."""
    from pyspark.ml.functions import array_to_vector

    rows, where = scaled_panel(spark, sf), scratch(spark, "models")
    fit = kmeans_fit(rows, MULTI, 3)
    fit.save(spark, f"{where}/kmeans")
    features, centroids = load_centroids(spark, f"{where}/kmeans")
    labelled = kmeans.assign(fit.table, features, {"reloaded": centroids})
    # A classifier of the clusters stands for the Spark ML models.
    trained = train_forest(labelled, IDS, MULTI, "cluster", n_trees=10, folds=0)
    forest = iforest.IsolationForest().fit(rows, IDS, MULTI)
    forest.save(spark, f"{where}/forest")
    again = iforest.IsolationForestModel.load(spark, f"{where}/forest")
    both = again.score(forest.score(labelled, "before"), "after").withColumn("_v", array_to_vector(F.array(*MULTI)))
    models = {}
    if trained is not None:
        save_model(trained.model, f"{where}/classifier")
        models = {"class_before": trained.model, "class_after": load_model(f"{where}/classifier")}
    for name, model in models.items():
        both = model.transform(both).withColumnRenamed("prediction", name).drop("rawPrediction", "probability")
    differs = ~F.col("reloaded").eqNullSafe(F.col("cluster"))
    if models:
        differs = differs | ~F.col("class_after").eqNullSafe(F.col("class_before"))
    return both.agg(
        F.count("*").alias("n"),
        F.count_if(differs).alias("n_label_diff"),
        F.count_if(F.col("before") != F.col("after")).alias("n_score_diff"),
    )


MODELS_SQL = with_sql(
    PANEL_SQL,
    body=f"""SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_label_diff, CAST(0 AS BIGINT) AS n_score_diff
    FROM panel WHERE {complete(MULTI)}""",
)


# --- sheets -----------------------------------------------------------------------

SHEET_FEATS = ["COR(ppm Pt Co)", "TURB.(FTU)", "pH", "Fe(ppm Fe)"]
_SHEET_SOURCE = [LONG_FEATS[0], LONG_FEATS[1], LONG_FEATS[2]]


def sheet_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of cells: one page per supplier and year, built from the long statistics.

    Title row with the year, header row with changing spellings, the period only on the first of
    three statistic rows, a blank row per period, one column nobody knows.
    """
    long = long_stats(spark, sf)
    page = (F.col("supplier") * 10000 + F.col("Ano")).alias("page_id")
    month = F.coalesce(panel.month_number(F.col("Mes")), F.lit(13))
    stat = F.array_position(F.array(*[F.lit(s) for s in STATISTICS]), F.col("Calc")).cast("int")
    odd = F.col("supplier") % 2 == 1
    spelled = F.when(odd, F.get(F.array(F.lit("Mn."), F.lit("M?d."), F.lit("Máx.")), stat - 1)).otherwise(
        F.col("Calc")
    )
    period = F.when(stat == 1, F.concat(F.lit(" "), F.col("Mes"))).otherwise(F.lit(None).cast("string"))
    values = [_locale(c) for c in _SHEET_SOURCE]
    body = long.select(
        page,
        (month * 4 + stat).alias("row_no"),
        F.array(period, spelled, values[0], F.lit("x"), values[1], values[2]).alias("cells"),
    )
    blank = long.filter(F.col("Calc") == STATISTICS[0]).select(
        page, (month * 4 + 4).alias("row_no"), F.array(F.lit(None).cast("string"), F.lit("  ")).alias("cells")
    )
    pages = long.select(page, "supplier", "Ano").distinct()
    title = pages.select(
        "page_id",
        F.lit(0).alias("row_no"),
        F.array(F.lit(None).cast("string"), F.concat(F.lit("Water  Ano: "), F.col("Ano"))).alias("cells"),
    )
    header = pages.select(
        "page_id",
        F.lit(2).alias("row_no"),
        F.when(
            odd,
            F.array(F.lit("Mes"), F.lit(""), F.lit("COR\n(ppm Pt Co)"), F.lit("?"), F.lit("Turb. (FTU)"), F.lit("PH")),
        )
        .otherwise(
            F.array(F.lit("Mes"), F.lit(None).cast("string"), F.lit("COR (ppm PtCo)"), F.lit("Obs"), F.lit("TURB.(FTU)"), F.lit("pH")),
        )
        .alias("cells"),
    )
    return keep(title.unionByName(header).unionByName(body).unionByName(blank))


def page_keys(spark: SparkSession, sf: str) -> DataFrame:
    return sheets.extract_page_key(sheet_cells(spark, sf))


def header_rows(spark: SparkSession, sf: str) -> DataFrame:
    return sheets.locate_header(sheet_cells(spark, sf)).select("page_id", "header_row")


def header_map(spark: SparkSession, sf: str) -> DataFrame:
    return sheets.map_headers(sheets.locate_header(sheet_cells(spark, sf)))


def stat_labels(spark: SparkSession, sf: str) -> DataFrame:
    cells = sheet_cells(spark, sf).filter(F.col("row_no") > 2)
    return cells.select("page_id", "row_no", sheets.normalize_stat(F.get("cells", 1)).alias("stat")).filter(
        F.col("stat").isNotNull()
    )


def filled_periods(spark: SparkSession, sf: str) -> DataFrame:
    rows = sheet_cells(spark, sf).filter(F.col("row_no") > 2)
    return sheets.fill_down_period(rows, chunk_rows=16).select("page_id", "row_no", "period")


def harmonised(spark: SparkSession, sf: str) -> DataFrame:
    return sheets.harmonise_sheets(sheet_cells(spark, sf), features=SHEET_FEATS)


def harmonised_totals(spark: SparkSession, sf: str) -> DataFrame:
    """All pages as one table: rows written per year."""
    done = sheets.union_sheets(sheet_cells(spark, sf), "all", scratch(spark, "sheets"), features=SHEET_FEATS)
    return spark.read.parquet(done.location).groupBy("year").agg(F.count("*").alias("n"))


def union_report(spark: SparkSession, sf: str) -> DataFrame:
    """What the write of the union counted, where some pages lost their title and some their header."""
    title, header = F.col("row_no") == 0, F.col("row_no") == 2
    supplier = F.floor(F.col("page_id") / 10000)
    cells = sheet_cells(spark, sf).filter(~(title & (supplier % 7 == 0)) & ~(header & (supplier % 5 == 0)))
    done = sheets.union_sheets(cells, "all", scratch(spark, "sheets"), features=SHEET_FEATS)
    return spark.createDataFrame(
        [(done.rows, done.pages, done.without_year, done.without_header)],
        "n_rows bigint, pages bigint, without_year bigint, without_header bigint",
    )


_PAGE = "supplier * 10000 + Ano AS page_id"
_MONTH_NO = "coalesce(list_position([" + ", ".join(f"'{m}'" for m in MONTHS) + "], Mes), 13)"
_STAT_NO = "list_position([" + ", ".join(f"'{s}'" for s in STATISTICS) + "], Calc)"
_ROW = f"CAST({_MONTH_NO} * 4 + {_STAT_NO} AS INTEGER) AS row_no"
# The spelling "M?d." loses its vowel and is still known; nothing else is lost.
SHEET_SQL = {
    "sh_01_extract_page_key": with_sql(LONG_SQL, body=f"SELECT DISTINCT {_PAGE}, Ano AS year FROM long_stats"),
    "sh_02_locate_header": with_sql(
        LONG_SQL, body=f"SELECT DISTINCT {_PAGE}, CAST(2 AS INTEGER) AS header_row FROM long_stats"
    ),
    "sh_03_map_headers": with_sql(
        LONG_SQL,
        body=f"""SELECT page_id, variable, CAST(position AS INTEGER) AS position
        FROM (SELECT DISTINCT {_PAGE} FROM long_stats),
        (VALUES ('COR(ppm Pt Co)', 2), ('TURB.(FTU)', 4), ('pH', 5)) AS v(variable, position)""",
    ),
    "sh_04_normalize_stat": with_sql(LONG_SQL, body=f"SELECT {_PAGE}, {_ROW}, Calc AS stat FROM long_stats"),
    "sh_05_fill_down_period": with_sql(
        LONG_SQL,
        body=f"""SELECT {_PAGE}, {_ROW}, Mes AS period FROM long_stats
        UNION ALL SELECT {_PAGE}, CAST({_MONTH_NO} * 4 + 4 AS INTEGER), Mes FROM long_stats
        WHERE Calc = '{STATISTICS[0]}'""",
    ),
    "sh_07_union_pages": with_sql(
        LONG_SQL, body="SELECT Ano AS year, count(*) AS n FROM long_stats GROUP BY 1"
    ),
    "sh_07_union_report": with_sql(
        LONG_SQL,
        body="""SELECT count(*) FILTER (supplier % 7 <> 0 AND supplier % 5 <> 0) AS n_rows,
        count(DISTINCT (supplier, Ano)) AS pages, count(DISTINCT (supplier, Ano)) FILTER (supplier % 7 = 0) AS without_year,
        count(DISTINCT (supplier, Ano)) FILTER (supplier % 7 <> 0 AND supplier % 5 = 0) AS without_header FROM long_stats""",
    ),
}


def harmonised_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Harmonised text parsed back to numbers."""
    return normalize_numbers(harmonised(spark, sf), SHEET_FEATS)


SHEET_SQL["sh_06_harmonise_sheets"] = with_sql(
    LONG_SQL,
    body=f"""SELECT {_PAGE}, {_ROW}, Ano AS year, Mes AS period, Calc AS stat,
    round({q(_SHEET_SOURCE[0])}, 8) AS "COR(ppm Pt Co)", round({q(_SHEET_SOURCE[1])}, 8) AS "TURB.(FTU)",
    round({q(_SHEET_SOURCE[2])}, 8) AS "pH", CAST(NULL AS DOUBLE) AS "Fe(ppm Fe)" FROM long_stats""",
)


# --- panel ------------------------------------------------------------------------


def select_stat(spark: SparkSession, sf: str) -> DataFrame:
    return panel.select_stat(long_stats(spark, sf), STATISTICS[2])


def build(spark: SparkSession, sf: str) -> DataFrame:
    out = panel.build_panel(long_stats(spark, sf), features=LONG_FEATS, keys=["supplier"])
    return out.withColumn("date", F.col("date").cast("string"))


def time_features(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"))
    return panel.add_time_features(orders).withColumn("date", F.col("date").cast("string"))


def sorted_panel(spark: SparkSession, sf: str) -> DataFrame:
    """First and last date of the sorted panel, and its columns in canonical order."""
    out = panel.build_panel(long_stats(spark, sf), features=LONG_FEATS, keys=["supplier"], sort=True)
    return out.select(
        F.monotonically_increasing_id().alias("place"), "date", F.lit(",".join(out.columns)).alias("columns")
    ).agg(
        F.min_by("date", "place").cast("string").alias("first_date"),
        F.max_by("date", "place").cast("string").alias("last_date"),
        F.count("*").alias("n"),
        F.max("columns").alias("columns"),
    )


def few_gaps(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf)
    return rows.select(*IDS, *panel.select_by_missing(rows, FEATS))


def complete_rows(spark: SparkSession, sf: str) -> DataFrame:
    return panel.complete_cases(load(spark, sf), MULTI).select(*IDS, *MULTI)


def expanded(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf)
    part = panel.complete_cases(rows, MULTI).withColumn("high", F.col("rev_open") > 250000)
    return panel.expand_flags(rows, part, IDS, ["high"]).select(*IDS, "high")


def leak_free(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf)
    _, used = limits.label_severity(rows, LIMITS)
    return rows.select(*IDS, *panel.drop_leaky(FEATS, used))


def confirmed_join(spark: SparkSession, sf: str) -> DataFrame:
    rows = limits.violation_count(load(spark, sf), LIMITS)
    confirmed = rows.filter("n_violations >= 2").select(*IDS, "n_violations")
    return panel.join_confirmed(load(spark, sf), confirmed, IDS, ["n_violations"], ["month", "supplier"]).select(
        *IDS, "n_violations", *FEATS
    )


def themes(spark: SparkSession, sf: str) -> DataFrame:
    groups = {"revenue": ["rev_open", "rev_R", "rev_A"], "price": ["min_price_taxed", "max_price_lowdisc"],
              "tax": ["wsum", "tax_big"]}
    return panel.group_summary(load(spark, sf), groups).withColumn("mean_missing", F.round("mean_missing", 6))


_THEME = "CASE WHEN variable IN ('rev_open','rev_R','rev_A') THEN 'revenue' WHEN variable IN ('wsum','tax_big') THEN 'tax' ELSE 'price' END"


# --- limits -----------------------------------------------------------------------


def violation_flags(spark: SparkSession, sf: str) -> DataFrame:
    return limits.limit_violations(load(spark, sf), LIMITS).select(
        *IDS, *[f"viol_{lim.variable}" for lim in LIMITS]
    )


def violation_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = limits.violation_count(load(spark, sf), LIMITS)
    return limits.violation_count(rows, LIMITS, exclude_indicative=True, name="n_strict").select(
        *IDS, "n_violations", "n_strict"
    )


def any_label(spark: SparkSession, sf: str) -> DataFrame:
    return limits.label_any(load(spark, sf), LIMITS)[0].select(*IDS, "inadequate")


def severity(spark: SparkSession, sf: str) -> DataFrame:
    return limits.label_severity(load(spark, sf), LIMITS)[0].select(*IDS, "severity_high")


def truth_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Ground truth per variable in long form; variables without a limit have none."""
    return limits.violation_detail(load(spark, sf), IDS, LIMITS).select(*IDS, "variable", "violates")


def detail(spark: SparkSession, sf: str) -> DataFrame:
    rows = limits.violation_count(load(spark, sf), LIMITS).filter("n_violations >= 2")
    return limits.violation_detail(rows, IDS, LIMITS)


def label_profile(spark: SparkSession, sf: str) -> DataFrame:
    rows = limits.violation_count(load(spark, sf), LIMITS)
    labelled, _ = limits.label_severity(rows, LIMITS)
    return limits.label_profile(labelled, "severity_high", "n_violations")


def viol_sql(lim: limits.Limit) -> str:
    parts = []
    if lim.low is not None:
        parts.append(f"{lim.variable} < {lim.low}")
    if lim.high is not None:
        parts.append(f"{lim.variable} > {lim.high}")
    return f"coalesce({' OR '.join(parts)}, false)"


COUNT_ALL = " + ".join(f"CAST({viol_sql(lim)} AS INTEGER)" for lim in LIMITS)
COUNT_STRICT = " + ".join(f"CAST({viol_sql(lim)} AS INTEGER)" for lim in LIMITS if not lim.indicative)
COUNTED_SQL = f"counted AS (SELECT *, CAST({COUNT_ALL} AS INTEGER) AS n_violations, CAST({COUNT_STRICT} AS INTEGER) AS n_strict FROM panel)"
_DETAIL = " UNION ALL ".join(
    f"SELECT supplier, month, '{lim.variable}' AS variable, {lim.variable} AS value, {viol_sql(lim)} AS violates, {str(lim.indicative).lower()} AS indicative, n_violations FROM counted"
    for lim in LIMITS
)

QUERIES = {
    "io_01_read_observations": read_observations,
    "io_02_conform": conform,
    "io_03_normalize_numbers": normalize,
    "io_04_drop_all_missing": drop_all_missing,
    "io_05_read_table": read_back,
    "io_06_write_table": write_back,
    "io_07_scaler_save_load": scaler_back,
    "io_08_model_save_load": models_back,
    "sh_01_extract_page_key": page_keys,
    "sh_02_locate_header": header_rows,
    "sh_03_map_headers": header_map,
    "sh_04_normalize_stat": stat_labels,
    "sh_05_fill_down_period": filled_periods,
    "sh_06_harmonise_sheets": harmonised_numbers,
    "sh_07_union_pages": harmonised_totals,
    "sh_07_union_report": union_report,
    "ft_01_select_stat": select_stat,
    "ft_02_build_panel": build,
    "ft_03_add_time_features": time_features,
    "ft_04_sorted_panel": sorted_panel,
    "ft_05_select_by_missing": few_gaps,
    "ft_06_complete_cases": complete_rows,
    "ft_07_expand_flags": expanded,
    "ft_08_drop_leaky": leak_free,
    "ft_09_join_confirmed": confirmed_join,
    "ft_10_group_summary": themes,
    "lm_01_limit_violations": violation_flags,
    "lm_02_violation_count": violation_counts,
    "lm_03_label_any": any_label,
    "lm_04_label_severity": severity,
    "lm_05_truth_vectors": truth_vectors,
    "lm_06_violation_detail": detail,
    "lm_07_label_profile": label_profile,
}

_PANEL_OUT = """SELECT CAST(make_date(Ano, m, 1) AS VARCHAR) AS date, supplier, Ano, Mes, CAST(m AS INTEGER) AS month_no,
  CAST((m + 2) // 3 AS INTEGER) AS quarter,
  CASE WHEN m IN (10, 11, 12, 1, 2, 3) THEN 'wet' ELSE 'dry' END AS season, """ + ", ".join(q(c) for c in LONG_FEATS)
_PANEL_FROM = f" FROM (SELECT *, list_position([{', '.join(chr(39) + m + chr(39) for m in MONTHS)}], Mes) AS m FROM long_stats WHERE Calc = '{STATISTICS[1]}' AND Mes <> '{ANNUAL}')"

ORACLES = {
    "io_01_read_observations": READ_SQL,
    "io_02_conform": CONFORM_SQL,
    "io_03_normalize_numbers": NORMALIZE_SQL,
    "io_04_drop_all_missing": with_sql(
        PANEL_SQL,
        body="""SELECT supplier, month, tax_big, max_price_lowdisc, rev_R FROM panel
        WHERE tax_big IS NOT NULL OR max_price_lowdisc IS NOT NULL OR rev_R IS NOT NULL""",
    ),
    "io_05_read_table": with_sql(
        PANEL_SQL, body="SELECT supplier, count(*) AS months FROM panel GROUP BY 1"
    ),
    "io_06_write_table": with_sql(PANEL_SQL, body=f"SELECT supplier, month, {', '.join(MULTI)} FROM panel"),
    "io_07_scaler_save_load": SCALER_SQL,
    "io_08_model_save_load": MODELS_SQL,
    **SHEET_SQL,
    "ft_01_select_stat": with_sql(
        LONG_SQL, body=f"SELECT * FROM long_stats WHERE Calc = '{STATISTICS[2]}' AND Mes <> '{ANNUAL}'"
    ),
    "ft_02_build_panel": with_sql(LONG_SQL, body=_PANEL_OUT + _PANEL_FROM),
    "ft_03_add_time_features": """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date,
      CAST(month(o_orderdate) AS INTEGER) AS month_no, CAST(quarter(o_orderdate) AS INTEGER) AS quarter,
      CASE WHEN month(o_orderdate) IN (10, 11, 12, 1, 2, 3) THEN 'wet' ELSE 'dry' END AS season FROM orders""",
    "ft_04_sorted_panel": with_sql(
        LONG_SQL,
        body=f"""SELECT min(date) AS first_date, max(date) AS last_date, count(*) AS n,
        'date,supplier,Ano,Mes,month_no,quarter,season,{",".join(LONG_FEATS)}' AS columns
        FROM ({_PANEL_OUT}{_PANEL_FROM})""",
    ),
    "ft_05_select_by_missing": with_sql(PANEL_SQL, body=f"SELECT supplier, month, {', '.join(MULTI)} FROM panel"),
    "ft_06_complete_cases": with_sql(
        PANEL_SQL, body=f"SELECT supplier, month, {', '.join(MULTI)} FROM panel WHERE {complete(MULTI)}"
    ),
    "ft_07_expand_flags": with_sql(
        PANEL_SQL,
        body=f"SELECT supplier, month, ({complete(MULTI)} AND coalesce(rev_open > 250000, false)) AS high FROM panel",
    ),
    "ft_08_drop_leaky": with_sql(PANEL_SQL, body="SELECT supplier, month, rev_A, tax_big FROM panel"),
    "ft_09_join_confirmed": with_sql(
        PANEL_SQL, COUNTED_SQL,
        body=f"SELECT supplier, month, n_violations, {', '.join(FEATS)} FROM counted WHERE n_violations >= 2",
    ),
    "ft_10_group_summary": with_sql(
        PANEL_SQL,
        f"v AS ({per_variable(FEATS, 'count({c}) AS observed, avg(CAST({c} IS NULL AS INTEGER)) AS missing')})",
        body=f"""SELECT {_THEME} AS theme, count(*) AS n_variables, CAST(sum(observed) AS BIGINT) AS n_observed,
        round(avg(missing), 6) AS mean_missing FROM v GROUP BY 1""",
    ),
    "lm_01_limit_violations": with_sql(
        PANEL_SQL,
        body="SELECT supplier, month, "
        + ", ".join(f"{viol_sql(lim)} AS viol_{lim.variable}" for lim in LIMITS) + " FROM panel",
    ),
    "lm_02_violation_count": with_sql(
        PANEL_SQL, COUNTED_SQL, body="SELECT supplier, month, n_violations, n_strict FROM counted"
    ),
    "lm_03_label_any": with_sql(
        PANEL_SQL, COUNTED_SQL,
        body="SELECT supplier, month, CAST(n_violations > 0 AS INTEGER) AS inadequate FROM counted",
    ),
    "lm_04_label_severity": with_sql(
        PANEL_SQL, COUNTED_SQL,
        body="""SELECT supplier, month,
        CAST(n_violations > (SELECT quantile_cont(n_violations, 0.5) FROM counted) AS INTEGER) AS severity_high
        FROM counted""",
    ),
    "lm_05_truth_vectors": with_sql(
        PANEL_SQL, COUNTED_SQL, body=f"SELECT supplier, month, variable, violates FROM ({_DETAIL})"
    ),
    "lm_06_violation_detail": with_sql(
        PANEL_SQL, COUNTED_SQL,
        body=f"""SELECT supplier, month, variable, value, violates, indicative FROM ({_DETAIL})
        WHERE n_violations >= 2""",
    ),
    "lm_07_label_profile": with_sql(
        PANEL_SQL, COUNTED_SQL,
        "t AS (SELECT min(n_violations) AS lo, max(n_violations) AS hi, quantile_cont(n_violations, 0.5) AS med FROM counted)",
        body="""SELECT CAST(n_violations > med AS INTEGER) AS severity_high, count(*) AS n,
        lo AS min_violations, med AS median_violations, hi AS max_violations
        FROM counted, t GROUP BY 1, 3, 4, 5""",
    ),
}
