"""Detector comparison and consensus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.functions.session import keep
from gaugeline.operators import compare as c
from gaugeline.operators import univariate as u
from gaugeline.operators.descriptive import Scaler
from gaugeline.operators.ensemble import ensemble_outliers
from gaugeline.operators.panel import complete_cases, expand_flags

from .base import EVENT, FEATS, IDS, LIMITS, MULTI, PANEL_SQL, rnd, scaled_panel, with_sql
from .base import panel as load
from .detectors import (
    ADJ,
    ADJ_SQL,
    FOREST,
    IQR,
    MAD,
    MAD_SQL,
    MC_SQL,
    PCT,
    STAT_SQL,
    ZED,
    any_sql,
    rule,
)
from .tables import COUNT_ALL, COUNT_STRICT, viol_sql

FLAGS = {"IQR": "f_iqr", "MAD": "f_mad", "Z-score": "f_z", "Percentil": "f_pct"}


def flags(spark: SparkSession, sf: str) -> DataFrame:
    """Row flags of four univariate rules: any variable marked."""
    rows = load(spark, sf)
    p = u.Profile.fit(rows, FEATS, mad=True, tails=True)
    rules = {
        "f_iqr": [p.iqr(x) for x in FEATS],
        "f_mad": [p.robust_z(x) for x in FEATS],
        "f_z": [p.zscore(x, min_obs=30) for x in FEATS],
        "f_pct": [p.percentile(x, min_obs=30) for x in FEATS],
    }
    wide = rows.withColumns({f"{k}_{i}": e for k, es in rules.items() for i, e in enumerate(es)})
    for k in rules:
        wide = u.row_any(wide, [f"{k}_{i}" for i in range(len(FEATS))], k)
    return keep(wide.select(*rows.columns, *rules))


FLAG_SQL = f"""flags AS MATERIALIZED (SELECT supplier, month, year, month_no, {', '.join(FEATS)},
  {any_sql(IQR, k=1.5)} AS f_iqr, {any_sql(MAD)} AS f_mad, {any_sql(ZED)} AS f_z, {any_sql(PCT)} AS f_pct,
  CAST({COUNT_ALL} AS INTEGER) AS n_violations, CAST({COUNT_STRICT} AS INTEGER) AS n_violations_strict
  FROM panel, fs, md)"""
BASE = (PANEL_SQL, STAT_SQL, MAD_SQL, FLAG_SQL)


def jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(c.jaccard(flags(spark, sf), "f_iqr", "f_mad"), ["jaccard"], 6)


def matrix(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(c.jaccard_matrix(flags(spark, sf), FLAGS), ["jaccard"], 6)


def agreement(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(c.mean_agreement(flags(spark, sf), FLAGS), ["mean_agreement"], 6)


def card(spark: SparkSession, sf: str) -> DataFrame:
    return c.method_scorecard(flags(spark, sf), FLAGS, "year", window=EVENT)


def part_of_card(*names: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return card(spark, sf).select("method", *names)

    return run


def overlap(spark: SparkSession, sf: str) -> DataFrame:
    return c.overlap_regions(flags(spark, sf), ["f_iqr", "f_mad", "f_pct"])


def by_year(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(c.flag_rate_by_period(flags(spark, sf), FLAGS, "year"), list(FLAGS), 6)


def best(spark: SparkSession, sf: str) -> DataFrame:
    return c.best_calibrated(card(spark, sf), list(FLAGS)).select("method", "calibration_distance")


def f1(spark: SparkSession, sf: str) -> DataFrame:
    rows = c.outlier_wide(flags(spark, sf), [], LIMITS).withColumn("truth", F.col("n_violations_strict") >= 2)
    return rnd(c.flag_f1(rows, "f_mad", "truth"), ["precision", "recall", "f1"], 6)


def best_method(spark: SparkSession, sf: str) -> DataFrame:
    out = c.best_method_per_variable(load(spark, sf), FEATS, LIMITS)
    return rnd(out, ["score", "precision", "recall", "f1", "mean_jaccard"], 8)


def ranking(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(c.method_ranking(c.best_method_per_variable(load(spark, sf), FEATS, LIMITS)), ["score"], 8)


def score_matrix(spark: SparkSession, sf: str) -> DataFrame:
    out = c.method_matrix(c.best_method_per_variable(load(spark, sf), FEATS, LIMITS))
    return out.select("variable", *[F.round(F.col(f"`{m}`"), 8).alias(f"m{i}") for i, m in enumerate(u.METHODS)])


def layers(spark: SparkSession, sf: str) -> DataFrame:
    """Layers from two univariate rules against the two-vote majority on complete rows."""
    rows = flags(spark, sf).withColumns(
        {
            "uni": F.col("f_iqr") | F.col("f_mad"),
            "complete": F.col("rev_open").isNotNull() & F.col("min_price_taxed").isNotNull() & F.col("wsum").isNotNull(),
        }
    )
    whole = complete_cases(rows, MULTI).withColumn(
        "multi", F.col("f_z").cast("int") + F.col("f_pct").cast("int") + F.col("f_mad").cast("int") >= 2
    )
    return c.classify_layers(expand_flags(rows, whole, IDS, ["multi"]), "uni", "multi", "complete")


def categories(spark: SparkSession, sf: str) -> DataFrame:
    return layers(spark, sf).select(*IDS, "category")


def category_counts(spark: SparkSession, sf: str) -> DataFrame:
    return c.category_counts(layers(spark, sf))


def wide(spark: SparkSession, sf: str) -> DataFrame:
    rows = c.outlier_wide(flags(spark, sf), list(FLAGS.values()), LIMITS)
    return complete_cases(rows, MULTI)


def wide_out(spark: SparkSession, sf: str) -> DataFrame:
    return wide(spark, sf).select(
        *IDS, *MULTI, *FLAGS.values(), "n_methods", "n_violations", "n_violations_strict"
    )


def long_out(spark: SparkSession, sf: str) -> DataFrame:
    rows = wide(spark, sf)
    return c.outlier_long(rows, IDS, FLAGS, MULTI, Scaler.fit(rows, MULTI))


def confirmed(spark: SparkSession, sf: str) -> DataFrame:
    out = c.confirmed_outliers(wide(spark, sf), FLAGS, min_methods=3)
    return c.sort_confirmed(out, "month")


def confirmed_out(spark: SparkSession, sf: str) -> DataFrame:
    return confirmed(spark, sf).select(*IDS, "n_methods", "n_violations_strict", "methods")


def confirmed_by_detectors(spark: SparkSession, sf: str) -> DataFrame:
    """Six methods: two univariate rules, three detectors and their vote."""
    z = scaled_panel(spark, sf)
    votes = ensemble_outliers(z, IDS, MULTI, forest=FOREST).withColumnRenamed("outlier", "flag_vote")
    names = ["flag_IForest", "flag_LOF", "flag_KNN", "flag_vote"]
    rows = expand_flags(flags(spark, sf), votes, IDS, names)
    methods = {"IQR": "f_iqr", "MAD": "f_mad", "IForest": names[0], "LOF": names[1], "KNN": names[2], "Ensemble": names[3]}
    out = c.confirmed_outliers(c.outlier_wide(rows, list(methods.values()), LIMITS), methods)
    return out.select(*IDS, "n_methods", "n_violations", "n_violations_strict", "methods")


def both_counts(spark: SparkSession, sf: str) -> DataFrame:
    return c.violations_with_without(confirmed(spark, sf), IDS)


def timeline(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(c.confirmed_timeline(confirmed(spark, sf), "year", "month_no", ["supplier"]), ["at"], 6)


def counts(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(c.flag_counts(flags(spark, sf), FLAGS), ["pct", "expected"], 6)


QUERIES = {
    "cm_01_jaccard": jaccard,
    "cm_02_jaccard_matrix": matrix,
    "cm_03_mean_agreement": agreement,
    "cm_04_calibration_distance": part_of_card("calibration_distance"),
    "cm_05_window_recall": part_of_card("window_recall"),
    "cm_06_window_precision": part_of_card("window_precision"),
    "cm_07_method_scorecard": card,
    "cm_08_overlap_regions": overlap,
    "cm_09_flag_rate_by_period": by_year,
    "cm_10_best_calibrated": best,
    "cm_11_flag_f1": f1,
    "cm_12_best_method_per_variable": best_method,
    "cm_13_method_ranking": ranking,
    "cm_14_method_matrix": score_matrix,
    "cm_15_classify_layers": categories,
    "cm_16_category_counts": category_counts,
    "cm_17_outlier_wide": wide_out,
    "cm_18_outlier_long": long_out,
    "cm_19_confirmed_outliers": confirmed_out,
    "cm_19_confirmed_by_detectors": confirmed_by_detectors,
    "cm_20_violations_with_without": both_counts,
    "cm_21_confirmed_timeline": timeline,
    "cm_22_flag_counts": counts,
}


def _jac(a: str, b: str) -> str:
    return f"CASE WHEN count(*) FILTER (WHERE {a} OR {b}) = 0 THEN 1.0 ELSE count(*) FILTER (WHERE {a} AND {b}) / count(*) FILTER (WHERE {a} OR {b}) END"


MATRIX_SQL = "jm AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS method_a, '{n}' AS method_b, {_jac(a, b)} AS jaccard FROM flags"
    for m, a in FLAGS.items()
    for n, b in FLAGS.items()
) + ")"
_IN = f"year BETWEEN {EVENT[0]} AND {EVENT[1]}"
_CARD = " UNION ALL ".join(
    f"""SELECT '{m}' AS method, {i} AS place, count(*) FILTER (WHERE {f}) AS n_flags,
    round(avg(CAST({f} AS INTEGER)), 4) AS rate, round(abs(avg(CAST({f} AS INTEGER)) - 0.07), 4) AS calibration_distance,
    round(count(*) FILTER (WHERE {f} AND {_IN}) / count(*) FILTER (WHERE {_IN}), 3) AS window_recall,
    round(count(*) FILTER (WHERE {f} AND {_IN}) / count(*) FILTER (WHERE {f}), 3) AS window_precision,
    (SELECT round(avg(jaccard), 3) FROM jm WHERE method_a = '{m}' AND method_b <> '{m}') AS mean_agreement FROM flags"""
    for i, (m, f) in enumerate(FLAGS.items())
)
CARD_SQL = f"card AS ({_CARD})"


def card_sql(cols: str) -> str:
    return with_sql(*BASE, MATRIX_SQL, CARD_SQL, body=f"SELECT {cols} FROM card")


_TRUTH = {lim.variable: viol_sql(lim) for lim in LIMITS}
_RULES = [(m, t, k) for m, t, k in zip(u.METHODS, [IQR, IQR, ZED, MAD, PCT, ADJ], [{"k": 1.5}, {"k": 3.0}, {}, {}, {}, {}], strict=True)]
_MARKS = "marks AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT '{x}' AS variable, {x} IS NOT NULL AS present, {_TRUTH.get(x, 'false')} AS truth, {str(x in _TRUTH).lower()} AS limited, "
    + ", ".join(f"{rule(t, x, **k)} AS m{i}" for i, (_, t, k) in enumerate(_RULES))
    + " FROM panel, fs, md, adj"
    for x in FEATS
) + ")"
_ONE = " UNION ALL ".join(
    f"""SELECT variable, {i} AS place, '{m}' AS method, count(*) FILTER (WHERE present) AS n_obs,
    count(*) FILTER (WHERE truth) AS n_truth, any_value(limited) AS limited, count(*) FILTER (WHERE m{i}) AS n_flags,
    count(*) FILTER (WHERE m{i} AND truth) AS tp,
    ({' + '.join(_jac(f'm{min(i, j)}', f'm{max(i, j)}') for j in range(6) if j != i)}) / 5 AS jac FROM marks GROUP BY variable"""
    for i, (m, _, _) in enumerate(_RULES)
)
BEST_SQL = [
    PANEL_SQL, STAT_SQL, MAD_SQL, MC_SQL, ADJ_SQL, _MARKS, f"one AS ({_ONE})",
    "pr AS (SELECT *, CASE WHEN n_flags = 0 THEN 0 ELSE tp / n_flags END AS p, CASE WHEN n_truth = 0 THEN 0 ELSE tp / n_truth END AS r FROM one)",
    """sc AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS ff,
    CASE WHEN n_obs < 30 THEN 'insufficient' WHEN n_truth >= 1 THEN 'limit_f1' WHEN limited THEN 'jaccard_no_violation' ELSE 'jaccard' END AS criterion FROM pr)""",
    """bm AS (SELECT *, CASE criterion WHEN 'insufficient' THEN NULL WHEN 'limit_f1' THEN ff ELSE jac END AS score FROM sc)""",
    """best AS (SELECT *, score IS NOT NULL AND row_number() OVER (PARTITION BY variable ORDER BY score DESC, place) = 1 AS winner FROM bm)""",
]
_IF_F1 = "CASE WHEN criterion = 'limit_f1' THEN round({x}, 8) END"

LAYER_SQL = f"""layers AS (SELECT supplier, month, CASE WHEN NOT full_row AND uni THEN 'uni_only' WHEN NOT full_row THEN 'incomplete'
  WHEN uni AND multi THEN 'strong' WHEN uni THEN 'uni_only' WHEN multi THEN 'multi_only' ELSE 'clean' END AS category
  FROM (SELECT *, f_iqr OR f_mad AS uni, {' AND '.join(f'{x} IS NOT NULL' for x in MULTI)} AS full_row,
    CAST(f_z AS INTEGER) + CAST(f_pct AS INTEGER) + CAST(f_mad AS INTEGER) >= 2 AS multi FROM flags))"""
WIDE_SQL = f"""wide AS MATERIALIZED (SELECT *, {' + '.join(f'CAST({f} AS INTEGER)' for f in FLAGS.values())} AS n_methods
  FROM flags WHERE {' AND '.join(f'{x} IS NOT NULL' for x in MULTI)})"""
CONF_SQL = "conf AS (SELECT * FROM wide WHERE n_methods >= 3 AND n_violations_strict > 0)"
_TOP = ", ".join(f"{{'v': '{x}', 'x': {x}, 'z': ({x} - w_{x}) / t_{x}, 'p': {i}}}" for i, x in enumerate(MULTI))

ORACLES = {
    "cm_01_jaccard": with_sql(*BASE, body=f"SELECT round({_jac('f_iqr', 'f_mad')}, 6) AS jaccard FROM flags"),
    "cm_02_jaccard_matrix": with_sql(*BASE, MATRIX_SQL, body="SELECT method_a, method_b, round(jaccard, 6) AS jaccard FROM jm"),
    "cm_03_mean_agreement": with_sql(
        *BASE, MATRIX_SQL,
        body="SELECT method_a AS method, round(avg(jaccard), 6) AS mean_agreement FROM jm WHERE method_a <> method_b GROUP BY 1",
    ),
    "cm_04_calibration_distance": card_sql("method, calibration_distance"),
    "cm_05_window_recall": card_sql("method, window_recall"),
    "cm_06_window_precision": card_sql("method, window_precision"),
    "cm_07_method_scorecard": card_sql(
        "method, n_flags, rate, calibration_distance, window_recall, window_precision, mean_agreement"
    ),
    "cm_08_overlap_regions": with_sql(
        *BASE, body="SELECT f_iqr, f_mad, f_pct, count(*) AS n FROM flags GROUP BY 1, 2, 3"
    ),
    "cm_09_flag_rate_by_period": with_sql(
        *BASE,
        body="SELECT year, " + ", ".join(f'round(avg(CAST({f} AS INTEGER)), 6) AS "{m}"' for m, f in FLAGS.items()) + " FROM flags GROUP BY 1",
    ),
    "cm_10_best_calibrated": card_sql("method, calibration_distance") + " ORDER BY calibration_distance, place LIMIT 1",
    "cm_11_flag_f1": with_sql(
        *BASE,
        """n AS (SELECT count(*) FILTER (WHERE f_mad AND t) AS tp, count(*) FILTER (WHERE f_mad AND NOT t) AS fp,
        count(*) FILTER (WHERE NOT f_mad AND t) AS fn FROM (SELECT f_mad, n_violations_strict >= 2 AS t FROM flags))""",
        body="SELECT round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM n",
    ),
    "cm_12_best_method_per_variable": with_sql(
        *BEST_SQL,
        body=f"""SELECT variable, n_obs, method, criterion, winner, round(score, 8) AS score, n_flags,
        {_IF_F1.format(x='p')} AS precision, {_IF_F1.format(x='r')} AS recall, {_IF_F1.format(x='ff')} AS f1,
        CASE WHEN criterion LIKE 'jaccard%' THEN round(jac, 8) END AS mean_jaccard FROM best""",
    ),
    "cm_13_method_ranking": with_sql(
        *BEST_SQL, body="SELECT variable, method, criterion, round(score, 8) AS score FROM best WHERE winner"
    ),
    "cm_14_method_matrix": with_sql(
        *BEST_SQL,
        body="SELECT variable, " + ", ".join(f"max(round(score, 8)) FILTER (WHERE place = {i}) AS m{i}" for i in range(6)) + " FROM best GROUP BY 1",
    ),
    "cm_15_classify_layers": with_sql(*BASE, LAYER_SQL, body="SELECT supplier, month, category FROM layers"),
    "cm_16_category_counts": with_sql(
        *BASE, LAYER_SQL,
        body="""SELECT category, count(layers.supplier) AS n FROM (VALUES ('strong'), ('uni_only'), ('multi_only'), ('incomplete'), ('clean')) v(category)
        LEFT JOIN layers USING (category) GROUP BY 1""",
    ),
    "cm_17_outlier_wide": with_sql(
        *BASE, WIDE_SQL,
        body=f"SELECT supplier, month, {', '.join(MULTI)}, {', '.join(FLAGS.values())}, n_methods, n_violations, n_violations_strict FROM wide",
    ),
    "cm_18_outlier_long": with_sql(
        *BASE, WIDE_SQL,
        "w AS (SELECT " + ", ".join(f"avg({x}) AS w_{x}, stddev_pop({x}) AS t_{x}" for x in MULTI) + " FROM wide)",
        f"e AS (SELECT supplier, month, unnest([{_TOP}]) AS e FROM wide, w)",
        "r AS (SELECT supplier, month, e, row_number() OVER (PARTITION BY supplier, month ORDER BY abs(e.z) DESC, e.p) AS r FROM e)",
        body=" UNION ALL ".join(
            f"""SELECT supplier, month, '{m}' AS method, e.v AS top_variable, round(e.x, 3) AS top_value, round(e.z, 2) + 0.0 AS top_z,
            n_methods, n_violations FROM wide JOIN r USING (supplier, month) WHERE r = 1 AND {f}"""
            for m, f in FLAGS.items()
        ),
    ),
    "cm_19_confirmed_outliers": with_sql(
        *BASE, WIDE_SQL, CONF_SQL,
        body="SELECT supplier, month, n_methods, n_violations_strict, concat_ws(', ', "
        + ", ".join(f"CASE WHEN {f} THEN '{m}' END" for m, f in FLAGS.items())
        + ") AS methods FROM conf",
    ),
    "cm_20_violations_with_without": with_sql(
        *BASE, WIDE_SQL, CONF_SQL, body="SELECT supplier, month, n_violations, n_violations_strict FROM conf"
    ),
    "cm_21_confirmed_timeline": with_sql(
        *BASE, WIDE_SQL, CONF_SQL, body="SELECT supplier, round(year + (month_no - 1) / 12, 6) AS at, n_methods FROM conf"
    ),
    "cm_22_flag_counts": with_sql(
        *BASE,
        body=" UNION ALL ".join(
            f"SELECT '{m}' AS method, count(*) FILTER (WHERE {f}) AS n_flags, round(count(*) FILTER (WHERE {f}) / count(*) * 100, 6) AS pct, round(count(*) * 0.07::DOUBLE, 6) AS expected FROM flags"
            for m, f in FLAGS.items()
        ),
    ),
}
