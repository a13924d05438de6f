"""Missing-data analysis and imputation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.operators import mcar as textbook
from gaugeline.operators import missing
from gaugeline.operators.cluster import imputation_cluster_impact
from gaugeline.operators.neighbors import impute, impute_knn

from .base import FEATS, IDS, KEPT, PANEL_SQL, pairs, per_variable, rnd, rounded, table, with_sql
from .base import panel as load

SIMPLE = ["rev_open", "wsum", "min_price_taxed"]
NEAR = ["rev_R", "rev_A", "max_price_lowdisc"]


def missing_rate(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(missing.missing_rate(load(spark, sf), FEATS), ["missing"], 6)


def coverage(spark: SparkSession, sf: str) -> DataFrame:
    return missing.coverage(load(spark, sf), FEATS, "year")


def missing_by_period(spark: SparkSession, sf: str) -> DataFrame:
    out = missing.missing_by_period(load(spark, sf), FEATS, "year")
    return rnd(out, [c for c in out.columns if c != "year"])


def missing_corr(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(missing.missing_corr(load(spark, sf), FEATS), ["corr"], 6)


def presence(spark: SparkSession, sf: str) -> DataFrame:
    return missing.presence_matrix(load(spark, sf), IDS, FEATS)


def summary(spark: SparkSession, sf: str) -> DataFrame:
    return missing.missing_summary(load(spark, sf), FEATS)


def decision(spark: SparkSession, sf: str) -> DataFrame:
    """Decision per document source from its share of short texts and the skew of its lengths."""
    docs = table(spark, sf, "documents")
    stats = docs.groupBy("lang", "source").agg(
        F.avg((F.col("n_chars") < 200).cast("double")).alias("fraction"),
        (F.skewness("n_chars") * F.sqrt(F.count("*") * (F.count("*") - 1.0)) / F.nullif(F.count("*") - 2, F.lit(0))).alias("skew"),
    )
    return stats.select(
        "lang", "source", missing.impute_decision(F.col("fraction"), F.col("skew")).alias("decision")
    )


def plan(spark: SparkSession, sf: str) -> DataFrame:
    got = missing.plan_imputation(load(spark, sf), FEATS)
    rows = [(d, i, c) for d in ("drop", "mean", "median", "knn") for i, c in enumerate(getattr(got, d))]
    return spark.createDataFrame(rows, "decision string, place int, variable string")


def simple_fill(spark: SparkSession, sf: str) -> DataFrame:
    out = missing.impute_simple(load(spark, sf), ["rev_open", "wsum"], ["min_price_taxed"])
    return rnd(out.select(*IDS, *SIMPLE), SIMPLE, 7)


def knn_fill(spark: SparkSession, sf: str) -> DataFrame:
    filled = missing.impute_simple(load(spark, sf), ["rev_open", "wsum"], ["min_price_taxed"])
    return rnd(impute_knn(filled, IDS, KEPT, targets=NEAR).select(*IDS, *NEAR), NEAR, 3)


def full_imputation(spark: SparkSession, sf: str) -> DataFrame:
    out, got = impute(load(spark, sf), IDS, FEATS)
    return rnd(out.select(*IDS, *sorted(got.kept)), sorted(got.kept), 3)


def validation(spark: SparkSession, sf: str) -> DataFrame:
    before = load(spark, sf)
    after, plan = impute(before, IDS, FEATS)
    return missing.validate_imputation(before, after, plan.kept)


def cluster_impact(spark: SparkSession, sf: str) -> DataFrame:
    before = load(spark, sf)
    after, plan = impute(before, IDS, FEATS)
    return imputation_cluster_impact(before, after, plan.kept)


def mcar(spark: SparkSession, sf: str) -> DataFrame:
    return missing.little_mcar(load(spark, sf), FEATS)


def mcar_em(spark: SparkSession, sf: str) -> DataFrame:
    """A complete variable and one with gaps: the likeliest moments have a closed form, which the SQL states."""
    return rnd(textbook.little_test(load(spark, sf), ["month_no", "rev_open"], min_observed=0.0).select("chi2", "df"), ["chi2"], 2)


def mcar_pairwise(spark: SparkSession, sf: str) -> DataFrame:
    out = textbook.little_test(load(spark, sf), ["rev_R", "rev_A"], moments="pairwise", min_observed=0.0)
    return rnd(out.select("chi2", "df"), ["chi2"], 2)


def patterns(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(missing.missing_patterns(load(spark, sf), FEATS), FEATS, 7)


SKEW_SQL = "CASE WHEN count({c}) > 2 THEN skewness({c}) END"
STATS_SQL = (
    "v AS ("
    + per_variable(FEATS, "{i} AS position, avg(CAST({c} IS NULL AS INTEGER)) AS fraction, " + SKEW_SQL + " AS skew")
    + ")"
)
DECIDE = """CASE WHEN fraction > 0.30 THEN 'drop' WHEN fraction >= 0.05 THEN 'knn'
  WHEN abs(skew) > 1 THEN 'median' ELSE 'mean' END"""


def _fill(c: str) -> str:
    agg = f"quantile_cont({c}, 0.5)" if c == "min_price_taxed" else f"avg({c})"
    return f"coalesce({c}, (SELECT {agg} FROM panel)) AS {c}"


FILLED_SQL = (
    "filled AS MATERIALIZED (SELECT supplier, month, "
    + ", ".join(_fill(c) for c in SIMPLE)
    + ", "
    + ", ".join(NEAR)
    + " FROM panel)"
)


def knn_sql(scaled: bool) -> list[str]:
    """CTEs computing ``n_<target>`` for all rows by brute force over all rows."""
    parts = []
    if scaled:
        stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in KEPT)
        parts.append(f"fs AS (SELECT {stats} FROM filled)")
        cols = ", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in KEPT)
        parts.append(f"sp AS MATERIALIZED (SELECT supplier, month, {cols} FROM filled, fs)")
    else:
        parts.append("sp AS (SELECT * FROM filled)")
    for t in NEAR:
        others = [c for c in KEPT if c != t]
        both = {c: f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in others}
        dist = " + ".join(
            both[c] if c in SIMPLE else f"coalesce({both[c]}, 0)" for c in others
        )
        shared = " + ".join(
            "1" if c in SIMPLE else f"CAST(a.{c} IS NOT NULL AND b.{c} IS NOT NULL AS INTEGER)"
            for c in others
        )
        parts.append(
            f"near_{t} AS (SELECT a.supplier, a.month, "
            f"min_by({{'d': d, 'v': v}}, d, 5) AS best FROM "
            f"(SELECT a.supplier, a.month, sqrt(({dist}) * ({len(KEPT)} * 1.0 / ({shared}))) AS d, b.{t} AS v "
            f"FROM sp a, sp b WHERE a.{t} IS NULL AND b.{t} IS NOT NULL) a GROUP BY 1, 2)"
        )
        parts.append(
            f"fill_{t} AS (SELECT supplier, month, CASE WHEN list_sum([CAST(x.d = 0 AS INTEGER) FOR x IN best]) > 0 "
            f"THEN list_avg([x.v FOR x IN best IF x.d = 0]) ELSE "
            f"list_sum([x.v / x.d FOR x IN best]) / list_sum([1 / x.d FOR x IN best]) END AS f FROM near_{t})"
        )
    return parts


def _near(t: str, scaled: bool, digits: int | None = 3) -> str:
    fill = f"(SELECT f FROM fill_{t} k WHERE k.supplier = p.supplier AND k.month = p.month)"
    if scaled:
        fill = f"({fill} * (SELECT s_{t} FROM fs) + (SELECT m_{t} FROM fs))"
    value = f"coalesce(p.{t}, {fill})"
    return f"{value if digits is None else rounded(value, digits)} AS {t}"


#: The panel after the whole imputation, as ``imputed``.
IMPUTED_SQL = [
    PANEL_SQL, FILLED_SQL, *knn_sql(True),
    "imputed AS MATERIALIZED (SELECT supplier, month, " + ", ".join([*SIMPLE, *[_near(t, True, None) for t in NEAR]]) + " FROM filled p)",
]


def _valid(c: str) -> str:
    return f"""SELECT '{c}' AS variable, avg(p.{c}) AS mb, avg(f.{c}) AS ma,
      quantile_cont(p.{c}, 0.5) AS qb, quantile_cont(f.{c}, 0.5) AS qa,
      stddev_samp(p.{c}) AS sb, stddev_samp(f.{c}) AS sa
      FROM panel p JOIN imputed f USING (supplier, month)"""


QUERIES = {
    "ms_01_missing_rate": missing_rate,
    "ms_02_coverage": coverage,
    "ms_03_missing_by_period": missing_by_period,
    "ms_04_missing_corr": missing_corr,
    "ms_05_presence_matrix": presence,
    "ms_06_missing_summary": summary,
    "ms_07_impute_decision": decision,
    "ms_08_imputation_plan": plan,
    "ms_09_impute_simple": simple_fill,
    "ms_10_impute_knn": knn_fill,
    "ms_11_impute": full_imputation,
    "ms_12_validate_imputation": validation,
    "ms_13_imputation_cluster_impact": cluster_impact,
    "ms_14_little_mcar": mcar,
    "ms_14_little_em": mcar_em,
    "ms_14_little_pairwise": mcar_pairwise,
    "ms_15_missing_patterns": patterns,
}

_CORR = [
    f"SELECT '{a}' AS var_a, '{b}' AS var_b, {rounded(f'corr(CAST({a} IS NULL AS INTEGER), CAST({b} IS NULL AS INTEGER))', 6)} AS corr FROM panel"
    for a, b in pairs(FEATS)
]

ORACLES = {
    "ms_01_missing_rate": with_sql(
        PANEL_SQL, body=per_variable(FEATS, "round(avg(CAST({c} IS NULL AS INTEGER)), 6) AS missing")
    ),
    "ms_02_coverage": with_sql(
        PANEL_SQL,
        body="SELECT year, "
        + ", ".join(f"max(CAST({c} IS NOT NULL AS INTEGER)) AS {c}" for c in FEATS)
        + " FROM panel GROUP BY 1",
    ),
    "ms_03_missing_by_period": with_sql(
        PANEL_SQL,
        body="SELECT year, "
        + ", ".join(
            f"round(avg(CAST({c} IS NULL AS INTEGER)) * 100, 4) AS {c}"
            for c in ["rev_open", "rev_R", "rev_A", "max_price_lowdisc", "tax_big"]
        )
        + " FROM panel GROUP BY 1",
    ),
    "ms_04_missing_corr": with_sql(PANEL_SQL, body=" UNION ALL ".join(_CORR)),
    "ms_05_presence_matrix": with_sql(
        PANEL_SQL,
        body="SELECT supplier, month, " + ", ".join(f"{c} IS NOT NULL AS {c}" for c in FEATS) + " FROM panel",
    ),
    "ms_06_missing_summary": with_sql(
        PANEL_SQL, STATS_SQL,
        body=f"SELECT variable, round(fraction * 100, 2) AS pct_missing, round(skew, 2) AS skew, {DECIDE} AS decision FROM v",
    ),
    "ms_07_impute_decision": f"""SELECT lang, source, {DECIDE} AS decision FROM (
      SELECT lang, source, avg(CAST(n_chars < 200 AS INTEGER)) AS fraction,
      CASE WHEN count(*) > 2 THEN skewness(n_chars) END AS skew FROM documents GROUP BY 1, 2)""",
    "ms_08_imputation_plan": with_sql(
        PANEL_SQL, STATS_SQL,
        f"d AS (SELECT *, {DECIDE} AS decision FROM v)",
        body="""SELECT decision, CAST(row_number() OVER (PARTITION BY decision ORDER BY fraction DESC, position) - 1 AS INTEGER) AS place,
        variable FROM d""",
    ),
    "ms_09_impute_simple": with_sql(
        PANEL_SQL, FILLED_SQL,
        body="SELECT supplier, month, " + ", ".join(f"round({c}, 7) AS {c}" for c in SIMPLE) + " FROM filled",
    ),
    "ms_10_impute_knn": with_sql(
        PANEL_SQL, FILLED_SQL, *knn_sql(False),
        body="SELECT supplier, month, " + ", ".join(_near(t, False) for t in NEAR) + " FROM filled p",
    ),
    "ms_11_impute": with_sql(
        PANEL_SQL, FILLED_SQL, *knn_sql(True),
        body="SELECT supplier, month, "
        + ", ".join(f"round({c}, 3) AS {c}" for c in SIMPLE)
        + ", "
        + ", ".join(_near(t, True) for t in NEAR)
        + " FROM filled p",
    ),
    "ms_12_validate_imputation": with_sql(
        *IMPUTED_SQL,
        "v AS (" + " UNION ALL ".join(_valid(c) for c in KEPT) + ")",
        body=f"""SELECT variable, round(mb, 3) AS mean_before, round(ma, 3) AS mean_after,
        round(qb, 3) AS median_before, round(qa, 3) AS median_after, round(sb, 3) AS std_before,
        round(sa, 3) AS std_after,
        CASE WHEN mb <> 0 THEN {rounded('(ma - mb) / abs(mb) * 100', 2)} END AS delta_mean_pct,
        CASE WHEN sb <> 0 THEN {rounded('(sa - sb) / abs(sb) * 100', 2)} END AS delta_std_pct FROM v""",
    ),
    "ms_14_little_em": with_sql(
        PANEL_SQL,
        "slope AS (SELECT covar_pop(rev_open, month_no) / var_pop(month_no) AS b, avg(month_no) AS mx, avg(rev_open) AS my,"
        " var_pop(rev_open) AS vy, var_pop(month_no) AS vx FROM panel WHERE rev_open IS NOT NULL)",
        "whole AS (SELECT avg(month_no) AS mx, var_pop(month_no) AS sxx FROM panel)",
        "ml AS (SELECT w.mx, w.sxx, s.my + b * (w.mx - s.mx) AS my, b * w.sxx AS sxy, vy - b * b * vx + b * b * w.sxx AS syy FROM slope s, whole w)",
        "part AS (SELECT rev_open IS NULL AS gone, count(*) AS n, avg(month_no) - any_value(mx) AS dx, avg(rev_open) - any_value(my) AS dy"
        " FROM panel, ml GROUP BY 1)",
        body="SELECT round(sum(CASE WHEN gone THEN n * dx * dx / sxx ELSE"
        " n * (dx * dx * syy - 2 * dx * dy * sxy + dy * dy * sxx) / (sxx * syy - sxy * sxy) END), 2) AS chi2,"
        " CAST(greatest(sum(CASE WHEN gone THEN 1 ELSE 2 END) - 2, 1) AS BIGINT) AS df FROM part, ml",
    ),
    "ms_14_little_pairwise": with_sql(
        PANEL_SQL,
        "m AS (SELECT avg(rev_R) AS mx, avg(rev_A) AS my, var_samp(rev_R) AS sxx, var_samp(rev_A) AS syy,"
        " covar_samp(rev_R, rev_A) AS sxy FROM panel)",
        "part AS (SELECT rev_R IS NULL AS no_x, rev_A IS NULL AS no_y, count(*) AS n, avg(rev_R) - any_value(mx) AS dx,"
        " avg(rev_A) - any_value(my) AS dy FROM panel, m WHERE rev_R IS NOT NULL OR rev_A IS NOT NULL GROUP BY 1, 2)",
        body="SELECT round(sum(CASE WHEN no_x THEN n * dy * dy / syy WHEN no_y THEN n * dx * dx / sxx ELSE"
        " n * (dx * dx * syy - 2 * dx * dy * sxy + dy * dy * sxx) / (sxx * syy - sxy * sxy) END), 2) AS chi2,"
        " CAST(greatest(sum(CASE WHEN no_x OR no_y THEN 1 ELSE 2 END) - 2, 1) AS BIGINT) AS df FROM part, m",
    ),
    "ms_15_missing_patterns": with_sql(
        PANEL_SQL,
        body="SELECT "
        + " || ".join(f"CASE WHEN {c} IS NULL THEN '0' ELSE '1' END" for c in FEATS)
        + " AS pattern, count(*) AS n, "
        + ", ".join(f"round(avg({c}), 7) AS {c}" for c in FEATS)
        + " FROM panel GROUP BY 1",
    ),
}
