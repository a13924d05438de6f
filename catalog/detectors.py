"""Univariate rules, neighbour and forest detectors, votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.operators import ensemble, iforest, neighbors
from gaugeline.operators import univariate as u
from gaugeline.operators.medcouple import medcouple

from .base import (
    FEATS,
    IDS,
    MULTI,
    PANEL_SQL,
    SCALED_SQL,
    embedding_columns,
    per_variable,
    rnd,
    rounded,
    scaled_panel,
    table,
    with_sql,
)
from .base import panel as load

FOREST = iforest.IsolationForest()


# --- univariate -------------------------------------------------------------------


def flagged(prefix: str, fn, **kw):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return fn(load(spark, sf), FEATS, prefix=prefix, **kw).select(
            *IDS, *[prefix + c for c in FEATS]
        )

    return run


def iqr_table(spark: SparkSession, sf: str) -> DataFrame:
    return u.iqr_table(load(spark, sf), FEATS)


def long_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Extreme document lengths, whole texts counted."""
    return u.flag_iqr(table(spark, sf, "documents"), ["n_chars"], 3.0, min_obs=30, skip_flat=True).select(
        "doc_id", "iqr_n_chars"
    )


def medcouples(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(medcouple(load(spark, sf), FEATS), ["medcouple"], 8)


def any_flag(spark: SparkSession, sf: str) -> DataFrame:
    rows = u.flag_iqr(load(spark, sf), FEATS)
    rows = u.flag_mad(rows, FEATS)
    rows = u.row_any(rows, [f"iqr_{c}" for c in FEATS], "iqr_any")
    return u.row_any(rows, [f"mad_{c}" for c in FEATS], "mad_any").select(*IDS, "iqr_any", "mad_any")


def counts_by_variable(spark: SparkSession, sf: str) -> DataFrame:
    rows = u.flag_mad(u.flag_iqr(load(spark, sf), FEATS), FEATS)
    return u.flag_counts_by_variable(rows, FEATS, {"IQR": "iqr_", "MAD": "mad_"})


def extreme(spark: SparkSession, sf: str) -> DataFrame:
    """Most extreme variable of the rows some variable of which leaves the quartile fences."""
    rows = u.row_any(u.flag_iqr(load(spark, sf), MULTI), [f"iqr_{c}" for c in MULTI], "hit")
    from gaugeline.operators.descriptive import Scaler
    from gaugeline.operators.panel import complete_cases

    whole = complete_cases(rows, MULTI)
    top = u.most_extreme(whole, MULTI, Scaler.fit(whole, MULTI)).filter("hit")
    return top.select(*IDS, "top_variable", "top_value", "top_z")


# --- neighbours -------------------------------------------------------------------


def nearest(spark: SparkSession, sf: str) -> DataFrame:
    rows, names = embedding_columns(spark, sf)
    out = neighbors.knn_join(
        rows, rows, names, 5, query_id="vec_id", base_id="vec_id", exclude_self=True
    )
    return out.select("vec_id", "neighbor_id", F.col("rank").cast("bigint").alias("rank"), F.round("dist", 6).alias("dist"))


def nearest_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest wet-season rows of every dry-season row."""
    rows = scaled_panel(spark, sf).withColumn("id", neighbors.row_id(IDS))
    out = neighbors.knn_join(
        rows.filter("season = 'dry'"), rows.filter("season = 'wet'"), MULTI, 3, query_id="id", base_id="id"
    )
    return out.select("id", "neighbor_id", F.col("rank").cast("bigint").alias("rank"), F.round("dist", 6).alias("dist"))


def knn_flags(spark: SparkSession, sf: str) -> DataFrame:
    out = neighbors.flag_knn(scaled_panel(spark, sf), IDS, MULTI)
    return rnd(out.select(*IDS, "knn_score", "flag_KNN"), ["knn_score"], 6)


def knn_flags_self(spark: SparkSession, sf: str) -> DataFrame:
    out = neighbors.flag_knn(scaled_panel(spark, sf), IDS, MULTI, include_self=True)
    return rnd(out.select(*IDS, "knn_score", "flag_KNN"), ["knn_score"], 6)


def lof_flags(spark: SparkSession, sf: str) -> DataFrame:
    out = neighbors.flag_lof(scaled_panel(spark, sf), IDS, MULTI)
    return rnd(out.select(*IDS, "lof_score", "flag_LOF"), ["lof_score"], 6)


# --- forest -----------------------------------------------------------------------


def forest_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = scaled_panel(spark, sf)
    return FOREST.fit(rows, IDS, MULTI).score(rows).select(*IDS, "iforest_score")


def anomalies(spark: SparkSession, sf: str) -> DataFrame:
    return iforest.detect_anomalies(scaled_panel(spark, sf), IDS, MULTI, forest=FOREST).table.select(
        *IDS, "anomaly", "anomaly_score"
    )


def details(spark: SparkSession, sf: str) -> DataFrame:
    found = iforest.detect_anomalies(scaled_panel(spark, sf), IDS, MULTI, forest=FOREST)
    return iforest.anomaly_details(found.table, load(spark, sf), IDS, MULTI)


def calibration(spark: SparkSession, sf: str) -> DataFrame:
    return iforest.calibrate_contamination(scaled_panel(spark, sf), IDS, MULTI, forest=FOREST)


def three_votes(spark: SparkSession, sf: str) -> DataFrame:
    """Vote of three univariate rules, which SQL can repeat."""
    rows = u.flag_mad(u.flag_iqr(load(spark, sf), FEATS), FEATS)
    rows = u.flag_percentile(rows, FEATS)
    for p in ("iqr", "mad", "pct"):
        rows = u.row_any(rows, [f"{p}_{c}" for c in FEATS], f"{p}_any")
    return ensemble.vote(rows, ["iqr_any", "mad_any", "pct_any"]).select(*IDS, "votes", "outlier")


def detector_votes(spark: SparkSession, sf: str) -> DataFrame:
    out = ensemble.ensemble_outliers(scaled_panel(spark, sf), IDS, MULTI, forest=FOREST)
    return out.select(*IDS, "flag_IForest", "flag_LOF", "flag_KNN", "votes", "outlier")


def rate(spark: SparkSession, sf: str) -> DataFrame:
    rows = u.row_any(u.flag_iqr(load(spark, sf), FEATS), [f"iqr_{c}" for c in FEATS], "hit")
    return ensemble.anomaly_rate(rows, "hit")


# --- SQL --------------------------------------------------------------------------

STAT_SQL = "fs AS MATERIALIZED (SELECT " + ", ".join(
    f"count({c}) AS n_{c}, avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}, quantile_cont({c}, 0.01) AS p1_{c}, "
    f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.5) AS q2_{c}, quantile_cont({c}, 0.75) AS q3_{c}, "
    f"quantile_cont({c}, 0.99) AS p99_{c}"
    for c in FEATS
) + " FROM panel)"
MAD_SQL = "md AS MATERIALIZED (SELECT " + ", ".join(
    f"quantile_cont(abs({c} - q2_{c}), 0.5) AS mad_{c}" for c in FEATS
) + " FROM panel, fs)"


def _medcouple(c: str) -> str:
    return f"""SELECT '{c}' AS variable, coalesce((SELECT quantile_cont(((a - m) - (m - b)) / (a - b), 0.5)
      FROM (SELECT {c} AS a, q2_{c} AS m FROM panel, fs WHERE {c} >= q2_{c}),
        (SELECT {c} AS b FROM panel, fs WHERE {c} <= q2_{c}) WHERE a <> b), 0) AS mc"""


MC_SQL = "mc AS MATERIALIZED (" + " UNION ALL ".join(_medcouple(c) for c in FEATS) + ")"
ADJ_SQL = "adj AS MATERIALIZED (SELECT " + ", ".join(
    f"(SELECT mc FROM mc WHERE variable = '{c}') AS mc_{c}" for c in FEATS
) + ")"

IQR = "coalesce({c} < q1_{c} - {k} * (q3_{c} - q1_{c}) OR {c} > q3_{c} + {k} * (q3_{c} - q1_{c}), false)"
ZED = "coalesce(abs(({c} - m_{c}) / s_{c}) > 3, false)"
MAD = "coalesce(abs(0.6745 * ({c} - q2_{c}) / nullif(mad_{c}, 0)) > 3.5, false)"
PCT = "coalesce({c} < p1_{c} OR {c} > p99_{c}, false)"
ADJ = """coalesce({c} < q1_{c} - 1.5 * (q3_{c} - q1_{c}) * exp(CASE WHEN mc_{c} >= 0 THEN -4 ELSE -3 END * mc_{c})
  OR {c} > q3_{c} + 1.5 * (q3_{c} - q1_{c}) * exp(CASE WHEN mc_{c} >= 0 THEN 3 ELSE 4 END * mc_{c}), false)"""


def rule(template: str, c: str, **kw) -> str:
    return template.format(c=c, **kw)


def flag_sql(prefix: str, template: str, *ctes: str, source: str = "panel, fs", **kw) -> str:
    return with_sql(
        PANEL_SQL, STAT_SQL, *ctes,
        body="SELECT supplier, month, "
        + ", ".join(f"{rule(template, c, **kw)} AS {prefix}{c}" for c in FEATS)
        + f" FROM {source}",
    )


def any_sql(template: str, features: list[str] = FEATS, **kw) -> str:
    return "(" + " OR ".join(rule(template, c, **kw) for c in features) + ")"


_VEC = "SELECT a.vec_id, b.vec_id AS neighbor_id, list_distance(a.e, b.e) AS d FROM v a, v b WHERE a.vec_id <> b.vec_id"
_D3 = "sqrt(" + " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in MULTI) + ")"
_KNN = """k AS (SELECT a.supplier, a.month, min({d}, {k})[{k}] AS score FROM z a, z b
  WHERE NOT (a.supplier = b.supplier AND a.month = b.month) GROUP BY 1, 2)"""
LOF_SQL = [
    f"zi AS MATERIALIZED (SELECT row_number() OVER (ORDER BY supplier, month) AS i, * FROM z)",
    f"nb AS MATERIALIZED (SELECT i, unnest(best) AS n FROM (SELECT a.i, min_by({{'j': b.i, 'd': {_D3}}}, {_D3}, 20) AS best FROM zi a, zi b WHERE a.i <> b.i GROUP BY 1))",
    "kd AS MATERIALIZED (SELECT i, max(n.d) AS kd FROM nb GROUP BY 1)",
    "lrd AS MATERIALIZED (SELECT nb.i, 1 / (avg(greatest(nb.n.d, kd.kd)) + 1e-10) AS lrd FROM nb JOIN kd ON kd.i = nb.n.j GROUP BY 1)",
    "lof AS MATERIALIZED (SELECT nb.i, avg(o.lrd) / any_value(l.lrd) AS lof FROM nb JOIN lrd o ON o.i = nb.n.j JOIN lrd l ON l.i = nb.i GROUP BY 1)",
]

QUERIES = {
    "ou_01_flag_iqr": flagged("iqr_", u.flag_iqr),
    "ou_02_iqr_table": iqr_table,
    "ou_03_flag_iqr_extreme": flagged("iqr_", u.flag_iqr, k=3.0, min_obs=30, skip_flat=True),
    "ou_03_flag_iqr_documents": long_texts,
    "ou_04_flag_zscore": flagged("z_", u.flag_zscore),
    "ou_05_flag_mad": flagged("mad_", u.flag_mad),
    "ou_06_flag_percentile": flagged("pct_", u.flag_percentile),
    "ou_07_medcouple": medcouples,
    "ou_08_flag_adjusted_box": flagged("adj_", u.flag_adjusted_box),
    "ou_09_row_any": any_flag,
    "ou_10_flag_counts_by_variable": counts_by_variable,
    "ou_11_most_extreme": extreme,
    "nn_01_knn_join": nearest,
    "nn_01_knn_join_two_tables": nearest_panel,
    "nn_02_flag_knn": knn_flags,
    "nn_02_flag_knn_with_self": knn_flags_self,
    "nn_03_flag_lof": lof_flags,
    "nn_04_isolation_forest": forest_scores,
    "nn_05_detect_anomalies": anomalies,
    "nn_06_anomaly_details": details,
    "nn_07_vote": three_votes,
    "nn_07_ensemble_outliers": detector_votes,
    "nn_08_calibrate_contamination": calibration,
    "nn_09_anomaly_rate": rate,
}

_TOP = ", ".join(f"{{'v': '{c}', 'x': {c}, 'z': ({c} - w_{c}) / t_{c}, 'p': {i}}}" for i, c in enumerate(MULTI))

ORACLES = {
    "ou_01_flag_iqr": flag_sql("iqr_", IQR, k=1.5),
    "ou_02_iqr_table": with_sql(
        PANEL_SQL, STAT_SQL,
        body=" UNION ALL ".join(
            f"SELECT '{c}' AS variable, count(*) FILTER (WHERE {rule(IQR, c, k=1.5)}) AS n_outliers, "
            f"round(count(*) FILTER (WHERE {rule(IQR, c, k=1.5)}) / count({c}) * 100, 2) AS pct FROM panel, fs"
            for c in FEATS
        ),
    ),
    "ou_03_flag_iqr_extreme": flag_sql("iqr_", IQR, k=3.0),
    "ou_03_flag_iqr_documents": """WITH q AS (SELECT quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.75) AS q3 FROM documents)
      SELECT doc_id, (n_chars < q1 - 3.0 * (q3 - q1) OR n_chars > q3 + 3.0 * (q3 - q1)) AS iqr_n_chars FROM documents, q""",
    "ou_04_flag_zscore": flag_sql("z_", ZED),
    "ou_05_flag_mad": flag_sql("mad_", MAD, MAD_SQL, source="panel, fs, md"),
    "ou_06_flag_percentile": flag_sql("pct_", PCT),
    "ou_07_medcouple": with_sql(
        PANEL_SQL, STAT_SQL, MC_SQL, body=f"SELECT variable, {rounded('mc', 8)} AS medcouple FROM mc"
    ),
    "ou_08_flag_adjusted_box": flag_sql("adj_", ADJ, MC_SQL, ADJ_SQL, source="panel, fs, adj"),
    "ou_09_row_any": with_sql(
        PANEL_SQL, STAT_SQL, MAD_SQL,
        body=f"SELECT supplier, month, {any_sql(IQR, k=1.5)} AS iqr_any, {any_sql(MAD)} AS mad_any FROM panel, fs, md",
    ),
    "ou_10_flag_counts_by_variable": with_sql(
        PANEL_SQL, STAT_SQL, MAD_SQL,
        body=" UNION ALL ".join(
            f"""SELECT '{c}' AS variable, count(*) FILTER (WHERE {rule(IQR, c, k=1.5)}) AS "IQR",
            count(*) FILTER (WHERE {rule(MAD, c)}) AS "MAD" FROM panel, fs, md"""
            for c in FEATS
        ),
    ),
    "ou_11_most_extreme": with_sql(
        PANEL_SQL, STAT_SQL,
        f"whole AS (SELECT *, {any_sql(IQR, MULTI, k=1.5)} AS hit FROM panel, fs WHERE "
        + " AND ".join(f"{c} IS NOT NULL" for c in MULTI) + ")",
        "w AS (SELECT " + ", ".join(f"avg({c}) AS w_{c}, stddev_pop({c}) AS t_{c}" for c in MULTI) + " FROM whole)",
        f"e AS (SELECT supplier, month, unnest([{_TOP}]) AS e FROM whole, w WHERE hit)",
        f"r AS (SELECT supplier, month, e, row_number() OVER (PARTITION BY supplier, month ORDER BY abs(e.z) DESC, e.p) AS r FROM e)",
        body=f"SELECT supplier, month, e.v AS top_variable, round(e.x, 3) AS top_value, {rounded('e.z', 2)} AS top_z FROM r WHERE r = 1",
    ),
    "nn_01_knn_join": with_sql(
        "v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)", f"p AS ({_VEC})",
        body="""SELECT vec_id, neighbor_id, rank, round(d, 6) AS dist FROM
        (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbor_id) AS rank FROM p) WHERE rank <= 5""",
    ),
    "nn_01_knn_join_two_tables": with_sql(
        PANEL_SQL, SCALED_SQL, "zi AS MATERIALIZED (SELECT supplier || '|' || month AS id, * FROM z)",
        f"b AS (SELECT a.id, min_by({{'n': b.id, 'd': {_D3}}}, {_D3}, 3) AS best FROM zi a, zi b WHERE a.season = 'dry' AND b.season = 'wet' GROUP BY 1)",
        body="SELECT id, best[r].n AS neighbor_id, r AS rank, round(best[r].d, 6) AS dist FROM b, range(1, 4) t(r)",
    ),
    "nn_02_flag_knn": with_sql(
        PANEL_SQL, SCALED_SQL, _KNN.format(d=_D3, k=5),
        body="SELECT supplier, month, round(score, 6) AS knn_score, score > (SELECT quantile_cont(score, 0.93) FROM k) AS \"flag_KNN\" FROM k",
    ),
    "nn_02_flag_knn_with_self": with_sql(
        PANEL_SQL, SCALED_SQL, _KNN.format(d=_D3, k=4),
        body="SELECT supplier, month, round(score, 6) AS knn_score, score > (SELECT quantile_cont(score, 0.93) FROM k) AS \"flag_KNN\" FROM k",
    ),
    "nn_03_flag_lof": with_sql(
        PANEL_SQL, SCALED_SQL, *LOF_SQL,
        body="""SELECT supplier, month, round(lof, 6) AS lof_score, -lof < (SELECT quantile_cont(-lof, 0.07) FROM lof) AS "flag_LOF"
        FROM zi JOIN lof USING (i)""",
    ),
    "nn_07_vote": with_sql(
        PANEL_SQL, STAT_SQL, MAD_SQL,
        f"t AS (SELECT supplier, month, CAST({any_sql(IQR, k=1.5)} AS INTEGER) + CAST({any_sql(MAD)} AS INTEGER) + CAST({any_sql(PCT)} AS INTEGER) AS votes FROM panel, fs, md)",
        body="SELECT supplier, month, votes, votes >= 2 AS outlier FROM t",
    ),
    "nn_09_anomaly_rate": with_sql(
        PANEL_SQL, STAT_SQL,
        body=f"SELECT round(avg(CAST({any_sql(IQR, k=1.5)} AS INTEGER)), 4) AS rate FROM panel, fs",
    ),
}
