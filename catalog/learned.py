"""Clustering, classification and whole runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.functions.fixed_values import MONTHS, STATISTICS
from gaugeline.functions.session import keep
from gaugeline.operators import classify, cluster, iforest, limits
from gaugeline.operators.descriptive import Scaler
from gaugeline.operators.kmeans import lloyd_step as lloyd
from gaugeline.operators.missing import impute_simple
from gaugeline.operators.neighbors import impute
from gaugeline.plans import runs
from gaugeline.sources.tables import read_table, write_table

from .base import (
    EVENT,
    FEATS,
    IDS,
    KEPT,
    LIMITS,
    MULTI,
    PANEL_SQL,
    SCALED_SQL,
    embedding_columns,
    rnd,
    rounded,
    scaled_panel,
    scaled_sql,
    scratch,
    table,
    with_sql,
)
from .base import panel as load
from .detectors import ORACLES as DETECTORS
from .gaps import IMPUTED_SQL
from .tables import COUNT_ALL, COUNTED_SQL

FOREST = iforest.IsolationForest()


def kmeans(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.kmeans_fit(scaled_panel(spark, sf), MULTI, 3).table.select(*IDS, "cluster")


def assignment(spark: SparkSession, sf: str) -> DataFrame:
    """Rows in all, and rows that lie nearer to another centroid than to their own: none may."""
    fit = cluster.kmeans_fit(scaled_panel(spark, sf), MULTI, 3)
    gaps = [sum((F.col(c) - F.lit(m)) ** 2 for c, m in zip(MULTI, centre, strict=True)) for centre in fit.centroids]
    own = F.get(F.array(*gaps), F.col("cluster"))
    return fit.table.agg(F.count("*").alias("n"), F.count_if(own > F.least(*gaps) * (1 + 1e-9)).alias("n_misplaced"))


def lloyd_step(spark: SparkSession, sf: str) -> DataFrame:
    """One round of k-means from the means of the seasons."""
    rows = seasonal(spark, sf)
    means = rows.groupBy("cluster").agg(*[F.round(F.avg(c), 6).alias(c) for c in MULTI]).orderBy("cluster").collect()
    return rnd(lloyd(rows, MULTI, [list(r)[1:] for r in means]), MULTI, 6)


def sweep(spark: SparkSession, sf: str) -> DataFrame:
    rows, names = embedding_columns(spark, sf)
    return cluster.sweep_k(rows, names, range(2, 11))


def elbow(spark: SparkSession, sf: str) -> DataFrame:
    """Elbow of a falling curve: revenue left from each line number on."""
    lines = table(spark, sf, "lineitem").groupBy("l_linenumber").agg(
        F.sum(F.round("l_extendedprice", 2).cast("decimal(18,2)")).alias("v")
    )
    ahead = F.array(*[F.lit(i) for i in range(1, 8)])
    curve = (
        lines.select(F.explode(F.filter(ahead, lambda k: k <= F.col("l_linenumber"))).alias("k"), "v")
        .groupBy("k")
        .agg(F.sum("v").cast("double").alias("wcss"))
    )
    return rnd(cluster.elbow(curve), ["distance"], 6)


def seasonal(spark: SparkSession, sf: str) -> DataFrame:
    return scaled_panel(spark, sf).withColumn("cluster", (F.col("season") == "wet").cast("int"))


def silhouette(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(cluster.silhouette(seasonal(spark, sf), MULTI, "cluster"), ["silhouette"], 7)


def silhouette_vectors(spark: SparkSession, sf: str) -> DataFrame:
    rows, names = embedding_columns(spark, sf)
    return rnd(cluster.silhouette(rows, names, "label"), ["silhouette"], 7)


def silhouette_squared(spark: SparkSession, sf: str) -> DataFrame:
    out = cluster.silhouette(seasonal(spark, sf), MULTI, "cluster", method="squared")
    return rnd(out, ["silhouette"], 7)


def wcss(spark: SparkSession, sf: str) -> DataFrame:
    rows = seasonal(spark, sf)
    means = rows.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in MULTI]).orderBy("cluster").collect()
    return rnd(cluster.wcss(rows, MULTI, "cluster", [list(r)[1:] for r in means]), ["wcss"], 5)


def profile(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.cluster_profile(load(spark, sf), FEATS, "year")


def by_season(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(cluster.cluster_by_season(load(spark, sf), "year"), ["share"], 6)


def severe(spark: SparkSession, sf: str) -> DataFrame:
    """Severity label with the variables outside the limit rule, gaps filled."""
    labelled, _ = limits.label_severity(limits.violation_count(load(spark, sf), LIMITS), LIMITS)
    return impute_simple(labelled, ["rev_A", "tax_big"]).withColumn(
        "month_no", F.col("month_no").cast("double")
    )


FREE = ["rev_A", "tax_big", "month_no"]


def split(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per class and side of the split: counts are exact."""
    out = classify.stratified_split(severe(spark, sf), IDS, "severity_high")
    return out.groupBy("severity_high", "is_test").agg(F.count("*").alias("n"))


def forest(spark: SparkSession, sf: str) -> DataFrame:
    return classify.train_forest(severe(spark, sf), IDS, FREE, "severity_high", folds=0).predictions


def cross_validated(spark: SparkSession, sf: str) -> DataFrame:
    return classify.cv_f1(severe(spark, sf), IDS, FREE, "severity_high")


def importances(spark: SparkSession, sf: str) -> DataFrame:
    out = classify.train_forest(severe(spark, sf), IDS, FREE, "severity_high", folds=0)
    return out.importances


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    return classify.classification_metrics(table(spark, sf, "labels"), "quality", "toxic")


def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return classify.confusion_matrix(table(spark, sf, "labels"), "quality", "toxic", names=["no", "yes"])


def label_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and labels of every imputed row: the columns of the labelled table that nothing random enters."""
    filled, _ = impute(load(spark, sf), IDS, FEATS)
    strict, _ = limits.label_any(limits.violation_count(keep(filled), LIMITS), LIMITS)
    both, _ = limits.label_severity(strict, LIMITS)
    return both.select(*IDS, "n_violations", "inadequate", "severity_high")


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Values, cluster, counts, labels, anomaly flag and score of every imputed row side by side."""
    filled, plan = impute(load(spark, sf), IDS, FEATS)
    filled = keep(filled)
    rows = keep(Scaler.fit(filled, plan.kept).transform(filled))
    clusters = cluster.kmeans_fit(rows, plan.kept, 3).table.select(*IDS, "cluster")
    marks = iforest.detect_anomalies(rows, IDS, plan.kept, forest=FOREST).table.select(
        *IDS, "anomaly", "anomaly_score"
    )
    strict, _ = limits.label_any(limits.violation_count(filled, LIMITS), LIMITS)
    both, _ = limits.label_severity(strict, LIMITS)
    return both.join(clusters, IDS).join(marks, IDS)


def scatter(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.scatter_data(load(spark, sf), "rev_open", "wsum", "season", IDS)


# --- whole runs -------------------------------------------------------------------


def run_preprocess(spark: SparkSession, sf: str) -> DataFrame:
    scaled = runs.run_preprocess(load(spark, sf), IDS, scratch(spark, "run"), FEATS)["scaled"]
    return rnd(scaled.select(*IDS, *sorted(KEPT)), sorted(KEPT), 4)


def run_preprocess_files(spark: SparkSession, sf: str) -> DataFrame:
    """From text files on: two statistics, and two folders whose headers differ in order."""
    out = scratch(spark, "run")
    ids = {"supplier": "bigint", "Ano": "int", "Mes": "string", "Calc": "string"}
    text = load(spark, sf).select(
        "supplier", F.col("year").alias("Ano"), F.get(F.array(*[F.lit(m) for m in MONTHS]), F.col("month_no") - 1).alias("Mes"),
        F.explode(F.array(*[F.lit(s) for s in STATISTICS[:2]])).alias("Calc"),
        *[F.coalesce(F.translate(F.format_number(c, 12), ",.", ".,"), F.lit("--")).alias(c) for c in FEATS],
    )
    even = F.col("supplier") % 2 == 0
    files = [write_table(text.filter(even), "even", out, fmt="csv"), write_table(text.filter(~even).select(*text.columns[::-1]), "odd", out, fmt="csv")]
    scaled = runs.run_preprocess_files(spark, files, out, FEATS, id_types=ids, keys=["supplier"])["scaled"]
    scaled = scaled.withColumn("month", F.col("date").cast("string"))
    rounded = rnd(scaled.select(*IDS, *sorted(KEPT)), sorted(KEPT), 4)
    # A filled value lies within rounding of the mean: minus zero counts as zero.
    return rounded.withColumns({c: F.col(c) + F.lit(0.0) for c in sorted(KEPT)})


def _trained(spark: SparkSession, sf: str) -> tuple[str, dict[str, DataFrame]]:
    """The training run on the tables of the preprocessing run."""
    out = scratch(spark, "run")
    runs.run_preprocess(load(spark, sf), IDS, out, FEATS)
    return out, runs.run_train(spark, IDS, out, LIMITS)


def summary(spark: SparkSession, sf: str) -> DataFrame:
    """Every part, from the tables of the preprocessing and training runs and the calibration of the contamination."""
    out, _ = _trained(spark, sf)
    features = Scaler.load(spark, f"{out}/scaler").features
    calibrated = iforest.calibrate_contamination(read_table(spark, "scaled", out), IDS, features, forest=FOREST)
    write_table(calibrated, "contamination_calibration", f"{out}/tables")
    return runs.summary_metrics(spark, out)


def run_train(spark: SparkSession, sf: str) -> DataFrame:
    return _trained(spark, sf)[1]["labelled"]


def run_evaluate(spark: SparkSession, sf: str) -> DataFrame:
    out, _ = _trained(spark, sf)
    return runs.run_evaluate(spark, out)["summary"]


def variable_flags(spark: SparkSession, sf: str) -> DataFrame:
    return runs.variable_flags(load(spark, sf), FEATS)


def run_outlier_study(spark: SparkSession, sf: str) -> DataFrame:
    got = runs.run_outlier_study(
        load(spark, sf), IDS, scratch(spark, "run"), FEATS, LIMITS, year="year", date="month",
        window=EVENT, forest=FOREST,
    )
    return got["layers"]


QUERIES = {
    "cl_01_kmeans_fit": kmeans,
    "cl_01_kmeans_assignment": assignment,
    "cl_01_lloyd_step": lloyd_step,
    "cl_02_sweep_k": sweep,
    "cl_02_elbow": elbow,
    "cl_03_silhouette": silhouette,
    "cl_03_silhouette_vectors": silhouette_vectors,
    "cl_03_silhouette_squared": silhouette_squared,
    "cl_04_wcss": wcss,
    "cl_05_cluster_profile": profile,
    "cl_06_cluster_by_season": by_season,
    "cl_07_stratified_split": split,
    "cl_08_train_forest": forest,
    "cl_09_cv_f1": cross_validated,
    "cl_10_classification_metrics": metrics,
    "cl_11_confusion_matrix": confusion,
    "cl_12_feature_importance": importances,
    "cl_13_labelled_table": labelled,
    "cl_13_label_columns": label_columns,
    "cl_14_summary_metrics": summary,
    "cl_15_scatter_data": scatter,
    "pl_01_preprocess": run_preprocess,
    "pl_01_preprocess_files": run_preprocess_files,
    "pl_02_train": run_train,
    "pl_03_evaluate": run_evaluate,
    "pl_04_outlier_study": run_outlier_study,
    "pl_04_flags_per_variable": variable_flags,
}


def _silhouette_sql(points: str, dist: str, ids: str, label: str, differ: str) -> list[str]:
    return [
        f"sizes AS (SELECT {label} AS c, count(*) AS n FROM {points} GROUP BY 1)",
        f"sums AS MATERIALIZED (SELECT {ids}, a.{label} AS own, b.{label} AS c, sum({dist}) AS s FROM {points} a, {points} b GROUP BY ALL)",
        f"""ab AS (SELECT {differ}, max(CASE WHEN own = c THEN s / nullif(n - 1, 0) END) AS ia,
          min(CASE WHEN own <> c THEN s / n END) AS ib FROM sums JOIN sizes USING (c) GROUP BY ALL)""",
    ]


_D2 = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in MULTI)
_SIL = "SELECT round(avg(CASE WHEN ia IS NULL OR greatest(ia, ib) = 0 THEN 0 ELSE (ib - ia) / greatest(ia, ib) END), 7) AS silhouette FROM ab"

ORACLES = {
    "cl_01_kmeans_assignment": with_sql(PANEL_SQL, SCALED_SQL, body="SELECT count(*) AS n, 0 AS n_misplaced FROM z"),
    "cl_01_lloyd_step": with_sql(
        PANEL_SQL, SCALED_SQL,
        "s AS (SELECT season, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in MULTI) + " FROM z GROUP BY 1)",
        "g AS (SELECT z.*, " + ", ".join(
            "(SELECT " + " + ".join(f"(z.{c} - s.{c}) * (z.{c} - s.{c})" for c in MULTI) + f" FROM s WHERE s.season = '{n}') AS {n}"
            for n in ("dry", "wet")) + " FROM z)",
        body="SELECT CAST(wet < dry AS INTEGER) AS cluster, count(*) AS n, "
        + ", ".join(f"round(avg({c}), 6) AS {c}" for c in MULTI) + " FROM g GROUP BY 1",
    ),
    "cl_13_label_columns": with_sql(
        *IMPUTED_SQL,
        f"counted AS (SELECT supplier, month, CAST({COUNT_ALL} AS INTEGER) AS n_violations FROM imputed)",
        body="""SELECT *, CAST(n_violations > 0 AS INTEGER) AS inadequate,
        CAST(n_violations > (SELECT quantile_cont(n_violations, 0.5) FROM counted) AS INTEGER) AS severity_high FROM counted""",
    ),
    "pl_01_preprocess": with_sql(
        *IMPUTED_SQL, scaled_sql("s", "imputed", KEPT, IDS),
        body="SELECT supplier, month, " + ", ".join(f"round({c}, 4) AS {c}" for c in KEPT) + " FROM s",
    ),
    "pl_01_preprocess_files": with_sql(
        *IMPUTED_SQL, scaled_sql("s", "imputed", KEPT, IDS),
        body="SELECT supplier, month, " + ", ".join(f"round({c}, 4) + 0.0::DOUBLE AS {c}" for c in KEPT) + " FROM s",
    ),
    "pl_04_flags_per_variable": DETECTORS["ou_10_flag_counts_by_variable"],
    "cl_02_elbow": """WITH l AS (SELECT l_linenumber AS k, sum(CAST(round(l_extendedprice, 2) AS DECIMAL(18,2))) AS v FROM lineitem GROUP BY 1),
      c AS (SELECT k, CAST(sum(v) OVER (ORDER BY k DESC) AS DOUBLE) AS w FROM l),
      e AS (SELECT min(k) AS k0, max(k) AS k1, min_by(w, k) AS w0, max_by(w, k) AS w1 FROM c)
      SELECT k, round(abs((w1 - w0) * (k - k0) - (k1 - k0) * (w - w0)) / sqrt((k1 - k0) * (k1 - k0) + (w1 - w0) * (w1 - w0)), 6) AS distance
      FROM c, e ORDER BY 2 DESC, 1 LIMIT 1""",
    "cl_03_silhouette": with_sql(
        PANEL_SQL, SCALED_SQL,
        *_silhouette_sql("z", f"sqrt({_D2})", "a.supplier, a.month", "season", "supplier, month"), body=_SIL,
    ),
    "cl_03_silhouette_vectors": with_sql(
        "v AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)",
        *_silhouette_sql("v", "list_distance(a.e, b.e)", "a.vec_id", "label", "vec_id"), body=_SIL,
    ),
    "cl_03_silhouette_squared": with_sql(
        PANEL_SQL, SCALED_SQL,
        *_silhouette_sql("z", _D2, "a.supplier, a.month", "season", "supplier, month"), body=_SIL,
    ),
    "cl_04_wcss": with_sql(
        PANEL_SQL, SCALED_SQL,
        "g AS (SELECT season, count(*) AS n, " + " + ".join(f"var_pop({c})" for c in MULTI) + " AS v FROM z GROUP BY 1)",
        body="SELECT round(sum(n * v), 5) AS wcss FROM g",
    ),
    "cl_05_cluster_profile": with_sql(
        PANEL_SQL,
        body="SELECT year, " + ", ".join(f"round(avg({c}), 2) AS {c}" for c in FEATS) + ", count(*) AS n FROM panel GROUP BY 1",
    ),
    "cl_06_cluster_by_season": with_sql(
        PANEL_SQL,
        body="""SELECT year, season, count(*) AS n, round(count(*) / any_value(t), 6) AS share
        FROM (SELECT *, count(*) OVER (PARTITION BY year) AS t FROM panel) GROUP BY 1, 2""",
    ),
    "cl_07_stratified_split": with_sql(
        PANEL_SQL, COUNTED_SQL,
        "s AS (SELECT CAST(n_violations > (SELECT quantile_cont(n_violations, 0.5) FROM counted) AS INTEGER) AS severity_high FROM counted)",
        "g AS (SELECT severity_high, count(*) AS n FROM s GROUP BY 1)",
        "w AS (SELECT *, n * ceil(0.2 * sum(n) OVER ()) / sum(n) OVER () AS exact, ceil(0.2 * sum(n) OVER ()) AS total FROM g)",
        "r AS (SELECT *, row_number() OVER (ORDER BY exact - floor(exact) DESC, severity_high) AS place, total - sum(floor(exact)) OVER () AS rest FROM w)",
        "t AS (SELECT severity_high, n, CAST(floor(exact) + CAST(place <= rest AS INTEGER) AS BIGINT) AS k FROM r)",
        body="SELECT severity_high, true AS is_test, k AS n FROM t UNION ALL SELECT severity_high, false, n - k FROM t",
    ),
    "cl_10_classification_metrics": """SELECT round(avg(CAST(quality = toxic AS INTEGER)), 4) AS accuracy,
      round(CASE WHEN sum(toxic) = 0 THEN 0 ELSE sum(quality * toxic) / sum(toxic) END, 4) AS precision,
      round(CASE WHEN sum(quality) = 0 THEN 0 ELSE sum(quality * toxic) / sum(quality) END, 4) AS recall,
      round(CASE WHEN sum(quality) + sum(toxic) = 0 THEN 0 ELSE 2 * sum(quality * toxic) / (sum(quality) + sum(toxic)) END, 4) AS f1 FROM labels""",
    "cl_11_confusion_matrix": """SELECT 'real_' || n AS real, count(*) FILTER (WHERE toxic = 0) AS pred_no, count(*) FILTER (WHERE toxic = 1) AS pred_yes
      FROM labels JOIN (VALUES (0, 'no'), (1, 'yes')) v(q, n) ON q = quality GROUP BY 1""",
    "cl_15_scatter_data": with_sql(
        PANEL_SQL, body="SELECT supplier, month, rev_open AS x, wsum AS y, season AS mark FROM panel"
    ),
}
