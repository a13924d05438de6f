"""Nearest neighbours, neighbour-distance and local-density detectors, neighbour imputation.

Identical feature vectors are searched once: a group of copies enters the search as one vector
with a weight, however many rows it has, and results are joined back to the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, num
from ..functions.fixed_values import (
    CONTAMINATION,
    IMPUTE_NEIGHBORS,
    LOF_NEIGHBORS,
    SCALE_ABOVE,
)
from ..functions.quantiles import exact_quantiles
from ..functions.session import keep, written
from .cells import CELL_ROWS, search, xcols
from .descriptive import Scaler
from .missing import ImputationPlan, impute_simple, plan_imputation
from .panel import missing_fractions


def row_id(id_cols: Sequence[str]) -> Column:
    """One sortable id from one or more key columns; different keys give different ids, NULL included."""
    if len(id_cols) == 1:
        return col(id_cols[0])
    parts = [F.regexp_replace(col(c).cast("string"), r"([\\\\|])", r"\\\\$1") for c in id_cols]
    return F.concat_ws("|", *[F.coalesce(p, F.lit("\\N")) for p in parts])


def _vectors(df: DataFrame, features: Sequence[str], extra: dict[str, Column]) -> DataFrame:
    names = xcols(len(features))
    return df.select(
        *[c.alias(k) for k, c in extra.items()],
        *[num(f).alias(x) for f, x in zip(features, names, strict=True)],
    )


def _same_vector(rows: DataFrame, vectors: DataFrame, names: Sequence[str]) -> DataFrame:
    """``rows`` with the columns of the vector they hold; a missing coordinate matches a missing one."""
    other = vectors.withColumnsRenamed({x: f"_other{x}" for x in names})
    same = [F.col(x).eqNullSafe(F.col(f"_other{x}")) for x in names]
    return rows.join(other, same).drop(*[f"_other{x}" for x in names])


def knn_join(
    queries: DataFrame,
    base: DataFrame,
    features: Sequence[str],
    k: int,
    *,
    query_id: str,
    base_id: str,
    exclude_self: bool = False,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """``query_id, neighbor_id, rank, dist``: the exact k nearest rows, ties by neighbour id.

    With ``exclude_self`` a row is not its own neighbour (same id on both sides).
    """
    dims, reach = len(features), k + 1 if exclude_self else k
    names = xcols(dims)
    # Of identical base rows only the first ``reach`` ids can ever be among the nearest.
    copies = Window.partitionBy(*names).orderBy("nid")
    rows = (
        _vectors(base, features, {"nid": col(base_id)})
        .withColumn("copy", F.row_number().over(copies))
        .filter(F.col("copy") <= reach)
        .select("nid", F.lit(1).cast("bigint").alias("w"), *names)
    )
    asked = _vectors(queries, features, {"id": col(query_id)})
    distinct = keep(asked.groupBy(*names).agg(F.min("id").alias("qid")))
    found = search(distinct, rows, dims, reach, cell_rows=cell_rows)
    by_vector = distinct.select("qid", *[F.col(x).alias(x) for x in names])
    pairs = (
        _same_vector(asked, by_vector, names)
        .select("id", "qid")
        .join(found.select("qid", "nid", "dist"), "qid")
    )
    if exclude_self:
        pairs = pairs.filter(F.col("id") != F.col("nid"))
    near = Window.partitionBy("id").orderBy("dist", "nid")
    return (
        pairs.withColumn("rank", F.row_number().over(near))
        .filter(F.col("rank") <= k)
        .select(F.col("id").alias(query_id), F.col("nid").alias("neighbor_id"), "rank", "dist")
    )


def _numbered(distinct: DataFrame, names: Sequence[str]) -> DataFrame:
    """``distinct`` with whole numbers in the order of ``qid`` in its place, which are shorter to move; written once."""
    return written(distinct.orderBy("qid", *names).withColumn("qid", F.monotonically_increasing_id()))


#: Neighbours in a partition where they are dealt by their id.
NEAR_ROWS = 2_000_000

#: Distinct vectors with counts, and the nearest vectors of each (itself included).
SelfSearch = tuple[DataFrame, DataFrame]


def self_search(
    df: DataFrame, id_cols: Sequence[str], features: Sequence[str], k: int, cell_rows: int = CELL_ROWS
) -> SelfSearch:
    """The k + 1 nearest vectors of every distinct vector; one search serves all detectors of up to ``k`` neighbours."""
    names = xcols(len(features))
    rows = _vectors(df, features, {"id": row_id(id_cols)})
    distinct = _numbered(rows.groupBy(*names).agg(F.min("id").alias("qid"), F.count("*").alias("n")), names)
    base = distinct.select(
        F.col("qid").alias("nid"), F.least("n", F.lit(k + 1)).alias("w"), *names
    )
    return distinct, search(distinct, base, len(features), k + 1, cell_rows=cell_rows)


def _back_to_rows(
    df: DataFrame,
    id_cols: Sequence[str],
    features: Sequence[str],
    distinct: DataFrame,
    scores: DataFrame,
    name: str,
) -> DataFrame:
    """Attach the score of each distinct vector to every row that has it."""
    names = xcols(len(features))
    scored = distinct.select("qid", *names).join(scores, "qid").drop("qid")
    wide = df.withColumns({x: num(f) for f, x in zip(features, names, strict=True)})
    return _same_vector(wide, scored, names).drop(*names).withColumnRenamed("score", name)


def knn_scores(
    df: DataFrame,
    id_cols: Sequence[str],
    features: Sequence[str],
    k: int = 5,
    *,
    include_self: bool = False,
    name: str = "knn_score",
    cell_rows: int = CELL_ROWS,
    searched: SelfSearch | None = None,
) -> DataFrame:
    """Add the distance to the k-th neighbour.

    ``include_self`` counts the row itself as its first neighbour. ``searched`` is a search of the same rows for as many
    neighbours or more.
    """
    k = min(k, max(1, df.count() - 1))
    reach = max(k - 1 if include_self else k, 0)
    distinct, found = searched or self_search(df, id_cols, features, reach, cell_rows)
    scores = found.filter(F.col("before") < reach + 1).groupBy("qid").agg(F.max("dist").alias("score"))
    return _back_to_rows(df, id_cols, features, distinct, scores, name)


def flag_above(
    df: DataFrame, score: str, contamination: float = CONTAMINATION, *, name: str
) -> DataFrame:
    """True where the score is strictly above its exact (1 - contamination) quantile."""
    cut = exact_quantiles(df, {"s": col(score)}, [1 - contamination])["s"][0]
    return df.withColumn(name, F.coalesce(col(score) > F.lit(cut), F.lit(False)))


def flag_knn(
    df: DataFrame,
    id_cols: Sequence[str],
    features: Sequence[str],
    k: int = 5,
    contamination: float = CONTAMINATION,
    *,
    include_self: bool = False,
    name: str = "flag_KNN",
    cell_rows: int = CELL_ROWS,
    searched: SelfSearch | None = None,
) -> DataFrame:
    """Neighbour-distance detector: adds ``knn_score`` and the flag."""
    scored = keep(
        knn_scores(
            df, id_cols, features, k, include_self=include_self, cell_rows=cell_rows, searched=searched
        )
    )
    return flag_above(scored, "knn_score", contamination, name=name)


def lof_scores(
    df: DataFrame,
    id_cols: Sequence[str],
    features: Sequence[str],
    k: int = LOF_NEIGHBORS,
    *,
    name: str = "lof_score",
    cell_rows: int = CELL_ROWS,
    searched: SelfSearch | None = None,
) -> DataFrame:
    """Add the local outlier factor; ``searched`` as in :func:`knn_scores`."""
    k = min(k, max(1, df.count() - 1))
    distinct, found = searched or self_search(df, id_cols, features, k, cell_rows)
    # Weight of each neighbour vector within the k: one copy of the row itself is not counted.
    used = F.least("w", F.lit(k + 1) - F.col("before")) - (F.col("nid") == F.col("qid")).cast("int")
    near = found.withColumn("used", used).filter("used > 0").select("qid", "nid", "used", "dist")
    reach = near.groupBy("qid").agg(F.max("dist").alias("k_dist"))
    # Neighbours are dealt by their id once; both joins read them where they then lie.
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = keep(near.repartition(max(usual, distinct.count() * k // NEAR_ROWS), "nid"))
    density = written(
        near.join(reach.select(F.col("qid").alias("nid"), "k_dist"), "nid")
        .groupBy("qid")
        .agg(
            (
                1.0 / (F.sum(F.col("used") * F.greatest("dist", "k_dist")) / k + F.lit(1e-10))
            ).alias("lrd")
        )
    )
    scores = (
        near.join(density.select(F.col("qid").alias("nid"), F.col("lrd").alias("lrd_n")), "nid")
        .groupBy("qid")
        .agg((F.sum(F.col("used") * F.col("lrd_n")) / k).alias("around"))
        .join(density, "qid")
        .select("qid", (F.col("around") / F.col("lrd")).alias("score"))
    )
    return _back_to_rows(df, id_cols, features, distinct, scores, name)


def flag_lof(
    df: DataFrame,
    id_cols: Sequence[str],
    features: Sequence[str],
    k: int = LOF_NEIGHBORS,
    contamination: float = CONTAMINATION,
    *,
    name: str = "flag_LOF",
    cell_rows: int = CELL_ROWS,
    searched: SelfSearch | None = None,
) -> DataFrame:
    """Local-density detector: adds ``lof_score`` and the flag."""
    scored = keep(lof_scores(df, id_cols, features, k, cell_rows=cell_rows, searched=searched))
    cut = exact_quantiles(scored, {"s": -F.col("lof_score")}, [contamination])["s"][0]
    return scored.withColumn(name, -F.col("lof_score") < F.lit(cut))


# --- imputation ---------------------------------------------------------------


def impute_knn(
    df: DataFrame,
    id_cols: Sequence[str],
    features: Sequence[str],
    *,
    targets: Sequence[str] | None = None,
    k: int = IMPUTE_NEIGHBORS,
    weights: str = "distance",
    scale: bool = False,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Fill gaps by the (inverse-distance weighted) mean of the k nearest rows having a value.

    Distances use all ``features`` present on both sides. Donors at distance zero outweigh all
    others; a row without any comparable donor gets the column mean. With ``scale`` distances
    are taken on standardised values.
    """
    if weights not in ("distance", "uniform"):
        raise ValueError(f"unknown weights {weights!r}")
    dims, names = len(features), xcols(len(features))
    targets = list(features if targets is None else targets)
    at = [list(features).index(t) for t in targets]
    scaler = Scaler.fit(df, features)
    point = {f: scaler.scaled(f) if scale else num(f) for f in features}
    placed = dict(zip(names, point.values(), strict=True))
    rows = df.select(row_id(id_cols).alias("id"), *[c.alias(x) for x, c in placed.items()])
    distinct = _numbered(rows.groupBy(*names).agg(F.min("id").alias("qid"), F.count("*").alias("n")), names)
    base = distinct.select(F.col("qid").alias("nid"), F.least("n", F.lit(k)).alias("w"), *names)
    gap = F.lit(False)
    for i in at:
        gap = gap | F.col(names[i]).isNull()
    found = search(
        distinct.filter(gap), base, dims, k, targets=at, cell_rows=cell_rows
    )
    used = F.least("w", F.lit(k) - F.col("before"))
    touching = F.col("dist") == 0
    weight = F.lit(1.0) if weights == "uniform" else 1.0 / F.nullif("dist", F.lit(0.0))
    sums = found.groupBy("qid", "target").agg(
        F.sum(F.when(touching, used * F.col("value"))).alias("zero_sum"),
        F.sum(F.when(touching, used)).alias("zero_n"),
        F.sum(used * weight * F.col("value")).alias("weighted"),
        F.sum(used * weight).alias("weight"),
    )
    near = F.col("weighted") / F.col("weight")
    if weights == "distance":
        near = F.coalesce(F.col("zero_sum") / F.col("zero_n"), near)
    filled = sums.select("qid", "target", near.alias("fill"))
    wide = filled.groupBy("qid").agg(
        *[F.max(F.when(F.col("target") == i, F.col("fill"))).alias(f"_gf{i}") for i in at]
    )
    answers = distinct.join(wide, "qid").select(
        *[F.col(x).alias(f"_gy{i}") for i, x in enumerate(names)], *[f"_gf{i}" for i in at]
    )
    same = F.lit(True)
    for i in range(dims):
        same = same & F.col(names[i]).eqNullSafe(F.col(f"_gy{i}"))
    joined = df.withColumns(placed).join(answers, same, "left")
    values = {f: num(f) for f in features}
    for t, i in zip(targets, at, strict=True):
        fill = F.col(f"_gf{i}")
        fill = scaler.unscaled(t, fill) if scale else fill
        values[t] = F.coalesce(num(t), fill, F.lit(scaler.means[i]).cast("double"))
    return joined.withColumns(values).select(*[col(c) for c in df.columns])


def impute(
    df: DataFrame,
    id_cols: Sequence[str],
    features: Sequence[str],
    plan: ImputationPlan | None = None,
    *,
    cell_rows: int = CELL_ROWS,
) -> tuple[DataFrame, ImputationPlan]:
    """Whole imputation by plan: mean and median fills, then neighbours, then the drops."""
    plan = plan or plan_imputation(df, features)
    out = impute_simple(df, plan.mean, plan.median)
    if plan.knn:
        worst = max(missing_fractions(df, plan.knn).values())
        out = impute_knn(
            out, id_cols, plan.kept, targets=plan.knn, scale=worst > SCALE_ABOVE,
            cell_rows=cell_rows,
        )
    return out.drop(*plan.drop), plan

