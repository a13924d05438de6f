"""Verdicts on URLs by rules and, where none fits, by per-host trees of path templates. DataFrame operations only.

Path segments that are numbers, hex codes or mixed codes become wildcards by their form; a position of a host's tree
whose segments are many and rarely seen becomes a wildcard too. Sibling branches whose distributions of what follows are
alike are merged under the most frequent one. URLs that a rule decides are the labels: a template is rejected if its share of
blocked URLs, smoothed by a prior, is high. All tree work is on counted shapes, far fewer than URLs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col, store

# The rules of the registered query, as action, host and path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; empty without one."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without a host part."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its action; null where none does."""
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):  # later ones, longer, go around earlier ones
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text = F.when(fits, F.lit(h + p)).otherwise(text)
        action = F.when(fits, F.lit(act)).otherwise(action)
    return text, action


def _form(segment: Column) -> Column:
    return (
        F.when(segment.rlike(r"^[0-9]+(\.[a-z]+)?$"), F.regexp_replace(segment, "^[0-9]+", "{n}"))
        .when(segment.rlike(r"^[0-9a-f]{8,}$"), F.lit("{h}"))
        .when(segment.rlike("[0-9]"), F.lit("{m}"))
        .otherwise(segment)
    )


def _steps(table: DataFrame, path: str) -> DataFrame:
    """A row per segment of each path: ``at``, ``prefix`` (the path before it), ``child`` and ``rest`` (the path after it)."""
    parts = table.withColumn("_s", F.split(col(path), "/", -1))
    return parts.select("*", F.posexplode("_s").alias("at", "child")).select(
        *[c for c in parts.columns if c != "_s"], "at", "child",
        F.array_join(F.slice("_s", F.lit(1), F.col("at")), "/").alias("prefix"),
        F.when(F.col("at") < F.size("_s") - 1, F.array_join(F.expr("slice(_s, at + 2, size(_s))"), "/")).alias("rest"),
    )


def _rebuilt(steps: DataFrame, keys: list[str], segment: Column) -> DataFrame:
    """Paths put together again from the segments of ``steps``; a path's segments are bounded by its length."""
    parts = steps.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("at", segment.alias("s")))).alias("_p"))
    return parts.withColumn("built", F.array_join(F.transform("_p", lambda x: x["s"]), "/")).drop("_p")


def template_verdicts(
    shapes: DataFrame, *, many: int = 10, seen: float = 5.0, distance: float = 0.1, prior: float = 0.2, weight: float = 10.0,
    reject: float = 0.8,
) -> DataFrame:
    """Template and purity of counted shapes (``host``, ``shape``, ``n``, ``blocked``, ``allowed``): adds ``template``, ``impurity``
    (smoothed share of blocked URLs) and ``verdict``.

    A position is a wildcard if it has ``many`` or more different segments seen fewer than ``seen`` times on average.
    A branch joins its largest sibling if the total variation distance between what follows them is at most ``distance``
    plus the sampling error ``sqrt(1/n + 1/m)``; branches that nothing follows stay apart. Ties go to the smaller text.
    """
    steps = _steps(shapes, "shape")
    children = steps.groupBy("host", "at", "prefix", "child").agg(F.sum("n").alias("n"))
    varied = children.groupBy("host", "at", "prefix").agg(F.count(F.lit(1)).alias("_k"), F.sum("n").alias("_n")).filter(
        (F.col("_k") >= many) & (F.col("_n") < F.col("_k") * F.lit(float(seen)))
    ).select("host", "at", "prefix", F.lit(True).alias("_varies"))
    general = _rebuilt(
        steps.join(varied, ["host", "at", "prefix"], "left"), ["host", "shape"],
        F.when(F.col("_varies"), F.lit("{*}")).otherwise(F.col("child")),
    ).withColumnRenamed("built", "general")
    tree = store(shapes.join(general, ["host", "shape"]), "url-tree")

    leaves = tree.groupBy("host", "general").agg(F.sum("n").alias("n"))
    branches = _steps(leaves, "general")
    spread = branches.filter(F.col("rest").isNotNull()).groupBy("host", "at", "prefix", "child", "rest").agg(F.sum("n").alias("n"))
    sizes = spread.groupBy("host", "at", "prefix", "child").agg(F.sum("n").alias("size"))
    largest = sizes.withColumn("_r", F.row_number().over(W.partitionBy("host", "at", "prefix").orderBy(F.desc("size"), "child"))) \
        .filter("_r = 1").select("host", "at", "prefix", F.col("child").alias("anchor"), F.col("size").alias("anchor_size"))
    shares = spread.join(sizes, ["host", "at", "prefix", "child"]).join(largest, ["host", "at", "prefix"])
    anchors = shares.filter(F.col("child") == F.col("anchor")).select("host", "at", "prefix", "rest", (F.col("n") / F.col("size")).alias("_q"))
    alike = (
        shares.join(anchors, ["host", "at", "prefix", "rest"])
        .groupBy("host", "at", "prefix", "child", "anchor", "size", "anchor_size")
        .agg(F.sum(F.least(F.col("n") / F.col("size"), F.col("_q"))).alias("_overlap"))
        .filter(1 - F.col("_overlap") <= F.lit(distance) + F.sqrt(1 / F.col("size") + 1 / F.col("anchor_size")))
        .select("host", "at", "prefix", "child", "anchor")
    )
    merged = _rebuilt(
        branches.select("host", "general", "at", "prefix", "child").join(alike, ["host", "at", "prefix", "child"], "left"),
        ["host", "general"], F.coalesce("anchor", "child"),
    ).withColumnRenamed("built", "template")
    placed = tree.join(merged, ["host", "general"])
    purity = placed.groupBy("host", "template").agg(F.sum("blocked").alias("_b"), F.sum("allowed").alias("_a")).select(
        "host", "template",
        ((F.col("_b") + F.lit(weight * prior)) / (F.col("_b") + F.col("_a") + F.lit(weight))).alias("impurity"),
    )
    return placed.select("host", "shape", "template").join(purity, ["host", "template"]).withColumn(
        "verdict", F.when(F.col("impurity") >= reject, "block").otherwise("allow")
    )


def judge_urls(pages: DataFrame, *, id: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES,
               **options) -> DataFrame:
    """One row per row: ``id``, ``host``, ``path``, ``rule`` (the longest that fits, else null), ``verdict`` (the rule's, else
    ``block`` for a rejected template and ``allow`` otherwise) and ``template``.

    A null URL, or one without ``://``, has an empty host and path. Repeated rows count as often as they stand; an empty
    table gives no rows. Without labels a template is allowed.
    """
    host, path = host_of(F.col("_u")), path_of(F.col("_u"))
    rows = pages.select(col(id).alias("_id"), col(url).alias("_u")).select("_id", host.alias("host"), path.alias("path"))
    text, action = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({
        "rule": text, "_action": action,
        "shape": F.array_join(F.transform(F.split("path", "/", -1), _form), "/"),
    })
    shapes = rows.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("_action") == "block", 1)).alias("blocked"),
        F.count(F.when(F.col("_action") == "allow", 1)).alias("allowed"),
    )
    known = template_verdicts(store(shapes, "url-shapes"), **options)
    return rows.join(known, ["host", "shape"], "left").select(
        F.col("_id").alias(id), "host", "path", "rule", F.coalesce("_action", "verdict", F.lit("allow")).alias("verdict"), "template"
    )
