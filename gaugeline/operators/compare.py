"""Comparing detectors: agreement, calibration, event windows, ground truth and consensus."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, flag, long_form, num, total
from ..functions.fixed_values import CONTAMINATION, EVENT_YEARS, MIN_METHODS, MIN_OBSERVATIONS
from .descriptive import Scaler
from .limits import CLASS2, Limit, violates, violations_expr
from .univariate import METHODS, Profile, method_rules, most_extreme

CATEGORIES = ["strong", "uni_only", "multi_only", "incomplete", "clean"]


def _ratio(part: Column, whole: Column, empty: float) -> Column:
    return F.when(whole == 0, F.lit(empty)).otherwise(part / whole)


def _marks(flags: dict[str, str]) -> dict[str, Column]:
    return {m: flag(col(c)) for m, c in flags.items()}


def jaccard(df: DataFrame, a: str, b: str) -> DataFrame:
    """Shared share of two flags; 1 where neither marks anything."""
    x, y = flag(col(a)), flag(col(b))
    return df.agg(_ratio(F.count_if(x & y), F.count_if(x | y), 1.0).alias("jaccard"))


def _rows_where(condition: Column) -> Column:
    """Rows that meet a condition, in a table of kinds of rows with their number ``n``."""
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0).cast("bigint"))


def _pair_counts(marks: dict[str, Column], count: Callable[[Column], Column] = F.count_if) -> list[Column]:
    names = list(marks)
    return [
        agg.alias(f"{kind}{i}_{j}")
        for i, a in enumerate(names)
        for j, b in enumerate(names)
        if i < j
        for kind, agg in (("b", count(marks[a] & marks[b])), ("u", count(marks[a] | marks[b])))
    ]


def _pair_jaccard(i: int, j: int) -> Column:
    i, j = min(i, j), max(i, j)
    return _ratio(F.col(f"b{i}_{j}"), F.col(f"u{i}_{j}"), 1.0)


def jaccard_matrix(df: DataFrame, flags: dict[str, str]) -> DataFrame:
    """``method_a, method_b, jaccard`` for all ordered pairs, from one aggregate.

    ``flags`` maps method names to flag columns.
    """
    names = list(flags)
    wide = df.agg(*_pair_counts(_marks(flags)))
    cells = [
        F.struct(
            F.lit(a).alias("method_a"),
            F.lit(b).alias("method_b"),
            (F.lit(1.0) if i == j else _pair_jaccard(i, j)).alias("jaccard"),
        )
        for i, a in enumerate(names)
        for j, b in enumerate(names)
    ]
    return wide.select(F.explode(F.array(*cells)).alias("e")).select("e.*")


def mean_agreement(df: DataFrame, flags: dict[str, str]) -> DataFrame:
    """Mean Jaccard of each method with the others."""
    return (
        jaccard_matrix(df, flags)
        .filter(F.col("method_a") != F.col("method_b"))
        .groupBy(F.col("method_a").alias("method"))
        .agg(F.avg("jaccard").alias("mean_agreement"))
    )


def method_scorecard(
    df: DataFrame,
    flags: dict[str, str],
    year: str,
    *,
    target: float = CONTAMINATION,
    window: tuple[int, int] = EVENT_YEARS,
) -> DataFrame:
    """Per method: flags, rate, calibration distance, window recall and precision, agreement."""
    marks, names = _marks(flags), list(flags)
    inside = flag(col(year).between(*window))
    aggs = [F.count("*").alias("n"), F.count_if(inside).alias("n_in")]
    for i, m in enumerate(names):
        aggs += [
            F.count_if(marks[m]).alias(f"f{i}"),
            F.count_if(marks[m] & inside).alias(f"w{i}"),
        ]
    wide = df.agg(*aggs, *_pair_counts(marks))

    def row(i: int) -> dict[str, Column]:
        flagged, hits = F.col(f"f{i}"), F.col(f"w{i}")
        rate = flagged / F.col("n")
        others = [_pair_jaccard(i, j) for j in range(len(names)) if j != i]
        return {
            "n_flags": flagged,
            "rate": F.round(rate, 4),
            "calibration_distance": F.round(F.abs(rate - target), 4),
            "window_recall": F.round(_ratio(hits, F.col("n_in"), 0.0), 3),
            "window_precision": F.round(_ratio(hits, flagged, 0.0), 3),
            "mean_agreement": F.round(total(others) / len(others), 3) if others else F.lit(None),
        }

    return long_form(wide, [], {m: row(i) for i, m in enumerate(names)}, "method")


def overlap_regions(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Rows per combination of flags (the regions of an overlap diagram)."""
    return df.groupBy(*[flag(col(f)).alias(f) for f in flags]).agg(F.count("*").alias("n"))


def flag_rate_by_period(df: DataFrame, flags: dict[str, str], period: str) -> DataFrame:
    """Share of flagged rows per period and method."""
    return df.groupBy(col(period)).agg(
        *[F.avg(c.cast("double")).alias(m) for m, c in _marks(flags).items()]
    )


def best_calibrated(scorecard: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Method closest to the target rate, the first declared on a tie."""
    place = F.array_position(F.array(*[F.lit(m) for m in methods]), F.col("method"))
    return scorecard.orderBy("calibration_distance", place).limit(1)


def flag_f1(df: DataFrame, predicted: str, truth: str) -> DataFrame:
    """Precision, recall and F1 of a flag against ground truth, 0 on empty denominators."""
    p, t = flag(col(predicted)), flag(col(truth))
    counts = df.agg(
        F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn")
    )
    precision = _ratio(F.col("tp"), F.col("tp") + F.col("fp"), 0.0)
    recall = _ratio(F.col("tp"), F.col("tp") + F.col("fn"), 0.0)
    return counts.select(precision.alias("precision"), recall.alias("recall")).withColumn(
        "f1", f1_of(F.col("precision"), F.col("recall"))
    )


def f1_of(precision: Column, recall: Column) -> Column:
    return _ratio(2 * precision * recall, precision + recall, 0.0)


def best_method_per_variable(
    df: DataFrame,
    features: Sequence[str],
    limits: Sequence[Limit] = CLASS2,
    *,
    min_obs: int = MIN_OBSERVATIONS,
) -> DataFrame:
    """All six univariate rules judged per variable.

    The score is F1 against limit violations where there is at least one, else the mean Jaccard
    with the other rules. ``variable, n_obs, method, criterion, winner, score, n_flags,
    precision, recall, f1, mean_jaccard``.
    """
    profile = Profile.fit(df, features, mad=True, medcouple=True, tails=True)
    by_variable = {lim.variable: lim for lim in limits}
    fields = {}
    for c in features:
        truth = violates(by_variable[c]) if c in by_variable else F.lit(False)
        rules = method_rules(profile, c, min_obs)
        fields[c] = {
            "present": num(c).isNotNull(),
            "truth": truth,
            "limited": F.lit(c in by_variable),
            **{f"m{i}": rule for i, rule in enumerate(rules.values())},
        }
    size = len(METHODS)
    marks = {m: F.col(f"m{i}") for i, m in enumerate(METHODS)}
    aggs = [
        _rows_where(F.col("present")).alias("n_obs"),
        _rows_where(F.col("truth")).alias("n_truth"),
        F.any_value("limited").alias("limited"),
    ]
    for i in range(size):
        aggs += [
            _rows_where(F.col(f"m{i}")).alias(f"f{i}"),
            _rows_where(F.col(f"m{i}") & F.col("truth")).alias(f"t{i}"),
        ]
    # Values marked alike are counted first, a few kinds a variable; the many counts run over these.
    kinds = ["variable", "present", "truth", "limited", *[f"m{i}" for i in range(size)]]
    counted = long_form(df, [], fields).groupBy(*kinds).agg(F.count("*").alias("n"))
    judged = counted.groupBy("variable").agg(*aggs, *_pair_counts(marks, _rows_where))
    enough = F.col("n_obs") >= min_obs
    by_truth = F.col("n_truth") >= 1
    criterion = (
        F.when(~enough, "insufficient")
        .when(by_truth, "limit_f1")
        .when(F.col("limited"), "jaccard_no_violation")
        .otherwise("jaccard")
    )
    entries = []
    for i, m in enumerate(METHODS):
        hits, flagged = F.col(f"t{i}"), F.col(f"f{i}")
        precision = _ratio(hits, flagged, 0.0)
        recall = _ratio(hits, F.col("n_truth"), 0.0)
        agreement = total([_pair_jaccard(i, j) for j in range(size) if j != i]) / (size - 1)
        use_f1, use_jac = enough & by_truth, enough & ~by_truth
        entries.append(
            F.struct(
                F.lit(i).alias("place"),
                F.lit(m).alias("method"),
                flagged.alias("n_flags"),
                F.when(use_f1, precision).alias("precision"),
                F.when(use_f1, recall).alias("recall"),
                F.when(use_f1, f1_of(precision, recall)).alias("f1"),
                F.when(use_jac, agreement).alias("mean_jaccard"),
            )
        )
    rows = judged.select(
        "variable", "n_obs", criterion.alias("criterion"), F.explode(F.array(*entries)).alias("e")
    ).select("variable", "n_obs", "criterion", "e.*")
    rows = rows.withColumn("score", F.coalesce("f1", "mean_jaccard"))
    best = Window.partitionBy("variable").orderBy(F.desc("score"), "place")
    winner = F.col("score").isNotNull() & (F.row_number().over(best) == 1)
    return rows.withColumn("winner", winner).select(
        "variable", "n_obs", "method", "criterion", "winner", "score", "n_flags",
        "precision", "recall", "f1", "mean_jaccard",
    )


def method_ranking(best: DataFrame) -> DataFrame:
    """Winning method and score per variable, highest score first."""
    return (
        best.filter("winner")
        .select("variable", "method", "criterion", "score")
        .orderBy(F.desc("score"), "variable")
    )


def method_matrix(best: DataFrame, methods: Sequence[str] = METHODS) -> DataFrame:
    """Variable by method scores."""
    return best.groupBy("variable").pivot("method", list(methods)).agg(F.first("score"))


def classify_layers(
    df: DataFrame, uni: str, multi: str, complete: str, *, name: str = "category"
) -> DataFrame:
    """Two-layer category of each row; the univariate layer still counts on incomplete rows."""
    u, m, c = flag(col(uni)), flag(col(multi)), flag(col(complete))
    return df.withColumn(
        name,
        F.when(~c & u, "uni_only")
        .when(~c, "incomplete")
        .when(u & m, "strong")
        .when(u, "uni_only")
        .when(m, "multi_only")
        .otherwise("clean"),
    )


def category_counts(df: DataFrame, name: str = "category") -> DataFrame:
    """Rows per category in fixed order, absent ones with 0."""
    wide = df.agg(*[F.count_if(col(name) == c).alias(f"n{i}") for i, c in enumerate(CATEGORIES)])
    return long_form(wide, [], {c: {"n": F.col(f"n{i}")} for i, c in enumerate(CATEGORIES)}, name)


def outlier_wide(
    df: DataFrame, flags: Sequence[str], limits: Sequence[Limit] = CLASS2
) -> DataFrame:
    """Add method count and violation counts with and without indicative limits."""
    return df.withColumns(
        {
            "n_methods": total([flag(col(f)).cast("int") for f in flags]).cast("int"),
            "n_violations": violations_expr(df, limits),
            "n_violations_strict": violations_expr(df, limits, exclude_indicative=True),
        }
    )


def outlier_long(
    wide: DataFrame,
    id_cols: Sequence[str],
    flags: dict[str, str],
    features: Sequence[str],
    scaler: Scaler | None = None,
) -> DataFrame:
    """One row per marked row and method, with the most extreme variable of the row."""
    top = most_extreme(wide, features, scaler)
    kept = ["top_variable", "top_value", "top_z", "n_methods", "n_violations"]
    marks = F.array_compact(
        F.array(*[F.when(flag(col(c)), F.lit(m)) for m, c in flags.items()])
    )
    return top.select(
        *[col(c) for c in id_cols], F.explode(marks).alias("method"), *[col(c) for c in kept]
    )


def confirmed_outliers(
    wide: DataFrame,
    flags: dict[str, str],
    *,
    min_methods: int = MIN_METHODS,
    require_violation: bool = True,
) -> DataFrame:
    """Rows marked by enough methods that also violate a non-indicative limit.

    ``methods`` lists who marked the row, in declared order.
    """
    keep_row = F.col("n_methods") >= min_methods
    if require_violation:
        keep_row = keep_row & (F.col("n_violations_strict") > 0)
    named = F.array_compact(F.array(*[F.when(flag(col(c)), F.lit(m)) for m, c in flags.items()]))
    return wide.filter(keep_row).withColumn("methods", F.array_join(named, ", "))


def sort_confirmed(confirmed: DataFrame, date: str) -> DataFrame:
    """Most methods first, then most violations, then date."""
    return confirmed.orderBy(F.desc("n_methods"), F.desc("n_violations_strict"), col(date))


def violations_with_without(confirmed: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """Violation counts with and without indicative limits per confirmed row."""
    return confirmed.select(*[col(c) for c in id_cols], "n_violations", "n_violations_strict")


def confirmed_timeline(
    confirmed: DataFrame, year: str, month_no: str, keep_cols: Sequence[str] = ()
) -> DataFrame:
    """Fractional year and number of methods of each confirmed row."""
    at = col(year) + (col(month_no) - 1) / 12
    return confirmed.select(*[col(c) for c in keep_cols], at.alias("at"), "n_methods")


def flag_counts(
    df: DataFrame, flags: dict[str, str], *, expected: float = CONTAMINATION
) -> DataFrame:
    """Flag count and percent per method next to the expected count."""
    wide = df.agg(
        F.count("*").alias("n"),
        *[F.count_if(m).alias(f"f{i}") for i, m in enumerate(_marks(flags).values())],
    )
    return long_form(
        wide,
        [],
        {
            m: {
                "n_flags": F.col(f"f{i}"),
                "pct": F.col(f"f{i}") / F.col("n") * 100,
                "expected": F.col("n") * F.lit(expected),
            }
            for i, m in enumerate(flags)
        },
        "method",
    )
