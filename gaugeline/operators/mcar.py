"""Little's test in its textbook form, and maximum-likelihood moments of a table with gaps.

Everything comes from one grouping by presence pattern: rows, sums and sums of products per pattern. That table stays
distributed; each round of expectation-maximisation is one job over it that brings p + p² sums to the driver. Variables are
standardised first, which changes neither the test nor the moments after scaling back.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import missing_fraction, num
from ..functions.session import keep
from .missing import chi2_tail, pattern_key


def _standard(df: DataFrame, features: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation per variable; deviation 1 where there is none."""
    row = df.agg(*[f(num(c)) for c in features for f in (F.avg, F.stddev_samp)]).first()
    mean = np.array([m if m is not None else 0.0 for m in row[::2]], float)
    std = np.array([s if s else 1.0 for s in row[1::2]], float)
    std[~(std > 0)] = 1.0
    return mean, std


def pattern_moments(df: DataFrame, features: Sequence[str], mean: np.ndarray, std: np.ndarray) -> DataFrame:
    """``seen``, ``n``, ``s``, ``q`` per presence pattern: sums and upper-triangle sums of products of standardised values,
    0 where a variable is not seen. Rows without any value are left out."""
    p = len(features)
    z = [f"z{i}" for i in range(p)]
    scaled = df.select(*[((num(c) - float(mean[i])) / float(std[i])).alias(z[i]) for i, c in enumerate(features)])
    sums = [F.coalesce(F.sum(c), F.lit(0.0)).alias(f"s_{c}") for c in z]
    products = [
        F.coalesce(F.sum(F.col(z[i]) * F.col(z[j])), F.lit(0.0)).alias(f"q_{i}_{j}") for i in range(p) for j in range(i, p)
    ]
    grouped = scaled.groupBy(pattern_key(z).alias("seen")).agg(F.count(F.lit(1)).alias("n"), *sums, *products)
    return grouped.filter(F.col("seen").contains("1")).select(
        "seen", F.col("n").cast("double").alias("n"), F.array(*[f"s_{c}" for c in z]).alias("s"),
        F.array(*[f"q_{i}_{j}" for i in range(p) for j in range(i, p)]).alias("q"),
    )


def _square(upper: np.ndarray, p: int) -> np.ndarray:
    q = np.zeros((p, p))
    q[np.triu_indices(p)] = upper
    return q + np.triu(q, 1).T


def _sums(patterns: DataFrame, size: int, part_of) -> np.ndarray:
    """Sum over all patterns of the vector that ``part_of`` gives for a pattern."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros(size)
        for part in parts:
            for seen, n, s, q in zip(part["seen"], part["n"], part["s"], part["q"], strict=True):
                acc += part_of(np.frombuffer(seen.encode(), np.uint8) == ord("1"), n, np.asarray(s, float), np.asarray(q, float))
        yield pd.DataFrame({"i": np.arange(size), "v": acc})

    out = np.zeros(size)
    for r in patterns.mapInPandas(run, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out


def _likeliest(patterns: DataFrame, p: int, tolerance: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    mu, cov = np.zeros(p), np.eye(p)

    def completed(seen: np.ndarray, n: float, s: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Expected count, sums and sums of products of a pattern's rows with their gaps filled in."""
        fill, rest, spread = np.diag(seen.astype(float)), np.zeros(p), np.zeros((p, p))
        gone = ~seen
        if gone.any():
            slope = cov[np.ix_(gone, seen)] @ np.linalg.pinv(cov[np.ix_(seen, seen)], hermitian=True)
            fill[np.ix_(gone, seen)] = slope
            rest[gone] = mu[gone] - slope @ mu[seen]
            spread[np.ix_(gone, gone)] = cov[np.ix_(gone, gone)] - slope @ cov[np.ix_(seen, gone)]
        shift = np.outer(fill @ s, rest)
        second = fill @ _square(q, p) @ fill.T + shift + shift.T + n * (np.outer(rest, rest) + spread)
        return np.concatenate([[n], fill @ s + n * rest, second.ravel()])

    for _ in range(rounds):
        got = _sums(patterns, 1 + p + p * p, completed)
        if not got[0]:
            break
        mean = got[1 : 1 + p] / got[0]
        moved = got[1 + p :].reshape(p, p) / got[0] - np.outer(mean, mean)
        step = max(np.abs(mean - mu).max(), np.abs(moved - cov).max())
        mu, cov = mean, moved
        if step < tolerance:
            return mu, cov
    else:
        raise ArithmeticError(f"no fixed point within {rounds} rounds at tolerance {tolerance}")
    return mu, cov


def em_moments(
    df: DataFrame, features: Sequence[str], *, tolerance: float = 1e-9, rounds: int = 1000
) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood mean and covariance of normal variables with gaps, by expectation-maximisation.

    Rows without any value say nothing and are left out; a table without values gives mean 0 and the unit matrix. It is an
    error if ``rounds`` rounds do not settle within ``tolerance`` standard deviations.
    """
    mean, std = _standard(df, features)
    patterns = keep(pattern_moments(df, features, mean, std))
    try:
        mu, cov = _likeliest(patterns, len(features), tolerance, rounds)
    finally:
        patterns.unpersist()
    return mean + std * mu, cov * np.outer(std, std)


def little_test(
    df: DataFrame, features: Sequence[str], *, moments: str = "em", min_observed: float = 0.5, tolerance: float = 1e-9,
    rounds: int = 1000,
) -> DataFrame:
    """Textbook test that gaps are completely random: ``chi2, df, p_value``.

    A pattern adds n·d'S⁻¹d, with d the distance of its means from the table's and S the covariance of the variables it
    holds. ``moments`` are maximum-likelihood ones (``"em"``) or means and sample covariances of all rows that hold both
    variables (``"pairwise"``). Variables seen in fewer than ``min_observed`` of the rows are left out; below two variables
    all three results are null.
    """
    if moments not in ("em", "pairwise"):
        raise ValueError(f"unknown moments {moments!r}")
    spark, schema = df.sparkSession, "chi2 double, df bigint, p_value double"
    row = df.agg(*[missing_fraction(num(c)).alias(f"f{i}") for i, c in enumerate(features)]).first()
    cols = [c for c, f in zip(features, row, strict=True) if f is not None and 1 - f >= min_observed]
    p = len(cols)
    if p < 2:
        return spark.createDataFrame([(None, None, None)], schema)
    mean, std = _standard(df, cols)
    patterns = keep(pattern_moments(df, cols, mean, std))
    try:
        if moments == "em":
            mu, cov = _likeliest(patterns, p, tolerance, rounds)
        else:
            mu = np.zeros(p)
            pairs = [(i, j) for i in range(p) for j in range(i, p)]
            got = df.agg(*[F.covar_samp(num(cols[i]) / float(std[i]), num(cols[j]) / float(std[j])) for i, j in pairs]).first()
            cov = _square(np.array([0.0 if v is None or v != v else v for v in got]), p)

        def apart(seen: np.ndarray, n: float, s: np.ndarray, _: np.ndarray) -> np.ndarray:
            d = s[seen] / n - mu[seen]
            return np.array([n * d @ np.linalg.pinv(cov[np.ix_(seen, seen)], hermitian=True) @ d, seen.sum()])

        chi2, observed = _sums(patterns, 2, apart)
    finally:
        patterns.unpersist()
    dof = max(int(observed) - p, 1)
    return spark.createDataFrame([(round(float(chi2), 3), dof, round(chi2_tail(float(chi2), dof), 5))], schema)
