"""Rank correlation by the distributed scan against brute force."""

import numpy as np
import pandas as pd
import pytest
from conftest import frame

from gaugeline.operators.descriptive import corr_matrix
from gaugeline.operators.ranks import rank_correlation


def brute(pdf, a, b):
    both = pdf[[a, b]].dropna()
    return both[a].rank().corr(both[b].rank())


@pytest.mark.parametrize("range_values", [1_000_000, 20])
def test_ties_gaps_and_hot_values(spark, range_values):
    rng = np.random.default_rng(3)
    n = 600
    pdf = pd.DataFrame({"a": rng.normal(size=n), "b": rng.integers(0, 5, n) * 1.0, "c": np.where(rng.random(n) < 0.4, 0.0, rng.normal(size=n)),
                        "d e": rng.normal(size=n) ** 3})
    pdf["d e"] += pdf["a"]
    for c in pdf:
        pdf.loc[rng.random(n) < 0.15, c] = np.nan
    pdf.loc[:3, "a"] = [np.inf, -np.inf, -0.0, 0.0]
    pdf["x"] = 1.0
    pdf["none"] = np.nan
    df = frame(spark, pd.concat([pdf, pdf[:200]], ignore_index=True))
    whole = pd.concat([pdf, pdf[:200]], ignore_index=True)
    got = {(r.var_a, r.var_b): r["corr"] for r in rank_correlation(df, list(pdf.columns), range_values=range_values).collect()}
    assert not any("none" in pair for pair in got) and len(got) == 10
    for (a, b), value in got.items():
        if "x" in (a, b):
            assert value is None
        else:
            assert value == pytest.approx(brute(whole, a, b), abs=1e-12)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "a double, b double")
    assert corr_matrix(empty, ["a", "b"], "spearman").count() == 0
