"""Gap profile, decisions, imputation and Little's test."""

import math

import numpy as np
import pandas as pd
import pytest
from conftest import frame

from gaugeline.functions.columns import num
from gaugeline.functions.quantiles import exact_quantiles
from gaugeline.operators import missing
from gaugeline.operators.neighbors import impute, impute_knn

ABC = ["a", "b", "c"]


def test_plan_by_band(gaps):
    plan = missing.plan_imputation(gaps, ABC)
    assert plan.drop == ["c"] and plan.knn == ["a"] and plan.mean == ["b"]
    rows = missing.missing_summary(gaps, ABC).collect()
    assert [r.variable for r in rows] == ["c", "a", "b"]
    assert rows[0].pct_missing == 70.0


def test_skew_is_corrected(gaps, spark):
    x = [1.0, 2.0, 3.0, 4.0, 6.0, 7.0, 8.0, 9.0, 100.0]
    got = {r.variable: r.skew for r in missing.missing_summary(gaps, ["a"]).collect()}
    assert got["a"] == round(float(pd.Series(x).skew()), 2)


def test_impute_drops_and_fills(gaps):
    out, plan = impute(gaps, ["id"], ABC)
    assert out.columns == ["id", "a", "b"]
    assert out.filter("a is null or b is null").count() == 0
    check = missing.validate_imputation(gaps, out, plan.kept).collect()
    assert {r.variable for r in check} == {"a", "b"} and check[0].delta_std_pct is not None


def test_id_survives_and_lonely_column_gets_mean(spark):
    rows = [(i, None if i == 5 else float(i + 1)) for i in range(11)]
    out, _ = impute(spark.createDataFrame(rows, "id int, x double"), ["id"], ["x"])
    values = {r.id: r.x for r in out.collect()}
    assert len(values) == 11 and values[5] == pytest.approx(np.mean([r[1] for r in rows if r[1]]))


def brute_impute(y, k=5):
    out, n = y.copy(), len(y)
    for i in range(n):
        gap = np.isnan(y[i])
        both = ~np.isnan(y) & ~gap
        shared = both.sum(1)
        with np.errstate(all="ignore"):
            d = np.sqrt(np.where(both, (y - y[i]) ** 2, 0).sum(1) * y.shape[1] / shared)
        for t in np.flatnonzero(gap):
            near = sorted((d[j], j) for j in range(n) if not np.isnan(y[j, t]) and shared[j])[:k]
            if not near:
                out[i, t] = np.nanmean(y[:, t])
                continue
            dist, v = np.array([x[0] for x in near]), y[[x[1] for x in near], t]
            w = (dist == 0).astype(float) if (dist == 0).any() else 1 / dist
            out[i, t] = (w * v).sum() / w.sum()
    return out


@pytest.mark.parametrize("scale", [False, True])
def test_knn_imputation_matches_brute_force(spark, scale):
    rng = np.random.default_rng(3)
    y = rng.normal(size=(300, 4)) * [1, 10, 2, 5]
    y[:100] = y[0]
    y[rng.random(y.shape) < [0.15, 0.1, 0.0, 0.3]] = np.nan
    pdf = pd.DataFrame(y, columns=["p", "q.q", "r", "s"])
    pdf.insert(0, "id", np.arange(len(y)))
    got = impute_knn(frame(spark, pdf), ["id"], list(pdf.columns[1:]), scale=scale, cell_rows=40)
    got = got.toPandas().sort_values("id")[list(pdf.columns[1:])].to_numpy()
    m, s = (np.nanmean(y, 0), np.nanstd(y, 0)) if scale else (0.0, 1.0)
    assert np.allclose(got, brute_impute((y - m) / s) * s + m, rtol=1e-9)


def test_chi_square_tail():
    assert missing.chi2_tail(327.6, 269) == pytest.approx(0.00839, abs=2e-5)
    assert missing.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert missing.chi2_tail(0.5, 10) == pytest.approx(0.99999, abs=1e-5)


def test_little_matches_direct_computation(spark):
    rng = np.random.default_rng(5)
    y = rng.normal(size=(200, 3)) @ rng.normal(size=(3, 3))
    y[rng.random(y.shape) < 0.2] = np.nan
    df = pd.DataFrame(y, columns=list("abc"))
    inv = np.linalg.pinv(df.cov().fillna(0).to_numpy() + np.eye(3) * 1e-6)
    chi2, dof = 0.0, -3
    for pattern, part in df.groupby(df.notna().apply(tuple, axis=1)):
        seen = np.flatnonzero(pattern)
        if not len(seen):
            continue
        diff = (part.mean() - df.mean()).to_numpy()[seen]
        chi2 += len(part) * diff @ inv[np.ix_(seen, seen)] @ diff
        dof += len(seen)
    row = missing.little_mcar(frame(spark, df), list("abc")).first()
    assert row.chi2 == pytest.approx(chi2, abs=1e-3) and row.df == dof
    assert 0 <= row.p_value <= 1


def test_quantiles_with_bounded_memory(spark):
    rng = np.random.default_rng(7)
    n = 60_000
    pdf = pd.DataFrame({
        "smooth": rng.normal(size=n),
        # a third of all rows share one value
        "hot": np.where(rng.random(n) < 0.34, 2.0, rng.exponential(size=n)),
        "few": rng.integers(0, 4, n).astype(float),
        "gaps": np.where(rng.random(n) < 0.5, np.nan, rng.normal(size=n)),
    })
    df = spark.createDataFrame(pdf).repartition(7)
    probs = [0.0, 0.01, 0.25, 0.5, 0.93, 1.0]
    got = exact_quantiles(df, {c: num(c) for c in pdf}, probs, accuracy=50, budget=1)
    for c in pdf:
        assert np.allclose(got[c], pdf[c].quantile(probs), rtol=0, atol=1e-12), c
    assert exact_quantiles(df.limit(0), {"smooth": num("smooth")}, [0.5]) == {"smooth": [None]}
    assert not math.isnan(got["gaps"][0])
