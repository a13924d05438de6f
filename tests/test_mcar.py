"""Textbook form of Little's test and maximum-likelihood moments, against dense computation row by row."""

import numpy as np
import pandas as pd
import pytest

from gaugeline.operators import mcar
from tests.conftest import frame


def holed(seed=5, n=240):
    rng = np.random.default_rng(seed)
    y = rng.normal(size=(n, 3)) @ rng.normal(size=(3, 3)) + [10, -4, 1000]
    y[rng.random(y.shape) < 0.2] = np.nan
    return pd.DataFrame(y, columns=list("abc"))


def likeliest(y, rounds=3000):
    """Row-wise expectation-maximisation on the values as they are."""
    y = y[~np.isnan(y).all(axis=1)]
    mu, cov = np.nanmean(y, axis=0), np.diag(np.nanvar(y, axis=0))
    for _ in range(rounds):
        filled, spread = [], np.zeros_like(cov)
        for x in y:
            o, m = ~np.isnan(x), np.isnan(x)
            x = x.copy()
            if m.any():
                b = np.linalg.solve(cov[np.ix_(o, o)], cov[np.ix_(o, m)]).T
                x[m] = mu[m] + b @ (x[o] - mu[o])
                spread[np.ix_(m, m)] += cov[np.ix_(m, m)] - b @ cov[np.ix_(o, m)]
            filled.append(x)
        filled = np.array(filled)
        new = filled.mean(axis=0)
        old, cov = cov, ((filled - new).T @ (filled - new) + spread) / len(y)
        if max(np.abs(new - mu).max(), np.abs(cov - old).max()) < 1e-11:
            break
        mu = new
    return new, cov


def statistic(df, mu, cov):
    chi2, dof = 0.0, -df.shape[1]
    for pattern, part in df.groupby(df.notna().apply(tuple, axis=1)):
        seen = np.flatnonzero(pattern)
        if len(seen):
            d = part.to_numpy()[:, seen].mean(axis=0) - mu[seen]
            chi2 += len(part) * d @ np.linalg.inv(cov[np.ix_(seen, seen)]) @ d
            dof += len(seen)
    return chi2, dof


def test_moments_and_test_by_maximum_likelihood(spark):
    df = holed()
    mu, cov = likeliest(df.to_numpy())
    got_mu, got_cov = mcar.em_moments(frame(spark, df).repartition(5), list("abc"))
    assert np.allclose(got_mu, mu, rtol=1e-7) and np.allclose(got_cov, cov, rtol=1e-6, atol=1e-7)
    chi2, dof = statistic(df, mu, cov)
    row = mcar.little_test(frame(spark, df), list("abc")).first()
    assert row.chi2 == pytest.approx(chi2, abs=2e-3) and row.df == dof and 0 <= row.p_value <= 1


def test_pairwise_moments(spark):
    df = holed(8)
    chi2, dof = statistic(df, df.mean().to_numpy(), df.cov().to_numpy())
    row = mcar.little_test(frame(spark, df), list("abc"), moments="pairwise").first()
    assert row.chi2 == pytest.approx(chi2, abs=2e-3) and row.df == dof


def test_gaps_that_depend_on_values_are_found(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=500)
    b = a + rng.normal(size=500)
    df = pd.DataFrame({"a": a, "b": np.where(a > 0.5, np.nan, b)})
    assert mcar.little_test(frame(spark, df), ["a", "b"]).first().p_value < 1e-4
    df["b"] = np.where(rng.random(500) < 0.3, np.nan, b)
    assert mcar.little_test(frame(spark, df), ["a", "b"]).first().p_value > 1e-3


def test_tables_without_gaps_values_or_rows(spark):
    whole = frame(spark, holed().fillna(1.0))
    row = mcar.little_test(whole, list("abc")).first()
    assert row.chi2 == pytest.approx(0, abs=1e-3) and row.df == 1
    assert list(mcar.little_test(whole.limit(0), list("abc")).first()) == [None, None, None]
    mu, cov = mcar.em_moments(whole.limit(0), list("abc"))
    assert (mu == 0).all() and (cov == np.eye(3)).all()
    with pytest.raises(ArithmeticError):
        mcar.em_moments(frame(spark, holed()), list("abc"), rounds=1)
