"""Absorbed effects against dense dummies, against numpy with 50,000 levels, and level numbers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberfield.operators.absorbed import fit_absorbed
from emberfield.operators.levels import level_numbers, one_hot_sparse
from emberfield.operators.regression import fit_ols, nested_rsquared
from tests.test_regression import data  # noqa: F401


def agree(fit, whole, tol=1e-7):
    """The absorbed fit against the terms that it shares with the fit with dummies."""
    at = [whole.terms.index(t) for t in fit.terms]
    assert fit.coef == pytest.approx(whole.coef[at], rel=tol, abs=1e-9)
    assert fit.cov == pytest.approx(whole.cov[np.ix_(at, at)], rel=1e-5, abs=1e-12)
    assert (fit.n, fit.rank, fit.full_leverage_rows) == (whole.n, whole.rank, whole.full_leverage_rows)
    assert fit.rsquared == pytest.approx(whole.rsquared, rel=1e-9)


@pytest.mark.parametrize("cov", ["HC3", "classic"])
def test_equals_the_fit_with_dummies(spark, data, cov):  # noqa: F811
    df = spark.createDataFrame(data)
    fits = fit_absorbed(df, "y", ["x1", "x2"], ["c1"], absorb="cat", strata="s", cov=cov).fits
    whole = fit_ols(df, "y", ["x1", "x2"], ["c1"], category="cat", strata="s", cov=cov)
    assert fits.keys() == whole.keys()
    for s, fit in fits.items():
        agree(fit, whole[s])
        assert fit.fvalue == pytest.approx(whole[s].fvalue, rel=1e-6)
        assert fit.f_pvalue == pytest.approx(whole[s].f_pvalue, rel=1e-6, abs=1e-300)
        assert nested_rsquared(fit, ["x1", "x2"]) == pytest.approx(nested_rsquared(whole[s], ["x1", "x2"]), rel=1e-9)


def test_level_with_one_row_and_copied_column(spark, data):  # noqa: F811
    lone = pd.concat([data, data.head(1).assign(cat="050", y=50.0)], ignore_index=True)
    df = spark.createDataFrame(lone).withColumn("x3", 3 * F.col("x1") - 7)
    fit = fit_absorbed(df, "y", ["x1", "x2"], absorb="cat").fits["all"]
    agree(fit, fit_ols(df, "y", ["x1", "x2"], category="cat")["all"])
    # The single row decides nothing but its own intercept, so the test is that of the other rows.
    rest = fit_ols(df.where("cat != '050'"), "y", ["x1", "x2"], category="cat")["all"]
    assert fit.restrictions == 5
    assert fit.full_leverage_rows == 1
    slopes = fit_absorbed(df.where("cat != '050'"), "y", ["x1", "x2"], absorb="cat").fits["all"]
    assert slopes.fvalue == pytest.approx(rest.fvalue, rel=1e-6)
    twice = fit_absorbed(df, "y", ["x1", "x2", "x3"], absorb="cat").fits["all"]
    assert (twice.rank, twice.restrictions) == (fit.rank, fit.restrictions)
    assert twice.fvalue == pytest.approx(fit.fvalue, rel=1e-6)


def test_column_constant_in_every_level(spark, data):  # noqa: F811
    df = spark.createDataFrame(data).withColumn("own", F.length("cat") + (F.col("cat") == "110").cast("int"))
    fit = fit_absorbed(df, "y", ["x1"], ["own"], absorb="cat").fits["all"]
    plain = fit_absorbed(df, "y", ["x1"], absorb="cat").fits["all"]
    assert fit.rank == plain.rank and fit.coef[2] == pytest.approx(0, abs=1e-9)
    assert fit.coef[1] == pytest.approx(plain.coef[1], rel=1e-9)


def test_fifty_thousand_levels(spark):
    """One level holds a third of the rows; numpy demeans with dense level numbers."""
    rnd = np.random.default_rng(8)
    n, g = 200_000, 50_000
    level = np.where(rnd.random(n) < 0.34, 7, rnd.integers(0, g, n))
    level[:g] = np.arange(g)
    x1, x2 = rnd.normal(3, 2, n) + level / g, rnd.normal(0, 1, n)
    y = 2 * x1 - x2 + rnd.normal(0, 1, g)[level] + rnd.normal(0, 1 + (x2 > 0), n)
    df = spark.createDataFrame(pd.DataFrame({"l": [f"{v:05d}" for v in level], "x1": x1, "x2": x2, "y": y}))
    got = fit_absorbed(df, "y", ["x1", "x2"], absorb="l")
    size = np.bincount(level)

    def within(v):
        return v - (np.bincount(level, v) / size)[level]

    z = np.array([(v - v.mean()) / v.std(ddof=1) for v in (x1, x2)]).T
    x, yd = np.array([within(z[:, 0]), within(z[:, 1])]).T, within(y)
    inv = np.linalg.inv(x.T @ x)
    b = inv @ x.T @ yd
    e, room = yd - x @ b, 1 - 1 / size[level] - np.einsum("ij,jk,ik->i", x, inv, x)
    w = np.where(room > 1e-10, e / np.where(room > 1e-10, room, 1), 0) ** 2
    v = inv @ ((x * w[:, None]).T @ x) @ inv
    fit = got.fits["all"]
    assert fit.coef[1:] == pytest.approx(b, rel=1e-8)
    assert fit.se[1:] == pytest.approx(np.sqrt(np.diag(v)), rel=1e-6)
    assert fit.rsquared == pytest.approx(1 - e @ e / ((y - y.mean()) ** 2).sum(), rel=1e-9)
    assert fit.rank == 2 + len(np.unique(level)) and fit.full_leverage_rows == (size == 1).sum()
    effects = {int(r["level"]): r for r in got.effects.where(F.col("level").isin("00007", "00123")).collect()}
    for at in (7, 123):
        want = y[level == at].mean() - z[level == at].mean(0) @ b
        assert effects[at]["intercept"] == pytest.approx(want, rel=1e-8) and effects[at]["n"] == size[at]


def test_no_rows(spark, data):  # noqa: F811
    got = fit_absorbed(spark.createDataFrame(data).where("false"), "y", ["x1"], absorb="cat")
    assert got.fits == {} and got.effects.count() == 0


def test_level_numbers_over_many_ranges(spark):
    df = spark.range(0, 30_000, numPartitions=7).select((F.col("id") * 7919 % 10_007).alias("k"))
    got = {r["level"]: r["number"] for r in level_numbers(df, "k").collect()}
    assert got == {v: i for i, v in enumerate(sorted(got))} and len(got) == 10_007


def test_one_hot_sparse(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("b",)], "k string")
    got = sorted(map(str, ((r["k"], tuple(r["v"])) for r in one_hot_sparse(df, "k", "v").collect())))
    assert got == sorted(map(str, [("a", (2, [], [])), ("b", (2, [0], [1.0])), ("b", (2, [0], [1.0])),
                                   ("c", (2, [1], [1.0])), (None, (2, [], []))]))
    assert one_hot_sparse(df, "k", drop_first=False).where("k = 'a'").first()["k_vector"]["indices"] == [0]
    empty = one_hot_sparse(df.where("false"), "k")
    assert empty.columns == ["k", "k_vector"] and empty.count() == 0
