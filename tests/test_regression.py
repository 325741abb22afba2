"""Fits against dense least squares in numpy."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberfield.operators import absorbed, regression
from emberfield.operators.design import (
    model_input, model_input_counts, one_hot, quartile_profile, sample_summary, with_quartile, zscore)
from emberfield.operators.regression import coefficient_table, f_tail, fit_ols, nested_rsquared


@pytest.fixture(scope="module")
def data():
    rnd = np.random.default_rng(4)
    n = 3000
    x = rnd.normal(50_000, 9000, n)
    pdf = pd.DataFrame({
        "x1": x, "x2": 0.3 * x / 9000 + rnd.normal(0, 1, n), "c1": rnd.integers(0, 24, n).astype(float),
        "cat": rnd.choice(["101", "110", "150", "199"], n, p=[0.7, 0.2, 0.09, 0.01]),
        "s": rnd.choice(["fire", "ems"], n), "cl": rnd.integers(0, 40, n)})
    noise = rnd.normal(0, 1 + 2 * (pdf["cat"] == "110"), n) + 0.3 * pdf["cl"] / 40
    pdf["y"] = 5 + 0.0001 * pdf["x1"] - 0.4 * pdf["x2"] + 0.02 * pdf["c1"] + 1.5 * (pdf["cat"] == "150") + noise
    return pdf


def dense(pdf, z, c=(), cat=None, levels=None, cov="HC3", cluster=None):
    """Design matrix with all dummies as columns, pseudo-inverse and the textbook covariances."""
    cols = [np.ones(len(pdf))]
    cols += [((pdf[k] - pdf[k].mean()) / pdf[k].std()).values for k in z] + [pdf[k].values for k in c]
    if cat:
        cols += [(pdf[cat] == v).values.astype(float) for v in (levels or sorted(pdf[cat].unique()))[1:]]
    X, y = np.array(cols).T, pdf["y"].values
    inv = np.linalg.pinv(X.T @ X)
    b = inv @ X.T @ y
    e, (n, p) = y - X @ b, X.shape
    if cov == "HC3":
        h = np.einsum("ij,jk,ik->i", X, inv, X)
        v = inv @ ((X * ((e / (1 - h)) ** 2)[:, None]).T @ X) @ inv
    elif cov == "classic":
        v = inv * (e @ e) / (n - p)
    else:
        s = pd.DataFrame(X * e[:, None]).groupby(pdf[cluster].values).sum().values
        g = len(s)
        v = inv @ (s.T @ s) @ inv * g / (g - 1) * (n - 1) / (n - p)
    return b, v, 1 - (e @ e) / ((y - y.mean()) ** 2).sum(), X


def same(fit, want, tol=1e-7):
    b, v, r2, X = want
    assert fit.coef == pytest.approx(b, rel=tol, abs=1e-9)
    assert fit.se == pytest.approx(np.sqrt(np.diag(v)), rel=tol, abs=1e-9)
    assert fit.rsquared == pytest.approx(r2, rel=1e-9)
    n, p = X.shape
    assert fit.rsquared_adj == pytest.approx(1 - (1 - r2) * (n - 1) / (n - np.linalg.matrix_rank(X)))


@pytest.mark.parametrize("cov", ["HC3", "classic"])
def test_controls_and_dummies(spark, data, cov):
    df = spark.createDataFrame(data)
    fit = fit_ols(df, "y", ["x1", "x2"], ["c1"], category="cat", prefix="fcode", cov=cov)["all"]
    same(fit, dense(data, ["x1", "x2"], ["c1"], "cat", cov=cov))
    assert fit.terms == ["const", "x1", "x2", "c1", "fcode_110", "fcode_150", "fcode_199"]


def test_strata_in_one_pass(spark, data):
    fits = fit_ols(spark.createDataFrame(data), "y", ["x1", "x2"], ["c1"], category="cat", strata="s")
    for name, part in data.groupby("s"):
        same(fits[name], dense(part, ["x1", "x2"], ["c1"], "cat"))


def test_cluster_errors(spark, data):
    fit = fit_ols(spark.createDataFrame(data), "y", ["x1", "x2"], ["c1"], cov="cluster", cluster="cl")["all"]
    same(fit, dense(data, ["x1", "x2"], ["c1"], cov="cluster", cluster="cl"))


def test_fixed_levels_with_an_empty_one(spark, data):
    levels = ["101", "110", "120", "150", "199"]
    fit = fit_ols(spark.createDataFrame(data), "y", ["x1"], [], category="cat", levels=levels)["all"]
    assert fit.coef[fit.terms.index("cat_120")] == pytest.approx(0, abs=1e-9)
    keep = [i for i, t in enumerate(fit.terms) if t != "cat_120"]
    b, v, r2, _ = dense(data, ["x1"], [], "cat")
    assert fit.coef[keep] == pytest.approx(b, rel=1e-7)
    assert fit.se[keep] == pytest.approx(np.sqrt(np.diag(v)), rel=1e-7)
    assert fit.df_resid == len(data) - len(keep)


def test_level_with_one_row_is_counted(spark, data):
    lone = pd.concat([data, data.head(1).assign(cat="999", y=50.0)], ignore_index=True)
    fit = fit_ols(spark.createDataFrame(lone), "y", ["x1"], category="cat")["all"]
    assert fit.full_leverage_rows == 1
    assert np.isfinite(fit.se).all()


def test_nested(spark, data):
    fit = fit_ols(spark.createDataFrame(data), "y", ["x1", "x2"], ["c1"], category="cat")["all"]
    assert nested_rsquared(fit, ["x1", "x2"]) == pytest.approx(dense(data, ["x1", "x2"])[2], rel=1e-8)


def test_classic_agrees_with_spark_ml(spark, data):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    part = data.head(60)
    df = zscore(spark.createDataFrame(part), ["x1", "x2"])
    ml = LinearRegression(labelCol="y", solver="normal").fit(
        VectorAssembler(inputCols=["x1_z", "x2_z"], outputCol="features").transform(df))
    fit = fit_ols(spark.createDataFrame(part), "y", ["x1", "x2"], cov="classic")["all"]
    assert fit.coef == pytest.approx([ml.intercept, *ml.coefficients], rel=1e-8)
    assert fit.se == pytest.approx([ml.summary.coefficientStandardErrors[-1],
                                    *ml.summary.coefficientStandardErrors[:-1]], rel=1e-8)
    assert fit.pvalues == pytest.approx([ml.summary.pValues[-1], *ml.summary.pValues[:-1]], rel=1e-6, abs=1e-12)


@pytest.mark.parametrize("f,d1,d2", [(3.7083, 3, 10), (0.5, 2, 7), (6.6079, 1, 5), (1.0, 7, 700_000), (40.0, 5, 33),
                                     (2.5, 7, 3_000_000), (1.2, 4, 3_000_000)])
def test_f_tail_by_integration(f, d1, d2):
    """The density of F, substituted to the unit interval, summed numerically."""
    log_beta = math.lgamma(d1 / 2) + math.lgamma(d2 / 2) - math.lgamma((d1 + d2) / 2)
    start = d1 * f / (d1 * f + d2)
    u = np.geomspace(start, 1, 400_001)
    mid = (u[1:] + u[:-1]) / 2
    dens = np.exp((d1 / 2 - 1) * np.log(mid) + (d2 / 2 - 1) * np.log1p(-mid) - log_beta)
    assert f_tail(f, d1, d2) == pytest.approx(float((dens * np.diff(u)).sum()), rel=2e-4, abs=1e-12)


def test_wald_test_of_classic_fit_is_the_usual_f(spark, data):
    part = data.head(80)
    fit = fit_ols(spark.createDataFrame(part), "y", ["x1", "x2"], cov="classic")["all"]
    usual = (fit.rsquared / 2) / ((1 - fit.rsquared) / (80 - 3))
    assert fit.fvalue == pytest.approx(usual, rel=1e-8)
    assert fit.f_pvalue == pytest.approx(f_tail(usual, 2, 77), rel=1e-8)


def test_coefficient_table(spark, data):
    fits = fit_ols(spark.createDataFrame(data), "y", ["x1", "x2"], ["c1"])
    got = coefficient_table(spark, fits, ["const", "x1"]).collect()
    assert [r["term"] for r in got] == ["const", "x1"] and got[0]["stars"] == "***" and got[0]["n"] == len(data)


def test_quartiles_keep_ties_together(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 1, 2, 2, 2, 3, 4, 5, 9]], "x double")
    counts = {r["quartile"]: r["count"] for r in with_quartile(df, "x").groupBy("quartile").count().collect()}
    assert counts == {"q1": 5, "q3": 2, "q4": 2}


def test_quartile_profile_agrees_with_pandas(spark):
    rnd = random.Random(2)
    pdf = pd.DataFrame({"x": [rnd.gauss(0, 1) for _ in range(401)], "y": [rnd.random() for _ in range(401)]})
    want = pdf.groupby(pd.qcut(pdf["x"], 4, labels=["q1", "q2", "q3", "q4"]), observed=True)["y"].agg(["mean", "median", "count"])
    for r in quartile_profile(spark.createDataFrame(pdf), "x", "y").collect():
        assert (r["mean"], r["median"], r["n"]) == pytest.approx(tuple(want.loc[r["quartile"]]))


def test_zscore_and_constant_column(spark):
    df = zscore(spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 2.0)], "a double, b double"), ["a", "b"])
    assert [tuple(r) for r in df.select("a_z", "b_z").orderBy("a").collect()] == [(-1, None), (0, None), (1, None)]


def test_one_hot(spark, rows):
    df = spark.createDataFrame([("b",), ("a",), ("c",), (None,)], "k string")
    assert rows(one_hot(df, "k"), "k", "k_b", "k_c") == [("a", 0, 0), ("b", 1, 0), ("c", 0, 1), (None, 0, 0)]
    assert one_hot(df, "k", levels=["c", "z", "a"], prefix="cat").columns == ["k", "cat_z", "cat_a"]


def test_model_input(spark, rows):
    data = [(0.0, "111 - x", 1.0), (0.1, "111 - x", 1.0), (59.9, "799", 1.0), (60.0, "111", 1.0),
            (5.0, "811", 1.0), (5.0, "none", 1.0), (5.0, "321", None), (None, "321", 1.0)]
    df = spark.createDataFrame(data, "response_time_min double, primary_situation string, v double")
    assert rows(model_input(df, required=["v"]), "response_time_min", "incident_category") == [
        (0.1, "Feuer"), (59.9, "Fehlalarm")]
    assert tuple(model_input_counts(df).first()) == (8, 5, 3)


def test_sample_summary(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (6.0,), (None,)], "v double")
    r = sample_summary(df, "v").first()
    assert (r["n"], r["median"], r["mean"], r["min"], r["max"]) == (3, 2, 3, 1, 6)
    assert r["std"] == pytest.approx(np.std([1, 2, 6], ddof=1))


def test_wald_test_of_collinear_columns(spark, data):
    """A copy of a column in other units adds no restriction and leaves F as it is."""
    df = spark.createDataFrame(data).withColumn("x3", 3 * F.col("x1") - 7)
    one = fit_ols(df, "y", ["x1", "x2"])["all"]
    two = fit_ols(df, "y", ["x1", "x2", "x3"])["all"]
    assert two.fvalue == pytest.approx(one.fvalue, rel=1e-6) and two.f_pvalue == pytest.approx(one.f_pvalue, rel=1e-6)
    assert two.rank == one.rank == 3 and two.rsquared == pytest.approx(one.rsquared)


def test_one_cluster_has_no_errors(spark, data):
    df = spark.createDataFrame(data.assign(cl=1))
    fit = fit_ols(df, "y", ["x1"], cov="cluster", cluster="cl")["all"]
    assert np.isfinite(fit.coef).all() and np.isnan(fit.se).all() and math.isnan(fit.fvalue)


def test_f_tail_is_one_function_at_every_size():
    """Steady in d2, and close to the chi-square limit for very large d2."""
    for f, d1 in ((0.5, 1), (2.0, 3), (4.0, 10), (1.0, 40)):
        tails = [f_tail(f, d1, d2) for d2 in (9e5, 1.1e6, 1e7, 1e9)]
        assert tails == pytest.approx([tails[0]] * 4, rel=1e-3)
    assert f_tail(3.841458820694124, 1, 1e10) == pytest.approx(0.05, rel=1e-6)
    assert f_tail(5.991464547107979 / 2, 2, 1e10) == pytest.approx(0.05, rel=1e-6)


@pytest.mark.parametrize("module, fit", [
    (regression, lambda df: fit_ols(df, "y", ["x1", "x2"], ["c1"], category="cat", strata="s")),
    (absorbed, lambda df: absorbed.fit_absorbed(df, "y", ["x1", "x2"], ["c1"], absorb="cat", strata="s"))])
def test_rows_of_a_stratum_stay_in_their_tasks(spark, data, monkeypatch, module, fit):
    """Parameters come to the rows; no pass deals the rows of the table by stratum or level to make its sums."""
    seen, sums = [], module.product_sums
    monkeypatch.setattr(module, "product_sums", lambda df, *rest: seen.append(df) or sums(df, *rest))
    assert len(getattr(fit(spark.createDataFrame(data)), "fits", "12")) == 2
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in seen]
    assert len(plans) == 2
    assert not any("hashpartitioning" in p or "SortMergeJoin" in p for p in plans)
