"""Exact quantiles against sorting in plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from emberfield.operators import quantiles
from emberfield.operators.quantiles import exact_quantiles, quantiles_of_counts, wide_quantiles

PROBS = {"q0": 0.0, "q10": 0.1, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9, "q95": 0.95, "q100": 1.0}


def brute(values, q, rule):
    v = sorted(values)
    if not v:
        return None
    h = q * (len(v) - 1)
    if rule == "nearest":
        return v[math.floor(h + 0.5)]
    low, high = math.floor(h), math.ceil(h)
    return v[low] + (v[high] - v[low]) * (h - low)


def check(got, data, rule, by=True):
    for r in got.collect():
        values = [x for g, x in data if x is not None and not math.isnan(x) and (not by or g == r["g"])]
        assert r["n"] == len(values)
        for name, q in PROBS.items():
            want = brute(values, q, rule)
            assert (r[name] is None) == (want is None), (name, r)
            if want is not None:
                assert r[name] == pytest.approx(want, abs=1e-9), (name, r)


@pytest.mark.parametrize("rule", ["linear", "nearest"])
@pytest.mark.parametrize("few_values", [False, True])
def test_small_groups_with_nulls(spark, rule, few_values):
    rnd = random.Random(7)
    data = [(g if g else None, float(rnd.randint(-3, 6)) if g % 4 else None) for g in range(24) for _ in range(g + 1)]
    data += [(1, float("nan")), (2, None)]
    df = spark.createDataFrame(data, "g int, x double")
    got = exact_quantiles(df, "x", PROBS, by=["g"], rule=rule, few_values=few_values)
    assert got.count() == 24
    check(got, data, rule)


@pytest.mark.parametrize("rule", ["linear", "nearest"])
def test_hot_group_and_ties(spark, rule):
    """One group with most rows, half of them one value, and a coarse sketch so that gaps are long."""
    rnd = random.Random(3)
    data = [(0, 5.0 if rnd.random() < 0.5 else rnd.lognormvariate(0, 3)) for _ in range(20_000)]
    data += [(g, rnd.gauss(0, 1)) for g in range(1, 40) for _ in range(50)]
    df = spark.createDataFrame(data, "g int, x double").repartition(8)
    check(exact_quantiles(df, "x", PROBS, by=["g"], rule=rule, accuracy=200), data, rule)


def test_whole_table_and_extras(spark):
    rnd = random.Random(5)
    data = [(0, rnd.expovariate(1)) for _ in range(5000)] + [(0, None)]
    df = spark.createDataFrame(data, "g int, x double").repartition(4)
    got = exact_quantiles(df, F.col("x"), PROBS, extra=[F.count(F.lit(1)).alias("rows")], accuracy=500)
    check(got, data, "linear", by=False)
    assert got.first()["rows"] == 5001


def test_empty_table(spark):
    empty = spark.createDataFrame([], "g int, x double")
    assert exact_quantiles(empty, "x", {"m": 0.5}).collect()[0]["m"] is None
    assert exact_quantiles(empty, "x", {"m": 0.5}, by=["g"]).collect() == []


def gapped(rnd, n):
    """Half of the values near zero, half near a million, and a thin long tail."""
    low = [rnd.random() for _ in range(n // 2)]
    return low + [1e6 + rnd.random() for _ in range(n - len(low) - 3)] + [1e9, 1e12, 1e15]


@pytest.mark.parametrize("rule", ["linear", "nearest"])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_gap_at_the_median_and_far_tail(spark, rule, by):
    rnd = random.Random(4)
    data = [(g, x) for g in (0, 1) for x in gapped(rnd, 3000 + g)]
    probs = {"q50": 0.5, "q9999": 0.9999, "q999": 0.999}
    got = exact_quantiles(spark.createDataFrame(data, "g int, x double").repartition(4), "x", probs, by=by, rule=rule, accuracy=300)
    for r in got.collect():
        values = [x for g, x in data if not by or g == r["g"]]
        assert {k: r[k] for k in probs} == {k: pytest.approx(brute(values, q, rule), rel=1e-12) for k, q in probs.items()}


@pytest.mark.parametrize("by", [[], ["g"]])
def test_missed_brackets_are_narrowed(spark, by, monkeypatch):
    """First brackets that hold none of the wanted ranks, and slices of a few values, give the same result."""
    rnd = random.Random(6)
    data = [(g, x) for g in (0, 1, 2) for x in gapped(rnd, 500 * (g + 1))]
    monkeypatch.setattr(quantiles, "SLICES", 4)
    df = spark.createDataFrame(data, "g int, x double").repartition(3).withColumn("_v", F.col("x"))
    wrong = df.groupBy(*by).agg(F.array(*[F.lit(-5.0), F.lit(-4.0), F.lit(1e16), F.lit(1e17)]).alias("_cut"))
    wanted = {"a": (0.5, "linear"), "b": (0.93, "nearest")}
    got = quantiles._narrow(df, wrong, by, wanted).collect()
    assert len(got) == (3 if by else 1)
    for r in got:
        values = [x for g, x in data if not by or g == r["g"]]
        assert (r["a"], r["b"]) == pytest.approx((brute(values, 0.5, "linear"), brute(values, 0.93, "nearest")), rel=1e-12)


def test_slices_are_even(spark):
    """However values are spread, no slice of a bracket is much larger than the others."""
    rnd = random.Random(2)
    values = sorted({math.exp(rnd.uniform(-200, 200)) for _ in range(20_000)})
    cells = spark.createDataFrame([(0, v, 1) for v in values], "_cell int, _kept double, _c long")
    sizes = [r["count"] for r in quantiles._sliced(cells, ["_cell"]).groupBy("_piece").count().collect()]
    assert max(sizes) <= 4 * len(values) / quantiles.SLICES and sum(sizes) == len(values)


@pytest.mark.parametrize("rule", ["linear", "nearest"])
@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_wide_quantiles(spark, rule, accuracy):
    rnd = random.Random(accuracy)
    columns = {"a": gapped(rnd, 4000), "b": [float(rnd.randint(0, 3)) for _ in range(4000)],
               "c": [rnd.gauss(0, 1) if rnd.random() < 0.5 else None for _ in range(4000)], "none": [None] * 4000}
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns)).repartition(4)
    got = {r["column"]: r for r in wide_quantiles(df, list(columns), PROBS, rule, lambda v: [F.max(v).alias("max")], accuracy).collect()}
    for c, values in columns.items():
        present = [v for v in values if v is not None]
        assert got[c]["n"] == len(present) and got[c]["max"] == (max(present) if present else None)
        for name, q in PROBS.items():
            want = brute(present, q, rule)
            assert got[c][name] == (want if want is None else pytest.approx(want, rel=1e-9, abs=1e-9)), (c, name)


def test_wide_brackets_that_miss(spark, monkeypatch):
    """A column whose brackets miss is narrowed alone."""
    rnd = random.Random(9)
    columns = {"a": gapped(rnd, 2000), "b": [rnd.gauss(0, 1) for _ in range(2000)]}
    df = spark.createDataFrame(list(zip(*columns.values())), "a double, b double").repartition(3)
    whole = quantiles._wide_ranks
    monkeypatch.setattr(quantiles, "_wide_ranks", lambda *a: whole(*a).withColumn("missed", F.col("column") == "a"))
    got = {r["column"]: r["m"] for r in wide_quantiles(df, ["a", "b"], {"m": 0.37}).collect()}
    assert got == {c: pytest.approx(brute(v, 0.37, "linear")) for c, v in columns.items()}


def test_several_columns_are_not_turned_into_rows(spark, tmp_path):
    """No plan of ``wide_quantiles`` expands all rows by the number of columns."""
    from emberfield.operators.profile import describe

    path = str(tmp_path / "wide")
    spark.range(5000).selectExpr("id * 1.5 AS a", "id % 7 AS b", "rand(1) AS c").write.parquet(path)
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    describe(spark.read.parquet(path), ["a", "b", "c"]).collect()
    plans = [store.executionsList().apply(i).physicalPlanDescription() for i in range(before, store.executionsCount())]
    assert plans and not any("Expand" in p for p in plans)


def test_quantiles_of_counts(spark):
    rnd = random.Random(8)
    data = [(g, float(rnd.randint(0, 40))) for g in (0, None, 2) for _ in range(301)]
    counts = spark.createDataFrame(data, "g int, x double").groupBy("g", "x").agg(F.count("*").alias("n"))
    check(quantiles_of_counts(counts, "x", "n", PROBS, ["g"]), data, "linear")
