"""Literal fixtures for the column expressions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from emberfield.functions import numeric as N
from emberfield.functions import text as X
from emberfield.functions import time as M


def values(spark, schema, data, expr):
    df = spark.createDataFrame([(i, *(d if isinstance(d, tuple) else (d,))) for i, d in enumerate(data)],
                               f"i int, {schema}")
    return [r[1] for r in df.select("i", expr.alias("out")).orderBy("i").collect()]


def test_title_case(spark):
    got = values(spark, "s string", ["castro/upper market", " o'neill ", "\tWEST of TWIN-peaks\n", "3rd st",
                                     "haight ashbury", "", None, "ÉTOILE verte"], X.title_case(F.col("s")))
    assert got == ["Castro/Upper Market", "O'Neill", "West Of Twin-Peaks", "3Rd St", "Haight Ashbury", "", None,
                   "Étoile Verte"]


def test_title_case_agrees_with_python(spark):
    words = ["soma", "mission bay", "a.b.c", "x--y", "don't", "lone mtn/usf", "7th&8th", "  spaced   out "]
    assert values(spark, "s string", words, X.title_case(F.col("s"))) == [w.strip().title() for w in words]


def test_zero_pad(spark):
    got = values(spark, "s string", ["6075", "123456789012", None], X.zero_pad(F.col("s"), 11))
    assert got == ["00000006075", "123456789012", None]


def test_clean_text_and_tokens(spark):
    assert values(spark, "s string", [" a ", None, "\t"], X.clean_text(F.col("s"))) == ["a", "", ""]
    got = values(spark, "s string", ["NA", "N/A", "", "null", "x", None],
                 X.null_tokens(F.col("s"), ["", "NA", "N/A", "null"]))
    assert got == [None, None, None, None, "x", None]


def test_leading_code(spark):
    got = values(spark, "s string", ["111 - Building fire", "1234", "11 x", "x111", None], X.leading_code(F.col("s")))
    assert got == [111.0, 123.0, None, None, None]


def test_composite_key(spark):
    got = values(spark, "a string, b string", [("06", "075"), ("06", None)], X.composite_key(F.col("a"), F.col("b")))
    assert got == ["06075", None]


def test_nearest_year(spark):
    years = [2009, 2014, 2019, 2021, 2023]
    got = values(spark, "y int", [2003, 2011, 2012, 2016, 2017, 2020, 2022, 2026, None],
                 N.nearest_year(F.col("y"), years))
    assert got == [2009, 2009, 2014, 2014, 2019, 2019, 2021, 2023, None]


@pytest.mark.parametrize("years", [[2009, 2014, 2019, 2021, 2023], [2000], [2001, 1998, 1996]])
def test_nearest_year_brute_force(spark, years):
    probe = list(range(1990, 2030))
    want = [min(sorted(years), key=lambda y: abs(y - p)) for p in probe]
    assert values(spark, "y int", probe, N.nearest_year(F.col("y"), years)) == want


def test_night_and_weekend(spark):
    assert values(spark, "h int", [5, 6, 21, 22], M.is_night(F.col("h"))) == [1, 0, 0, 1]
    assert values(spark, "w int", [0, 4, 5, 6], M.is_weekend(F.col("w"))) == [0, 0, 1, 1]


def test_elapsed(spark):
    a = dt.datetime(2020, 1, 1)
    pairs = [(a, a + dt.timedelta(seconds=90, milliseconds=900)), (a + dt.timedelta(seconds=1, milliseconds=500), a),
             (a, None)]
    exact = values(spark, "a timestamp_ntz, b timestamp_ntz", pairs, M.elapsed_minutes(F.col("a"), F.col("b")))
    whole = values(spark, "a timestamp_ntz, b timestamp_ntz", pairs, M.elapsed_whole_minutes(F.col("a"), F.col("b")))
    assert exact == [90.9 / 60, -0.025, None]
    assert whole == [1.5, -1 / 60, None]


def test_elapsed_ignores_clock_changes(spark):
    """02:30 on this day does not exist in the session zone; plain timestamps do not care."""
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        pairs = [(dt.datetime(2020, 3, 8, 1, 30), dt.datetime(2020, 3, 8, 3, 30)),
                 (dt.datetime(2020, 3, 8, 2, 30), dt.datetime(2020, 3, 8, 3, 0))]
        schema = "a timestamp_ntz, b timestamp_ntz"
        assert values(spark, schema, pairs, M.elapsed_minutes(F.col("a"), F.col("b"))) == [120, 30]
        assert values(spark, schema, pairs, M.elapsed_whole_minutes(F.col("a"), F.col("b"))) == [120, 30]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_names_of_months_and_days(spark):
    days = [dt.datetime(2024, m, 15) for m in range(1, 13)] + [dt.datetime(2024, 1, d) for d in range(1, 8)] + [None]
    assert values(spark, "t timestamp_ntz", days, M.month_name(F.col("t"))) == [d and d.strftime("%b") for d in days]
    assert values(spark, "t timestamp_ntz", days, M.weekday_name(F.col("t"))) == [d and d.strftime("%a") for d in days]


def test_time_parse(spark):
    texts = ["2020-03-08T02:30:00.125", "2020-03-08T02:30:00", "bad", None]
    strict = values(spark, "s string", texts, M.parse_iso_millis(F.col("s")))
    lenient = values(spark, "s string", texts, M.parse_time(F.col("s")))
    stamp = dt.datetime(2020, 3, 8, 2, 30, 0, 125000)
    assert strict == [stamp, None, None, None]
    assert lenient == [stamp, stamp.replace(microsecond=0), None, None]


def test_time_parse_does_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        # This wall-clock time does not exist in that zone.
        got = values(spark, "s string", ["2020-03-08T02:30:00.000"], M.parse_iso_millis(F.col("s")))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [dt.datetime(2020, 3, 8, 2, 30)]


def test_shift_date(spark):
    got = values(spark, "t timestamp_ntz", [dt.datetime(2020, 1, 2, 7, 59), dt.datetime(2020, 1, 2, 8)],
                 M.shift_date(F.col("t")))
    assert got == [dt.date(2020, 1, 1), dt.date(2020, 1, 2)]


def test_safe_ratio(spark):
    data = [(1.0, 0.0), (1.0, -2.0), (None, 5.0), (0.00285, 1.0), (1.0, 3.0), (float("nan"), 1.0)]
    got = values(spark, "a double, b double", data, N.safe_ratio(F.col("a"), F.col("b")))
    # 0.00285 * 100 is the double just above 0.285, so it rounds up; pandas gives the same.
    assert got == [None, None, None, 0.29, 33.33, None]
    # 0.285 itself times 100 is 28.499..., and halves go to even.
    assert values(spark, "a double", [0.285, 0.125, 0.375], N.round_even(F.col("a"), 2)) == [0.28, 0.12, 0.38]


def test_numbers(spark):
    texts = ["1.5", "x", "", None, "NaN"]
    assert values(spark, "s string", texts, N.to_number(F.col("s"))) == [1.5, None, None, None, None]
    assert values(spark, "s string", texts, N.to_number_or_zero(F.col("s"))) == [1.5, 0, 0, 0, 0]
    assert values(spark, "x double", [-666666666.0, -999.0, 50000.0],
                  N.sentinel_to_null(F.col("x"), -999)) == [None, -999, 50000]
    assert values(spark, "x double", [1799.0, 1800.0, 2025.0, 2026.0, None],
                  N.within_range(F.col("x"), 1800, 2025)) == [None, 1800, 2025, None, None]
    assert values(spark, "x double", [0.5, 1.5, 2.5, None], N.to_whole(F.col("x"))) == [0, 2, 2, None]
    assert values(spark, "x double", [1.9, -1.9, 1e30], N.truncate(F.col("x"))) == [1, -1, None]


def test_flags(spark):
    assert values(spark, "s string", ["Assault", "Other", None], N.member_flag(F.col("s"), ["Assault"])) == [1, 0, 0]
    assert values(spark, "x double", [1939.0, 1940.0, None], N.below_flag(F.col("x"), 1940)) == [1, 0, 0]


def test_code_bins(spark):
    codes = [99.0, 100.0, 199.0, 200.0, 799.0, 800.0, 911.0, None]
    assert values(spark, "c double", codes, N.code_bin(F.col("c"))) == [
        None, "Feuer", "Feuer", "Ueberhitzung", "Fehlalarm", None, None, None]
    assert values(spark, "c double", codes, N.code_bin_rank(F.col("c"))) == [None, 1, 1, 2, 7, None, None, None]


def test_stars_and_grades(spark):
    assert values(spark, "p double", [0.0009, 0.001, 0.01, 0.05, 0.1], N.significance_stars(F.col("p"))) == [
        "***", "**", "*", ".", " "]
    assert values(spark, "p double", [50.1, 50.0, 10.1, 10.0], N.completeness_grade(F.col("p"))) == [
        "sparse", "partial", "partial", "complete"]


def test_flame_spread_recode(spark):
    got = values(spark, "s string", ["NA", "NO", "Y", "YES", "3", None], N.flame_spread_recode(F.col("s")))
    assert got == [None, 0, 1, 1, None, None]
