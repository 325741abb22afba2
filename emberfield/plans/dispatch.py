"""Analyses of a unit-dispatch table (one row per unit and call)."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberfield.functions.time import elapsed_minutes, shift_date
from emberfield.operators.frequency import top_values_by_column, value_counts
from emberfield.operators.quantiles import exact_quantiles


def top_ten(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return top_values_by_column(df, columns, 10)


def response_summary(df: DataFrame, dispatched: str, on_scene: str, by: Sequence[str] = ()) -> DataFrame:
    """Calls, mean, median and 95th percentile of the minutes from dispatch to arrival."""
    timed = df.withColumn("minutes", elapsed_minutes(F.col(dispatched), F.col(on_scene)))
    return exact_quantiles(
        timed, "minutes", {"median": 0.5, "p95": 0.95}, by=by,
        extra=[F.count(F.lit(1)).alias("calls"), F.avg("minutes").alias("mean")])


def unit_activity(df: DataFrame, unit: str, dispatched: str, on_scene: str) -> DataFrame:
    """Calls and mean response per unit."""
    minutes = elapsed_minutes(F.col(dispatched), F.col(on_scene))
    return df.groupBy(unit).agg(F.count(F.lit(1)).alias("calls"), F.avg(minutes).alias("mean_minutes"))


def calls_per(df: DataFrame, ts: str, unit: str) -> DataFrame:
    """Calls per calendar period (hour, day, month, year)."""
    return df.groupBy(F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz").alias("period")).agg(
        F.count(F.lit(1)).alias("n"))


def calls_per_hour_of_day(df: DataFrame, ts: str) -> DataFrame:
    return value_counts(df.select(F.hour(ts).alias("hour")), "hour")


def calls_per_shift(df: DataFrame, ts: str, start_hour: int = 8) -> DataFrame:
    return value_counts(df.select(shift_date(F.col(ts), start_hour).alias("shift")), "shift")


def heat_grid(df: DataFrame, x: str, y: str, step_x: float, step_y: float) -> DataFrame:
    """Counts per grid cell of two coordinates."""
    return df.groupBy(F.floor(F.col(x) / step_x).alias("cell_x"),
                      F.floor(F.col(y) / step_y).alias("cell_y")).agg(F.count(F.lit(1)).alias("n"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, one pass."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r"))
        for i, (a, b) in enumerate(pairs)])))


def annualised(df: DataFrame, by: Sequence[str], measures: Sequence[str], year: str) -> DataFrame:
    """Sums divided by the number of years observed in the whole table."""
    years = df.agg(F.count_distinct(year).alias("n")).scalar()
    return df.groupBy(*by).agg(*[
        (F.sum(c) / years).alias(f"{c}_per_year") for c in measures])
