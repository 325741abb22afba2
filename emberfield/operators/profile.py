"""Data-quality and distribution profiles. All columns are handled in one pass, not one job each."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberfield.functions.numeric import completeness_grade, to_number
from emberfield.functions.time import elapsed_whole_minutes
from emberfield.operators.quantiles import exact_quantiles, quantiles_of_counts, wide_quantiles


NULLS_SCHEMA = "column string, nulls long, rows long, null_pct double"


def _one_row_to_long(row: DataFrame, columns: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One-row table of structs, one per column, to one row per column."""
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), *[F.col(f"s_{i}")[m].alias(m) for m in metrics])
        for i, c in enumerate(columns)])))


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null count and percent of every column."""
    columns = list(columns or df.columns)
    rows = F.count(F.lit(1))
    row = df.agg(*[
        F.struct(F.count_if(F.col(c).isNull()).alias("nulls"), rows.alias("rows")).alias(f"s_{i}")
        for i, c in enumerate(columns)])
    return _one_row_to_long(row, columns, ["nulls", "rows"]).withColumn(
        "null_pct", F.col("nulls") / F.when(F.col("rows") > 0, F.col("rows")) * 100)


def missing_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Only the columns with nulls, most nulls first."""
    return null_profile(df, columns).where(F.col("nulls") > 0).orderBy(F.desc("nulls"), "column")


def completeness(df: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """Missing percent per column with a grade, most complete first."""
    columns = [c for c in df.columns if c not in skip]
    return (null_profile(df, columns)
            .withColumn("grade", completeness_grade(F.col("null_pct")))
            .orderBy("null_pct", "column"))


def describe(df: DataFrame, columns: Sequence[str], accuracy: int = 10_000) -> DataFrame:
    """count, null_count, mean, std, min, quartiles (nearest rank) and max per column."""
    return wide_quantiles(
        df, columns, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, rule="nearest", accuracy=accuracy,
        extra=lambda v: [F.count_if(v.isNull()).alias("null_count"), F.avg(v).alias("mean"),
                         F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")],
    ).withColumnRenamed("n", "count")


def column_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, median, min, max and missing percent per column."""
    return wide_quantiles(
        df, columns, {"median": 0.5},
        extra=lambda v: [F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"),
                         (F.avg(v.isNull().cast("int")) * 100).alias("null_pct")])


def temporal_coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """First and last instant per time column; columns without any valid instant drop out."""
    row = df.agg(*[
        F.struct(F.min(c).alias("first"), F.max(c).alias("last")).alias(f"s_{i}")
        for i, c in enumerate(columns)])
    return _one_row_to_long(row, columns, ["first", "last"]).where(F.col("first").isNotNull())


def response_profile(
    df: DataFrame, pairs: Sequence[tuple[str, str, str]], limit: float = 480.0,
) -> DataFrame:
    """n, mean, median, p90, p95 and max of elapsed minutes per (label, start, end) pair.

    Whole seconds, 0..``limit`` minutes.
    """
    minutes = df.select(*[
        elapsed_whole_minutes(F.col(start), F.col(end)).alias(label) for label, start, end in pairs
    ]).unpivot([], [label for label, _, _ in pairs], "label", "minutes")
    return duration_profile(minutes.where(F.col("minutes").between(0, limit)), "minutes", ["label"],
                            few_values=limit <= 1440)


def duration_profile(
    df: DataFrame, minutes: str, by: Sequence[str], few_values: bool = False,
) -> DataFrame:
    """The profile of :func:`response_profile` for ready minutes, per group.

    The median interpolates; p90 and p95 take the nearest rank. Whole seconds within a day have so
    few distinct values (60 per minute) that they can be counted directly: ``few_values``.
    """
    return exact_quantiles(
        df, minutes, {"median": 0.5, "p90": (0.90, "nearest"), "p95": (0.95, "nearest")}, by=by,
        extra=[F.avg(minutes).alias("mean"), F.max(minutes).alias("max")], few_values=few_values,
    ).select(*by, "n", "mean", "median", "p90", "p95", "max")


def profile_of_counts(counts: DataFrame, minutes: str, n: str, by: Sequence[str]) -> DataFrame:
    """:func:`duration_profile` from a table that has each value of a group once."""
    v = F.col(minutes)
    found = quantiles_of_counts(counts, minutes, n, {"median": 0.5, "p90": (0.90, "nearest"), "p95": (0.95, "nearest")}, by)
    sums = counts.groupBy(*by).agg((F.sum(v * F.col(n)) / F.sum(n)).alias("mean"), F.max(v).alias("max"))
    return found.join(sums, list(by)).select(*by, "n", "mean", "median", "p90", "p95", "max")


def casualty_totals(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Total and number of rows above zero per column."""
    row = df.agg(*[
        F.struct(F.coalesce(F.sum(to_number(F.col(c))), F.lit(0.0)).try_cast("long").alias("total"),
                 F.count_if(to_number(F.col(c)) > 0).alias("rows_above_zero")).alias(f"s_{i}")
        for i, c in enumerate(columns)])
    return _one_row_to_long(row, columns, ["total", "rows_above_zero"])


def schema_table(df: DataFrame) -> DataFrame:
    """Column names and types as a table."""
    fields = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields, 1)]
    return df.sparkSession.createDataFrame(fields, "position int, column string, type string")


def table_inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and number of columns per table."""
    parts = [df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"),
                    F.lit(len(df.columns)).alias("columns")) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)
