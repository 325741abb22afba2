"""Counts: top values, calendars, histograms, capped values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberfield import constants as K
from emberfield.functions.numeric import to_number, truncate
from emberfield.functions.time import month_name, weekday_name
from emberfield.operators.quantiles import exact_quantiles
from emberfield.session import materialize


def value_counts(df: DataFrame, column: str, keep_null: bool = False, name: str = "n") -> DataFrame:
    src = df if keep_null else df.where(F.col(column).isNotNull())
    return src.groupBy(column).agg(F.count(F.lit(1)).alias(name))


def top_values(df: DataFrame, column: str, k: int | None, name: str = "n") -> DataFrame:
    """The ``k`` most frequent values of one column (all if None); ties go by value."""
    ranked = value_counts(df, column, name=name).orderBy(F.desc(name), F.asc(column))
    return ranked if k is None else ranked.limit(k)


def top_rows(df: DataFrame, by: str, k: int, columns: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """The ``k`` rows with the largest ``by``; equal rows go by the tie columns."""
    return df.orderBy(F.desc_nulls_last(by), *[F.asc(c) for c in tie]).limit(k).select(*columns)


def long_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count per column and value over several columns in one pass (null is kept as a value)."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], list(columns), "column", "value")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def top_values_by_column(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """Top-k per column with its share of all rows and the number of distinct values.

    The share counts null rows in the denominator, and null counts as one distinct value. Ranking
    with a limit per column is done before the shuffle, so a column with very many values sends
    only ``k`` of them per task.
    """
    return top_of_counts(materialize(long_counts(df, columns), "value-counts"), k)


def top_of_counts(counts: DataFrame, k: int) -> DataFrame:
    """:func:`top_values_by_column` from ready counts per column and value (null is a value)."""
    totals = counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_unique"), F.sum("n").alias("rows"))
    order = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    best = (counts.where(F.col("value").isNotNull())
            .withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= k))
    return best.join(totals, "column", "inner").select(
        "column", "rank", "value", "n", (F.col("n") / F.col("rows") * 100).alias("pct"), "n_unique")


def distinct_count(column: str, null_is_value: bool) -> Column:
    n = F.count_distinct(column)
    if not null_is_value:
        return n
    return n + F.max(F.col(column).isNull().cast("int"))


def fixed_order_counts(df: DataFrame, label: str, labels: Sequence[str]) -> DataFrame:
    """Counts for a fixed list of labels in its order, zero where a label does not occur."""
    counts = value_counts(df.where(F.col(label).isin(list(labels))), label).withColumnRenamed(label, "label")
    return in_fixed_order(counts, labels)


def in_fixed_order(counts: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Ready counts (label, n) for a fixed list of labels in its order."""
    calendar = counts.sparkSession.range(1, len(labels) + 1).select(
        F.col("id").cast("int").alias("position"),
        F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("id").cast("int")).alias("label"))
    # At most one row per label of the fixed list.
    return calendar.join(F.broadcast(counts), "label", "left").select(
        "position", "label", F.coalesce("n", F.lit(0)).alias("n"))


def month_counts(df: DataFrame, ts: str) -> DataFrame:
    return fixed_order_counts(df.select(month_name(F.col(ts)).alias("label")), "label", K.MONTH_NAMES)


def weekday_counts(df: DataFrame, ts: str) -> DataFrame:
    return fixed_order_counts(
        df.select(weekday_name(F.col(ts)).alias("label")), "label", K.WEEKDAY_NAMES)


def histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """Equal-width counts between the smallest and the largest value; the last bin is closed.

    A column with one single value spreads the bins over +-0.5 around it.
    """
    src = df.select(to_number(value).alias("v")).where(F.col("v").isNotNull())
    ends = src.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi")).alias("e")).scalar()
    flat = ends["lo"] == ends["hi"]
    lo = F.when(flat, ends["lo"] - 0.5).otherwise(ends["lo"])
    hi = F.when(flat, ends["hi"] + 0.5).otherwise(ends["hi"])
    counts = (src.withColumns({"lo": lo, "hi": hi})
              .select(bin_number(F.col("v"), F.col("lo"), F.col("hi"), bins).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n")))
    return all_bins(counts, lo, hi, bins)


def bin_number(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    return F.least(F.floor((v - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("long")


def all_bins(counts: DataFrame, lo: Column, hi: Column, bins: int) -> DataFrame:
    """Ready counts (bin, n) with the limits of every bin, zero where a bin is empty."""
    width = (hi - lo) / bins
    # At most one row per bin.
    return (counts.sparkSession.range(bins).withColumnRenamed("id", "bin")
            .join(F.broadcast(counts), "bin", "left")
            .select("bin", (lo + F.col("bin") * width).alias("low"),
                    (lo + (F.col("bin") + 1) * width).alias("high"),
                    F.coalesce("n", F.lit(0)).alias("n")))


def capped_value_counts(df: DataFrame, column: str, q: float = 0.99, few_values: bool = False) -> DataFrame:
    """Counts of whole values up to the ``q`` quantile of the column itself."""
    src = df.select(to_number(F.col(column)).alias("v")).where(F.col("v").isNotNull())
    cap = exact_quantiles(src, "v", {"cap": q}, rule="nearest", few_values=few_values).first()["cap"]
    return (src.where(F.col("v") <= F.lit(cap))
            .select(truncate(F.col("v")).alias(column))
            .groupBy(column).agg(F.count(F.lit(1)).alias("n")))
