"""Numbering the levels of a column of any cardinality, and dummies as sparse vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberfield.session import materialize

# The low bits of a monotonically increasing id count the rows of one task.
_ROW_BITS = (1 << 33) - 1


def level_numbers(df: DataFrame, column: str) -> DataFrame:
    """``level`` and ``number`` (0, 1, ...) of the distinct non-null values in ascending order.

    Levels are written in sorted ranges, each with its place in its range. Only the ranges are
    summed up, one row per task, so no task sees all levels and the driver sees none.
    """
    found = df.where(F.col(column).isNotNull()).select(F.col(column).alias("level")).distinct()
    ranged = materialize(
        found.repartitionByRange("level").sortWithinPartitions("level").select(
            "level", F.spark_partition_id().alias("_range"),
            F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)).alias("_place")), "levels")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    # One row per range: the pairs of ranges that precede one another are few.
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b._range") < F.col("a._range"), "left").groupBy(
        F.col("a._range").alias("_range")).agg(F.coalesce(F.sum("b._size"), F.lit(0)).alias("_before"))
    return ranged.join(before, "_range").select("level", (F.col("_before") + F.col("_place")).alias("number"))


def one_hot_sparse(df: DataFrame, column: str, out: str | None = None, drop_first: bool = True) -> DataFrame:
    """Add the dummies of a column as one sparse vector: struct of size, indices and values.

    Levels are sorted; with ``drop_first`` the first one is the reference and has no index. A null
    has no index either. The number of levels is bounded by nothing: rows meet their level's number
    in an equi-join, which is broadcast only below the session's threshold.
    """
    numbers = level_numbers(df, column)
    first = 1 if drop_first else 0
    size = numbers.agg(F.greatest(F.count(F.lit(1)) - first, F.lit(0))).scalar()
    at = F.col("_number") - first
    none, has = F.array().cast("array<long>"), F.coalesce(at >= 0, F.lit(False))
    joined = df.join(numbers.select(F.col("level").alias("_level"), F.col("number").alias("_number")),
                     F.col(column) == F.col("_level"), "left")
    return joined.withColumn(out or f"{column}_vector", F.struct(
        size.alias("size"), F.when(has, F.array(at)).otherwise(none).alias("indices"),
        F.when(has, F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>")).alias("values"),
    )).drop("_level", "_number")
