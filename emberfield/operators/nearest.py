"""Nearest-snapshot attachment and plain dimension attachment."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberfield.functions.numeric import nearest_year


def stack_snapshots(snapshots: dict[int, DataFrame], column: str = "snapshot_year") -> DataFrame:
    """One table from one table per year; columns a year does not have become null."""
    parts = [df.withColumn(column, F.lit(year)) for year, df in sorted(snapshots.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def with_nearest_snapshot(
    facts: DataFrame, years: Sequence[int], year: str = "year", column: str = "snapshot_year",
) -> DataFrame:
    return facts.withColumn(column, nearest_year(F.col(year), years))


def attach_snapshot(
    facts: DataFrame,
    snapshots: DataFrame,
    years: Sequence[int],
    on: Sequence[str],
    year: str = "year",
    column: str = "snapshot_year",
) -> DataFrame:
    """Left join of each fact with the row of its group in the snapshot nearest to its year.

    Turning "nearest" into a computed key makes this one equi-join for all snapshots. Hand in
    ``snapshots`` as a file scan or a materialised roll-up: it is then broadcast if its size
    allows, and the facts are not shuffled.
    """
    return with_nearest_snapshot(facts, years, year, column).join(snapshots, [*on, column], "left")


def snapshot_mapping(facts: DataFrame, year: str = "year", column: str = "snapshot_year") -> DataFrame:
    """Which years each snapshot stands for, and how many rows."""
    return facts.groupBy(column).agg(
        F.min(year).alias("min_year"), F.max(year).alias("max_year"),
        F.count(F.lit(1)).alias("rows"))


def outer_merge(parts: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Full outer merge of several tables on a shared key with one key column in the result."""
    return reduce(lambda a, b: a.join(b, list(on), "full"), parts)
