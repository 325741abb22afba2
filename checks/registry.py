"""Registration and small helpers shared by the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """``t.orders`` reads ``orders.parquet`` of the given folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def check(name: str, sql: str | None = None):
    """Register a query that takes :class:`Tables`, with its SQL if there is one."""
    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql:
            ORACLE[name] = sql
        return build
    return register


def rounded(c: Column | str, digits: int = 4) -> Column:
    """Half-even rounding for comparison; sums differ in the last bits between engines."""
    c = F.col(c) if isinstance(c, str) else c
    return F.rint(c * float(10 ** digits)) / float(10 ** digits) + 0.0


def round_columns(df: DataFrame, columns, digits: int = 4) -> DataFrame:
    return df.withColumns({c: rounded(c, digits) for c in columns})


def r_sql(expr: str, digits: int = 4) -> str:
    return f"(round_even(({expr}) * 1e{digits}, 0) / 1e{digits} + 0.0)"


def title_sql(expr: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all(lower(trim({expr})), "
            r"'\p{L}+|\P{L}+'), lambda w: upper(w[1]) || w[2:]), '')")


def nearest_sql(value: str, q: float) -> str:
    """Element of rank q(n-1), rounded half up."""
    return (f"list_sort(list({value}) FILTER (WHERE {value} IS NOT NULL))"
            f"[CAST(floor({q} * (count({value}) - 1) + 0.5) AS BIGINT) + 1]")


def ratio_sql(num: str, den: str) -> str:
    return f"CASE WHEN {den} > 0 THEN round_even({num} / {den} * 100.0 * 100, 0) / 100 END"
