"""Statistics profile of the wide incident export, as one long table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfield import constants as K
from emberfield.functions.numeric import to_number
from emberfield.functions.time import elapsed_whole_minutes, parse_iso_millis
from emberfield.operators.columns import present
from emberfield.operators.frequency import top_of_counts
from emberfield.operators.profile import NULLS_SCHEMA, describe, profile_of_counts, schema_table
from emberfield.session import materialize, materialize_observed


def parse_export_times(df: DataFrame) -> DataFrame:
    """Text times parsed strictly; columns that are timestamps already stay."""
    return df.withColumns({c: time_column(df, c) for c in present(df, K.PROFILE_TIMES)})


def statistics_tables(df: DataFrame) -> dict[str, DataFrame]:
    """The parts of the profile by section; sections without their columns are left out.

    The export is read once: what fits into one row is observed while the columns that need more are
    written. Of those, one long count serves all categories and response pairs, and the numbers share
    the passes of :func:`~emberfield.operators.quantiles.wide_quantiles`.
    """
    spark = df.sparkSession
    df = df.withColumns({c: to_number(F.col(c)) for c in present(df, K.PROFILE_NUMBERS)})
    categories, numbers = present(df, K.PROFILE_CATEGORIES), present(df, K.PROFILE_NUMBERS)
    times, casualties = present(df, K.PROFILE_TIMES), present(df, K.CASUALTIES)
    pairs = [p for p in K.RESPONSE_PAIRS if p[1] in df.columns and p[2] in df.columns]
    # Parsed times stand beside the raw ones, whose nulls are counted.
    minutes = [f"_m{i}" for i in range(len(pairs))]
    parsed = df.withColumns({f"_t_{c}": time_column(df, c) for c in times}).withColumns({
        m: elapsed_whole_minutes(F.col(f"_t_{start}"), F.col(f"_t_{end}")) for m, (_, start, end) in zip(minutes, pairs)})
    metrics = [F.count(F.lit(1)).alias("rows")]
    metrics += [F.count(c).alias(f"n_{i}") for i, c in enumerate(df.columns)]
    metrics += [f(f"_t_{c}").alias(f"{name}_{c}") for c in times for name, f in (("first", F.min), ("last", F.max))]
    for c in casualties:
        metrics += [F.coalesce(F.sum(c), F.lit(0.0)).try_cast("long").alias(f"total_{c}"), F.count_if(F.col(c) > 0).alias(f"above_{c}")]
    kept, seen = materialize_observed(parsed, metrics, [*dict.fromkeys([*categories, *numbers]), *minutes], "statistics")
    rows = seen["rows"]
    nulls = [(c, rows - seen[f"n_{i}"], rows, (rows - seen[f"n_{i}"]) / rows * 100)
             for i, c in enumerate(df.columns) if rows > seen[f"n_{i}"]]
    out = {
        "schema": schema_table(df),
        "shape": spark.createDataFrame([("incidents", rows, len(df.columns))], "table string, rows long, columns int"),
        "missing": spark.createDataFrame(nulls, NULLS_SCHEMA).orderBy(F.desc("nulls"), "column"),
    }
    if categories or pairs:
        counts = materialize(_long_counts(kept, categories, pairs), "long-counts")
    if categories:
        out["categories"] = top_of_counts(counts.where(F.col("column").isin(categories)).select("column", "value", "n"), 10)
    if numbers:
        out["numbers"] = describe(kept, numbers)
    if times:
        covered = [(c, seen[f"first_{c}"], seen[f"last_{c}"]) for c in times if seen[f"first_{c}"] is not None]
        out["coverage"] = spark.createDataFrame(covered, "column string, first timestamp_ntz, last timestamp_ntz")
    if pairs:
        of_pairs = counts.where(F.col("x").isNotNull()).select(F.col("column").alias("label"), "x", "n")
        out["response"] = profile_of_counts(of_pairs, "x", "n", ["label"])
    if casualties:
        out["casualties"] = spark.createDataFrame(
            [(c, seen[f"total_{c}"], seen[f"above_{c}"]) for c in casualties], "column string, total long, rows_above_zero long")
    return out


def time_column(df: DataFrame, c: str) -> Column:
    """A time of the export: text is parsed strictly."""
    return parse_iso_millis(F.col(c)) if dict(df.dtypes)[c] == "string" else F.col(c).cast("timestamp_ntz")


def _long_counts(df: DataFrame, categories: list[str], pairs: list[tuple[str, str, str]], limit: float = 480.0) -> DataFrame:
    """(column, value, x, n): every category value, null included, and every duration of a pair within the limit."""
    def item(name: str, value: Column, x: Column) -> Column:
        return F.struct(F.lit(name).alias("column"), value.cast("string").alias("value"), x.cast("double").alias("x"))

    none = F.lit(None)
    items = [item(c, F.col(c), none) for c in categories]
    items += [F.when(F.col(f"_m{i}").between(0, limit), item(label, none, F.col(f"_m{i}"))) for i, (label, _, _) in enumerate(pairs)]
    return df.select(F.inline(F.filter(F.array(*items), lambda x: x.isNotNull()))).groupBy("column", "value", "x").agg(
        F.count(F.lit(1)).alias("n"))


# Columns that name the item of a row; all others are metrics.
_ITEM = {"schema": ["column"], "shape": ["table"], "missing": ["column"],
         "categories": ["column", "rank"], "numbers": ["column"], "coverage": ["column"],
         "response": ["label"], "casualties": ["column"]}


def statistics_long(df: DataFrame) -> DataFrame:
    """All sections as (section, item, metric, value) text rows."""
    parts = []
    for section, table in statistics_tables(df).items():
        metrics = [c for c in table.columns if c not in _ITEM[section]]
        item = F.concat_ws(" #", *[F.col(c).cast("string") for c in _ITEM[section]])
        parts.append(
            table.select(F.lit(section).alias("section"), item.alias("item"),
                         *[F.col(c).cast("string").alias(c) for c in metrics])
            .unpivot(["section", "item"], metrics, "metric", "value"))
    return reduce(lambda a, b: a.unionByName(b), parts)
