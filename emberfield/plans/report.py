"""The tables behind the report pages."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfield import constants as K
from emberfield.functions.numeric import completeness_grade, to_number, truncate
from emberfield.functions.text import short_label
from emberfield.functions.time import elapsed_whole_minutes, month_name, weekday_name
from emberfield.operators.columns import present
from emberfield.operators.frequency import all_bins, bin_number, distinct_count, in_fixed_order
from emberfield.operators.profile import NULLS_SCHEMA
from emberfield.operators.quantiles import quantiles_of_counts
from emberfield.plans.statistics import parse_export_times
from emberfield.session import materialize, materialize_observed

FIRST_YEAR = 2003

# Number of values shown per column, and the label width of the bar charts.
TOP_VALUES = {
    "primary_situation": (20, 52), "property_use": (15, 52), "neighborhood_district": (20, 35),
    "ignition_cause": (10, 48), "heat_source": (10, 48), "fire_spread": (None, 48),
    "detectors_present": (8, 48), "detector_effectiveness": (8, 48),
    "automatic_extinguishing_system_present": (8, 48),
    "automatic_extinguishing_sytem_perfomance": (8, 48),
}
# Columns of the resource page.
RESOURCE_COLUMNS = ["suppression_units", "ems_units", "suppression_personnel", "number_of_alarms"]


def prepare_export(df: DataFrame) -> DataFrame:
    """Typed export with calendar columns and whole-second response and duration minutes."""
    typed = parse_export_times(
        df.withColumns({c: to_number(F.col(c)) for c in present(df, K.PROFILE_NUMBERS)}))
    added: dict[str, Column] = {}
    if "alarm_dttm" in typed.columns:
        alarm = F.col("alarm_dttm")
        added = {"year": F.year(alarm), "month_name": month_name(alarm), "hour": F.hour(alarm),
                 "weekday": weekday_name(alarm)}
        for name, end in (("response_min", "arrival_dttm"), ("duration_min", "close_dttm")):
            if end in typed.columns:
                added[name] = elapsed_whole_minutes(alarm, F.col(end))
    return typed.withColumns(added)


def key_figures(df: DataFrame) -> DataFrame:
    """One row with the cover figures (those whose columns are there)."""
    has = set(df.columns)
    cols = [F.count(F.lit(1)).alias("total_records")]
    if "incident_number" in has:
        cols.append(distinct_count("incident_number", True).alias("unique_incidents"))
    if "incident_date" in has:
        cols += [F.min("incident_date").alias("first_date"), F.max("incident_date").alias("last_date")]
    if "response_min" in has:
        rt = F.col("response_min")
        cols.append(F.avg(F.when(rt.between(0, 120), rt)).alias("avg_response_min"))
    cols += [F.coalesce(F.sum(c), F.lit(0.0)).alias(f"total_{c}")
             for c in present(df, [*K.CASUALTIES, "estimated_property_loss"])]
    if "neighborhood_district" in has:
        cols.append(distinct_count("neighborhood_district", True).alias("unique_neighborhoods"))
    return df.agg(*cols)


def since_first_year(df: DataFrame) -> DataFrame:
    return df.where(F.col("year") >= FIRST_YEAR)


def casualties_by_year(df: DataFrame) -> DataFrame:
    sums = [F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in present(df, K.CASUALTIES)]
    return since_first_year(df).groupBy("year").agg(*sums).orderBy("year")


def report_tables(df: DataFrame) -> dict[str, DataFrame]:
    """All report tables of a prepared export, by name.

    The export is read once, while the columns of the counted tables are written; figures that fit into one
    row are observed on the way. One long count of the written columns gives the rest: per item and value
    it is small, but for the incident numbers, which are only counted.
    """
    spark, has = df.sparkSession, set(df.columns)
    shown = [c for c in df.columns if c not in K.COMPLETENESS_SKIP]
    casualties, losses = present(df, K.CASUALTIES), present(df, ["estimated_property_loss"])
    counted = present(df, ["incident_number", "neighborhood_district", "year", "month_name", "hour", "weekday", "battalion",
                           "response_min", *casualties, *losses, *TOP_VALUES, *RESOURCE_COLUMNS])
    kept, seen = materialize_observed(df, _one_row_figures(df, shown, casualties, losses), list(dict.fromkeys(counted)), "report")
    counts = materialize(_long_counts(kept, seen, casualties), "report-counts")

    def item(name: str) -> DataFrame:
        return counts.where(F.col("item") == name)

    def by_value(name: str, column: str) -> DataFrame:
        return item(name).select(F.col("value").alias(column), "n")

    def by_number(name: str, column: str, kind: str) -> DataFrame:
        return item(name).select(F.col("x").cast(kind).alias(column), "n")

    out = {"key_figures": _figures_table(df, seen, casualties, losses, item)}
    if "year" in has:
        out["per_year"] = by_number("year", "year", "int").orderBy("year")
        out["per_month"] = in_fixed_order(by_value("month_name", "label"), K.MONTH_NAMES)
        out["per_hour"] = by_number("hour", "hour", "int").orderBy("hour")
        out["per_weekday"] = in_fixed_order(by_value("weekday", "label"), K.WEEKDAY_NAMES)
        if casualties:
            out["casualties_by_year"] = item("year").select(F.col("x").cast("int").alias("year"), *casualties).orderBy("year")
            out["casualty_totals"] = spark.createDataFrame(
                [(c, int(seen[f"sum_{c}"]), seen[f"above_{c}"]) for c in casualties], "column string, total long, rows_above_zero long")
    for column, (k, width) in TOP_VALUES.items():
        if column in has:
            ranked = by_value(f"top_{column}", column).orderBy(F.desc("n"), F.asc(column))
            ranked = ranked if k is None else ranked.limit(k)
            out[f"top_{column}"] = ranked.withColumn("label", short_label(F.col(column), width))
    if "response_min" in has:
        out["response_histogram"] = all_bins(by_number("response_bin", "bin", "long"), *_limits(seen, "response"), 60)
        found = quantiles_of_counts(item("response"), "x", "n", {"median": 0.5, "p90": 0.9}, ["item"])
        # One row also without any response.
        out["response_percentiles"] = spark.range(1).select(F.lit("response").alias("item")).join(F.broadcast(found), "item", "left").select(
            F.coalesce("n", F.lit(0)).alias("n"), "median", "p90")
        if "battalion" in has:
            out["response_by_battalion"] = quantiles_of_counts(
                item("battalion_response").withColumnRenamed("value", "battalion"), "x", "n", {"median_min": 0.5},
                ["battalion"]).select("battalion", "n", "median_min").orderBy("median_min", "battalion")
    resources = present(df, RESOURCE_COLUMNS)
    if resources:
        values = counts.where(F.col("item").isin([f"values_{c}" for c in resources]))
        caps = quantiles_of_counts(values, "x", "n", {"cap": (0.99, "nearest")}, ["item"]).select("item", "cap")
        below = materialize(values.join(caps, "item").where("x <= cap").groupBy("item", truncate(F.col("x")).alias("whole")).agg(
            F.sum("n").alias("n")), "resource-values")
        for c in resources:
            out[f"values_{c}"] = below.where(F.col("item") == f"values_{c}").select(F.col("whole").alias(c), "n").orderBy(c)
    if "battalion" in has:
        out["per_battalion"] = by_value("battalion", "battalion").orderBy(F.desc("n"), "battalion")
    if losses:
        out["loss_histogram"] = all_bins(by_number("loss_bin", "bin", "long"), *_limits(seen, "loss"), 40)
    rows = seen["rows"]
    nulls = [(c, rows - seen[f"n_{i}"], rows, (rows - seen[f"n_{i}"]) / rows * 100 if rows else None) for i, c in enumerate(shown)]
    out["completeness"] = spark.createDataFrame(nulls, NULLS_SCHEMA).withColumn(
        "grade", completeness_grade(F.col("null_pct"))).withColumn("label", short_label(F.col("column"), 52)).orderBy("null_pct", "column")
    return out


def report_long(df: DataFrame) -> DataFrame:
    """All report tables as (report, item, metric, value): the first column of a table, or its label, names the item."""
    parts = []
    for name, table in report_tables(df).items():
        label = next((c for c in ("position", "column") if c in table.columns), table.columns[0])
        numbers = [c for c, kind in table.dtypes if c != label and kind not in ("string", "timestamp_ntz")]
        item = F.lit("all") if name in ("key_figures", "response_percentiles") else F.coalesce(F.col(label).cast("string"), F.lit("missing"))
        if name in ("key_figures", "response_percentiles"):
            numbers = [c for c, kind in table.dtypes if kind not in ("string", "timestamp_ntz")]
        parts.append(table.select(F.lit(name).alias("report"), item.alias("item"), *[F.col(c).cast("double").alias(c) for c in numbers])
                     .unpivot(["report", "item"], numbers, "metric", "value"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _one_row_figures(df: DataFrame, shown: list[str], casualties: list[str], losses: list[str]) -> list[Column]:
    out = [F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"n_{i}") for i, c in enumerate(shown)]]
    if "incident_date" in df.columns:
        out += [F.min("incident_date").alias("first_date"), F.max("incident_date").alias("last_date")]
    if "response_min" in df.columns:
        rt = F.col("response_min")
        near = F.when(rt.between(0, 60), rt)
        out += [F.avg(F.when(rt.between(0, 120), rt)).alias("avg_response_min"), F.min(near).alias("lo_response"), F.max(near).alias("hi_response")]
    for c in [*casualties, *losses]:
        out += [F.coalesce(F.sum(c), F.lit(0.0)).alias(f"sum_{c}"), F.count_if(F.col(c) > 0).alias(f"above_{c}")]
    for c in losses:
        log = F.log10(F.when(F.col(c) > 0, F.col(c)))
        out += [F.min(log).alias("lo_loss"), F.max(log).alias("hi_loss")]
    return out


def _limits(seen: dict, name: str) -> tuple[Column, Column]:
    """Ends of a histogram; one single value spreads over +-0.5 around it."""
    lo, hi = seen[f"lo_{name}"], seen[f"hi_{name}"]
    if lo is not None and lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    return F.lit(lo).cast("double"), F.lit(hi).cast("double")


def _long_counts(df: DataFrame, seen: dict, casualties: list[str]) -> DataFrame:
    """(item, value, x, n and the casualties) of the report in one count; ``value`` is text, ``x`` a number."""
    has, none = set(df.columns), F.lit(None)

    def entry(name: str, value: Column = none, x: Column = none) -> Column:
        sums = [F.col(c) if name == "year" else none.cast("double") for c in casualties]
        return F.struct(F.lit(name).alias("item"), value.cast("string").alias("value"), x.cast("double").alias("x"),
                        *[s.alias(c) for s, c in zip(sums, casualties)])

    def there(name: str, column: str, number: bool = False) -> Column:
        made = entry(name, x=F.col(column)) if number else entry(name, F.col(column))
        return F.when(F.col(column).isNotNull(), made)

    items = [entry(f"unique_{c}", F.col(c)) for c in ("incident_number", "neighborhood_district") if c in has]
    if "year" in has:
        items += [F.when(F.col("year") >= FIRST_YEAR, entry("year", x=F.col("year"))), there("month_name", "month_name"),
                  there("hour", "hour", True), there("weekday", "weekday")]
    items += [there(f"top_{c}", c) for c in TOP_VALUES if c in has]
    items += [there(f"values_{c}", c, True) for c in RESOURCE_COLUMNS if c in has]
    if "battalion" in has:
        items.append(entry("battalion", F.col("battalion")))
    if "response_min" in has:
        rt = F.col("response_min")
        near = rt.between(0, 60)
        items += [F.when(near, entry("response", x=rt)),
                  F.when(near, entry("response_bin", x=bin_number(rt, *_limits(seen, "response"), 60)))]
        if "battalion" in has:
            items.append(F.when(near & F.col("battalion").isNotNull(), entry("battalion_response", F.col("battalion"), rt)))
    if "estimated_property_loss" in has:
        loss = F.col("estimated_property_loss")
        items.append(F.when(loss > 0, entry("loss_bin", x=bin_number(F.log10(loss), *_limits(seen, "loss"), 40))))
    long = df.select(F.inline(F.filter(F.array(*items), lambda x: x.isNotNull())))
    return long.groupBy("item", "value", "x").agg(
        F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in casualties])


def _figures_table(df: DataFrame, seen: dict, casualties: list[str], losses: list[str], item: Callable[[str], DataFrame]) -> DataFrame:
    """The row of :func:`key_figures` from what was observed and counted."""
    def distinct(column: str) -> Column:
        return item(f"unique_{column}").agg(F.count(F.lit(1)).alias("n")).scalar()

    cols = [F.lit(seen["rows"]).cast("long").alias("total_records")]
    if "incident_number" in df.columns:
        cols.append(distinct("incident_number").alias("unique_incidents"))
    if "incident_date" in df.columns:
        kind = dict(df.dtypes)["incident_date"]
        cols += [F.lit(seen[c]).cast(kind).alias(c) for c in ("first_date", "last_date")]
    if "response_min" in df.columns:
        cols.append(F.lit(seen["avg_response_min"]).cast("double").alias("avg_response_min"))
    cols += [F.lit(seen[f"sum_{c}"]).alias(f"total_{c}") for c in [*casualties, *losses]]
    if "neighborhood_district" in df.columns:
        cols.append(distinct("neighborhood_district").alias("unique_neighborhoods"))
    return df.sparkSession.range(1).select(*cols)
