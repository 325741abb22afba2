"""Roll-ups of small units (tracts, monthly counts, parcels) to districts.

All of them are sums, counts, minima and maxima: Spark combines them map-side, so a hot district
costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfield import constants as K
from emberfield.functions.numeric import (
    below_flag, member_flag, round_even, to_number, to_number_or_zero, to_whole, truncate)
from emberfield.functions.text import clean_text, title_case
from emberfield.operators.columns import present


def weighted_mean(value: Column, weight: Column, strict_weights: bool = False) -> Column:
    """Sum of value x weight over the sum of weights; null unless that sum is positive.

    A row without value still weighs in the denominator, which pulls the mean down; with
    ``strict_weights`` only rows with a value weigh.
    """
    counted = F.when(value.isNotNull(), weight) if strict_weights else weight
    total = F.sum(counted)
    return F.coalesce(F.sum(value * weight), F.lit(0.0)) / F.when(total > 0, total)


def sum_or_zero(value: Column) -> Column:
    """Sum that is 0, not null, for a group without any value."""
    return F.coalesce(F.sum(value), F.lit(0))


def weighted_rollup(
    df: DataFrame,
    by: Sequence[str],
    weight: str,
    means: Sequence[str],
    sums: Sequence[str],
    strict_weights: bool = False,
) -> DataFrame:
    """Weight total, weighted means and component sums per group, all as whole numbers."""
    w = F.col(weight)
    return df.groupBy(*by).agg(
        truncate(sum_or_zero(w)).alias(weight),
        *[to_whole(weighted_mean(F.col(c), w, strict_weights)).alias(c) for c in means],
        *[F.rint(sum_or_zero(F.col(c))).alias(c) for c in sums],
    )


def census_rollup(
    tracts: DataFrame, crosswalk: DataFrame, by: Sequence[str] = (), strict_weights: bool = False,
) -> DataFrame:
    """Tracts to neighborhoods; ``by`` adds the snapshot column when several are stacked.

    Tracts without a neighborhood drop out. The crosswalk is a small file that Catalyst
    broadcasts by its size.
    """
    joined = tracts.join(crosswalk.where(F.col("neighborhood").isNotNull()), "geoid", "inner")
    return weighted_rollup(joined, [*by, "neighborhood"], "total_population",
                           K.CENSUS_MEDIANS, K.CENSUS_SUMS, strict_weights)


def unify_crime_schema(raw: DataFrame) -> DataFrame:
    """Raw and prepared monthly counts brought to one schema; blank categories drop out.

    A ready ``neighborhood`` column and ready flags are used when they exist.
    """
    name = "neighborhood" if "neighborhood" in raw.columns else "analysis_neighborhood"
    category = clean_text(F.col("incident_category"))

    def flag(column: str, members: Sequence[str]) -> Column:
        return F.col(column) if column in raw.columns else member_flag(category, members)

    return raw.select(
        title_case(F.col(name)).alias("neighborhood"),
        category.alias("incident_category"),
        to_number_or_zero(F.col("count")).alias("count"),
        flag("is_violent", K.VIOLENT_CATEGORIES).cast("int").alias("is_violent"),
        flag("is_property", K.PROPERTY_CATEGORIES).cast("int").alias("is_property"),
    ).where(F.col("incident_category") != "")


def flagged_totals(df: DataFrame, by: str, measure: str, total: str, flags: dict[str, str]) -> DataFrame:
    """Total of a measure and its part under each flag, as integers; null groups drop out."""
    m = F.col(measure)
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(
        truncate(sum_or_zero(m)).alias(total),
        *[truncate(sum_or_zero(m * F.col(flag))).alias(out) for out, flag in flags.items()],
    )


def crime_rollup(raw: DataFrame) -> DataFrame:
    """Totals per neighborhood. Counts are first summed per raw name and category, so that names
    are normalised once per distinct pair and not once per row."""
    keys = present(raw, ["neighborhood", "analysis_neighborhood", "incident_category",
                         "is_violent", "is_property"])
    counted = raw.groupBy(*keys).agg(F.sum(to_number_or_zero(F.col("count"))).alias("count"))
    return flagged_totals(
        unify_crime_schema(counted), "neighborhood", "count", "total_crimes",
        {"violent_crime_count": "is_violent", "property_crime_count": "is_property"})


def parcel_rollup(
    parcels: DataFrame,
    by: str = "neighborhood",
    key: str = "blklot",
    year: str = "yrbuilt",
    use: str = "landuse",
    units: str = "resunits",
    area: str = "st_area_sh",
    residential: Sequence[str] = tuple(K.RESIDENTIAL_USES),
    high_risk: Sequence[str] = tuple(K.HIGH_RISK_USES),
) -> DataFrame:
    """Counts by age and use and area sums of parcels per district."""
    y, a = to_number(F.col(year)), to_number(F.col(area))
    risky = member_flag(F.col(use), high_risk)
    return parcels.where(F.col(by).isNotNull()).groupBy(by).agg(
        F.count(key).alias("parcel_count"),
        F.count(y).alias("yrbuilt_count"),
        F.sum(below_flag(y, 1940)).alias("pre1940_count"),
        F.sum(below_flag(y, 1960)).alias("pre1960_count"),
        F.rint(sum_or_zero(to_number(F.col(units)))).alias("total_resunits"),
        F.sum(member_flag(F.col(use), residential)).alias("residential_count"),
        sum_or_zero(a).alias("total_area_sqft"),
        F.sum(F.coalesce(a, F.lit(0.0)) * risky).alias("high_risk_commercial_area_sqft"),
    )


def grand_totals(rollup: DataFrame, sums: Sequence[str], share: tuple[str, str] | None = None) -> DataFrame:
    """Number of groups, totals over a roll-up and the percent share of one total in another."""
    cols = [F.count(F.lit(1)).alias("groups"), *[F.sum(c).alias(c) for c in sums]]
    if share:
        part, whole = share
        total = F.sum(whole)
        cols.append((F.sum(part) / F.when(total != 0, total) * 100).alias("share_pct"))
    return rollup.agg(*cols)


def group_rates(
    df: DataFrame,
    by: str,
    key: str,
    condition: Column,
    first: Sequence[str],
    order: Sequence[str],
    digits: int = 3,
) -> DataFrame:
    """Rows, rows that meet the condition, their percent, and the first value of some columns.

    "First" is the earliest non-null value by the given order columns, so it does not depend on
    how rows are spread over tasks.
    """
    rank = F.struct(*order)
    grouped = df.where(F.col(by).isNotNull()).groupBy(by).agg(
        F.count(key).alias("total"),
        F.count_if(condition).alias("hits"),
        *[F.min_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in first],
    )
    total = F.col("total")
    return grouped.withColumn(
        "rate_pct", round_even(F.col("hits") / F.when(total > 0, total) * 100, digits))
