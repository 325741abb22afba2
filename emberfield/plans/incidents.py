"""From incidents and area tables to the base table and the feature table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberfield import constants as K
from emberfield.functions.numeric import safe_ratio, to_whole
from emberfield.functions.text import title_case
from emberfield.functions.time import elapsed_minutes, is_night, is_weekend
from emberfield.operators.columns import require_columns
from emberfield.operators.nearest import with_nearest_snapshot
from emberfield.operators.profile import null_profile
from emberfield.operators.rollup import census_rollup, crime_rollup, parcel_rollup
from emberfield.operators.spatial import join_within, with_centroid
from emberfield.session import materialize

RAW_MEASURES = [
    "total_crimes", "violent_crime_count", "property_crime_count",
    "parcel_count", "yrbuilt_count", "pre1940_count", "pre1960_count", "total_resunits",
    "residential_count", "total_area_sqft", "high_risk_commercial_area_sqft", *K.CENSUS_COLUMNS,
]


def prepare_incidents(
    df: DataFrame,
    start: str = "alarm_dttm",
    end: str = "arrival_dttm",
    day: str = "incident_date",
    district: str = "neighborhood_district",
    bounds: tuple[float, float] = (0.0, 60.0),
) -> DataFrame:
    """Response minutes within bounds, calendar columns and the normalised district name."""
    kept = (df.withColumn("response_time_min", elapsed_minutes(F.col(start), F.col(end)))
            .where(F.col("response_time_min").between(*bounds)))
    hour, weekday = F.hour(start), F.weekday(F.col(start))
    return kept.withColumns({
        "year": F.year(day), "month": F.month(day), "hour": hour, "weekday": weekday,
        "is_weekend": is_weekend(weekday), "is_night": is_night(hour),
        "neighborhood": title_case(F.col(district)),
    })


def locate_parcels(parcels: DataFrame, polygons: DataFrame, step: float | None = None) -> DataFrame:
    """Parcels whose centroid lies strictly inside a district, with that district.

    Parcels without a usable geometry drop out before the join, unmatched ones after it.
    """
    require_columns(parcels, ["st_area_sh"], "land the parcel pages with the area column")
    return locate_parcels_left(parcels, polygons, step).where(F.col("neighborhood").isNotNull())


def locate_parcels_left(parcels: DataFrame, polygons: DataFrame, step: float | None = None) -> DataFrame:
    """Like :func:`locate_parcels` with unmatched parcels kept (for the match rate)."""
    keep = [c for c in ("blklot", "yrbuilt", "landuse", "resunits", "st_area_sh") if c in parcels.columns]
    points = with_centroid(parcels, F.col("the_geom.type"), F.col("the_geom.coordinates"), keep)
    return join_within(points, polygons, step=step)


@dataclass
class Rollups:
    """Materialised district tables: one row per district, census also per snapshot."""

    census: DataFrame
    crime: DataFrame
    land: DataFrame


def build_rollups(
    tracts: DataFrame, crosswalk: DataFrame, crime: DataFrame, parcels: DataFrame, polygons: DataFrame,
) -> Rollups:
    """``tracts`` stacks all snapshots with a ``snapshot_year`` column. Each roll-up is written once."""
    return Rollups(
        materialize(census_rollup(tracts, crosswalk, by=["snapshot_year"]), "census"),
        materialize(crime_rollup(crime), "crime"),
        materialize(parcel_rollup(locate_parcels(parcels, polygons)), "land-use"))


def attach_rollups(
    incidents: DataFrame, rollups: Rollups, years: Sequence[int] = tuple(K.SNAPSHOT_YEARS),
) -> DataFrame:
    """One row per incident within the response bounds, with the roll-ups of its district.

    The roll-ups are merged into one table per district and snapshot first, so the incidents take part
    in a single join. It is a broadcast where the file size allows; else both sides are plain shuffles,
    and adaptive skew handling splits a district with many incidents.
    """
    facts = with_nearest_snapshot(prepare_incidents(incidents), years)
    merged = materialize(merge_rollups(rollups, years), "districts")
    same = facts["neighborhood"].eqNullSafe(merged["_district"]) & facts["snapshot_year"].eqNullSafe(merged["_snapshot"])
    return (facts.join(merged, same, "left").drop("_district", "_snapshot")
            .withColumnRenamed("snapshot_year", "acs_year"))


def merge_rollups(rollups: Rollups, years: Sequence[int]) -> DataFrame:
    """Every district with each snapshot and with none: ``_district``, ``_snapshot`` and all measures."""
    tables = (rollups.census, rollups.crime, rollups.land)
    names = reduce(DataFrame.union, [t.select("neighborhood") for t in tables]).where("neighborhood is not null").distinct()
    snapshots = F.array(*[F.lit(y) for y in years], F.lit(None).cast("int"))
    rows = names.select("neighborhood", F.explode(snapshots).alias("snapshot_year"))
    merged = (rows.join(rollups.census, ["neighborhood", "snapshot_year"], "left")
              .join(rollups.crime, "neighborhood", "left").join(rollups.land, "neighborhood", "left"))
    return merged.withColumnsRenamed({"neighborhood": "_district", "snapshot_year": "_snapshot"})


def base_table(
    incidents: DataFrame,
    tracts: DataFrame,
    crosswalk: DataFrame,
    crime: DataFrame,
    parcels: DataFrame,
    polygons: DataFrame,
    years: Sequence[int] = tuple(K.SNAPSHOT_YEARS),
) -> DataFrame:
    return attach_rollups(incidents, build_rollups(tracts, crosswalk, crime, parcels, polygons), years)


def add_rates(df: DataFrame, rates: dict[str, tuple[str, str]] = K.RATES) -> DataFrame:
    """Add each rate whose two columns are there."""
    return df.withColumns({
        name: safe_ratio(F.col(num), F.col(den)) for name, (num, den) in rates.items()
        if num in df.columns and den in df.columns})


def feature_table(base: DataFrame) -> DataFrame:
    """Base table plus rates, with count columns as nullable whole numbers."""
    out = add_rates(base)
    whole = ["total_population", *K.CENSUS_SUMS, "total_resunits"]
    return out.withColumns({c: to_whole(F.col(c)) for c in whole if c in out.columns})


def missing_measures(base: DataFrame) -> DataFrame:
    """Missing percent of the attached raw measures."""
    return null_profile(base, [c for c in RAW_MEASURES if c in base.columns])
