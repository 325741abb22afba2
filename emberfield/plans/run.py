"""The steps as a user runs them: land pages, build tables, and derive statistics, report, study.

Folders hold the files named in :mod:`emberfield.constants`. Each step reads what the one before
wrote, so any of them can be run alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberfield import constants as K
from emberfield.operators.columns import present
from emberfield.operators.nearest import snapshot_mapping, stack_snapshots
from emberfield.operators.profile import column_summary, table_inventory
from emberfield.operators.spatial import unusable_geometries
from emberfield.plans.incidents import Rollups, attach_rollups, build_rollups, feature_table, missing_measures
from emberfield.plans.report import prepare_export, report_tables
from emberfield.plans.statistics import statistics_long
from emberfield.plans.study import run_study
from emberfield.sources import landed as L
from emberfield.sources import sinks as S

_TRACT_SCHEMA = "geoid string, " + ", ".join(f"{c} double" for c in K.CENSUS_COLUMNS)


def land(
    spark: SparkSession, landing: str, raw: str, datasets: Sequence[str] = ("incidents", "crosswalk", "tracts", "crime", "parcels"),
    years: Sequence[int] = tuple(K.SNAPSHOT_YEARS), lines: bool = False,
) -> None:
    """Typed raw tables from landed API pages, for the chosen data sets.

    Pages are expected in ``landing/<data set>``, census files in ``landing/tracts/<year>/``.
    The outlines are used as landed: put the GeoJSON file into ``raw``.
    """
    def out(name: str) -> str:
        return f"{raw}/{K.RAW_FILES[name]}"

    readers = {"incidents": L.read_incident_pages, "crime": L.read_crime_pages, "parcels": L.read_parcel_pages}
    for name in datasets:
        if name in readers:
            S.write_table(readers[name](spark, f"{landing}/{name}", lines), out(name))
        elif name == "crosswalk":
            pairs = L.read_crosswalk_pages(spark, f"{landing}/{name}", lines)
            S.write_csv(pairs, out(name))
            S.write_csv(pairs.agg(F.count("*").alias("pairs"), F.count_distinct("geoid").alias("tracts"),
                                  F.count_distinct("neighborhood").alias("districts")), f"{raw}/metrics/crosswalk")
        elif name == "tracts":
            for year in years:
                files = [r["path"] for r in L.file_sizes(spark, f"{landing}/tracts/{year}", "*.json")
                         .select("path").orderBy("path").collect()]
                S.write_csv(L.read_census(spark, files), out(name).format(year=year))
        else:
            raise ValueError(f"unknown data set {name!r}")


def read_raw(spark: SparkSession, raw: str, years: Sequence[int] = tuple(K.SNAPSHOT_YEARS)) -> dict[str, DataFrame]:
    """All inputs of the base table; a missing file or column is named with a hint."""
    def path(name: str) -> str:
        return f"{raw}/{K.RAW_FILES[name]}"

    hint = "Land the data set first."
    tracts = {y: L.read_keyed_csv(spark, path("tracts").format(year=y), _TRACT_SCHEMA, hint) for y in years}
    return {
        "incidents": L.read_table(spark, path("incidents"), hint),
        "tracts": stack_snapshots(tracts),
        "crosswalk": L.read_keyed_csv(spark, path("crosswalk"), "geoid string, neighborhood string", hint),
        "crime": L.read_table(spark, path("crime"), hint),
        "parcels": L.read_table(spark, path("parcels"), hint, ["st_area_sh"]),
        "polygons": L.read_polygons(spark, path("polygons")),
    }


def build(spark: SparkSession, raw: str, results: str, years: Sequence[int] = tuple(K.SNAPSHOT_YEARS)) -> DataFrame:
    """Write the roll-ups, the base table and the feature table; returns the feature table."""
    def out(name: str) -> str:
        return f"{results}/{K.RESULT_FILES[name]}"

    inputs = read_raw(spark, raw, years)
    incidents = L.type_incidents(inputs.pop("incidents"))
    rollups = build_rollups(**inputs)
    for year in years:
        S.write_csv(rollups.census.where(f"snapshot_year = {int(year)}").drop("snapshot_year"),
                    out("census").format(year=year))
    S.write_csv(rollups.crime, out("crime"))
    S.write_csv(rollups.land, out("land"))
    S.write_table(attach_rollups(incidents, rollups, years), out("base"))
    S.write_table(feature_table(spark.read.parquet(out("base"))), out("features"))
    features = spark.read.parquet(out("features"))
    write_tables(build_metrics(inputs["parcels"], rollups, spark.read.parquet(out("base")), features), f"{results}/metrics")
    return features


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    for name, table in tables.items():
        S.write_csv(table, f"{folder}/{name}")


def build_metrics(parcels: DataFrame, rollups: Rollups, base: DataFrame, features: DataFrame) -> dict[str, DataFrame]:
    """What the build step reports: snapshots used, parcels matched, totals, missing measures, rates."""
    used = unusable_geometries(parcels, F.col("the_geom.type"), F.col("the_geom.coordinates"))
    matched = F.sum("parcel_count").alias("matched")
    return {
        "snapshots": snapshot_mapping(base, column="acs_year"),
        "parcels": used,
        "land_totals": rollups.land.agg(matched, F.sum("total_area_sqft").alias("total_area_sqft")),
        "crime_totals": rollups.crime.agg(*[F.sum(c).alias(c) for c in (
            "total_crimes", "violent_crime_count", "property_crime_count")]),
        "census_totals": rollups.census.groupBy("snapshot_year").agg(
            F.count("*").alias("districts"), F.sum("total_population").alias("total_population")),
        "missing": missing_measures(base),
        "rates": column_summary(features, present(features, K.RATES)),
    }


def overview(spark: SparkSession, raw: str, results: str) -> dict[str, DataFrame]:
    """Row counts of the tables that exist, sizes of their files, a sample and the rate summary."""
    tables: dict[str, DataFrame] = {}
    for folder, names in ((raw, K.RAW_FILES), (results, K.RESULT_FILES)):
        for name in names.values():
            for file in ([name.format(year=y) for y in K.SNAPSHOT_YEARS] if "{year}" in name else [name]):
                try:
                    path = f"{folder}/{file}"
                    tables[file] = (
                        spark.read.parquet(path) if file.endswith(".parquet")
                        else L.read_polygons(spark, path) if file.endswith(".geojson")
                        else spark.read.csv(path, header=True))
                except AnalysisException:
                    continue
    out = {"inventory": table_inventory(tables), "raw_files": L.file_sizes(spark, raw),
           "result_files": L.file_sizes(spark, results)}
    features = tables.get(K.RESULT_FILES["features"])
    if features is not None:
        out["sample"] = S.hash_sample(features, ["incident_number"])
        out["rates"] = column_summary(features, present(features, K.RATES))
    return out


def statistics(spark: SparkSession, raw: str, out: str) -> None:
    S.write_statistics(statistics_long(L.find_source(spark, raw)), out)


def report(spark: SparkSession, raw: str, out: str) -> None:
    write_tables(report_tables(prepare_export(L.find_source(spark, raw))), out)


def study(spark: SparkSession, results: str, out: str) -> None:
    features = L.read_table(spark, f"{results}/{K.RESULT_FILES['features']}", "Build the tables first.")
    write_tables(run_study(features), out)


def write_overview(spark: SparkSession, raw: str, results: str) -> None:
    write_tables(overview(spark, raw, results), f"{results}/overview")


def export_sample(spark: SparkSession, results: str, out: str, n: int = 100) -> None:
    features = L.read_table(spark, f"{results}/{K.RESULT_FILES['features']}", "Build the tables first.")
    S.write_sample(features, out, ["incident_date", "incident_number"], n)
