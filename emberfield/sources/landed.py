"""Readers of files landed from the public APIs, and of the tables kept between steps.

Fetching over the network is left to whatever lands the files; one landed page is one JSON file.
Readers ask for explicit schemas, so no pass is spent on inference.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberfield import constants as K
from emberfield.functions.geometry import parse_geometry
from emberfield.functions.numeric import sentinel_to_null, to_number, to_number_or_zero, within_range
from emberfield.functions.text import composite_key, null_tokens, title_case, zero_pad
from emberfield.functions.time import parse_time
from emberfield.operators.columns import require_columns, with_absent_columns
from emberfield.operators.nearest import outer_merge


def _text_schema(columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}` string" for c in columns)


def read_pages(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """JSON pages concatenated: arrays of objects, or with ``lines`` one object per line.

    An array page is one task; files of lines are split, so large landings should use lines.
    """
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def read_incident_pages(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Incident pages: required fields present, times parsed, missing counts as zero."""
    raw = read_pages(spark, path, _text_schema(
        [*K.INCIDENT_TEXT, *K.INCIDENT_TIMES, *K.INCIDENT_COUNTS]), lines)
    return type_incidents(raw.where(
        F.col("neighborhood_district").isNotNull() & F.col("arrival_dttm").isNotNull()))


def type_incidents(df: DataFrame) -> DataFrame:
    """Lenient types for whichever incident columns are there."""
    out = {c: parse_time(F.col(c)) for c in K.INCIDENT_TIMES if c in df.columns}
    out |= {c: to_number_or_zero(F.col(c)) for c in K.INCIDENT_COUNTS if c in df.columns}
    return df.withColumns(out)


def read_crosswalk_pages(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Tract to neighborhood pairs with padded ids and normalised names."""
    raw = read_pages(spark, path, "geoid string, neighborhoods_analysis_boundaries string", lines)
    renamed = raw.withColumnsRenamed({"neighborhoods_analysis_boundaries": "neighborhood"})
    return renamed.select(zero_pad(F.col("geoid"), K.TRACT_ID_WIDTH).alias("geoid"),
                          title_case(F.col("neighborhood")).alias("neighborhood"))


def crosswalk_summary(crosswalk: DataFrame) -> DataFrame:
    return crosswalk.agg(F.count(F.lit(1)).alias("pairs"),
                         F.count_distinct("neighborhood").alias("neighborhoods"))


def explode_census_array(df: DataFrame, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """Array-of-arrays text whose first row is the header: one row per tract as a map ``cells``."""
    table = df.select(*keep, F.from_json(F.col(text), "array<array<string>>").alias("t"))
    rows = table.select(*keep, F.col("t")[0].alias("header"),
                        F.explode(F.slice("t", F.lit(2), F.greatest(F.size("t") - 1, F.lit(0)))).alias("row"))
    cells = F.map_from_arrays("header", "row")
    return rows.select(*keep, cells.alias("cells"), F.col("header"))


def census_codes(cells: DataFrame, codes: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Tract key and the values of the given codes; a code the table does not have is null."""
    return cells.select(
        *keep,
        composite_key(*[F.try_element_at("cells", F.lit(p)) for p in ("state", "county", "tract")])
        .alias("geoid"),
        *[F.try_element_at("cells", F.lit(c)).alias(c) for c in codes])


def census_measures(df: DataFrame) -> DataFrame:
    """Codes renamed to measures, lenient numbers, sentinels to null, absent measures added."""
    renamed = df.withColumnsRenamed(K.CENSUS_MEASURES)
    typed = renamed.withColumns({
        c: sentinel_to_null(to_number(F.col(c)), K.CENSUS_SENTINEL_FLOOR)
        for c in K.CENSUS_COLUMNS if c in renamed.columns})
    return with_absent_columns(typed, K.CENSUS_COLUMNS, "double").select("geoid", *K.CENSUS_COLUMNS)


def read_census(spark: SparkSession, paths: Sequence[str], lines: bool = False) -> DataFrame:
    """Tract table of one year from one file, or from several that hold one group of codes each.

    A file is one array, or with ``lines`` one array per line, each with the same header; files of
    lines are split, so large landings should use lines.

    Groups are merged on the tract with a full outer join, so a tract missing in one group stays.
    Which codes a file has is read from its header row.
    """
    parts = []
    for path in paths:
        cells = explode_census_array(spark.read.text(path, wholetext=not lines), "value")
        head = cells.select("header").first()
        codes = [c for c in K.CENSUS_MEASURES if head and c in head["header"]]
        if codes:
            parts.append(census_codes(cells, codes))
    if not parts:
        raise ValueError("no census file holds any of the wanted codes")
    return census_measures(outer_merge(parts, ["geoid"]))


def read_crime_pages(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Monthly counts in their raw columns."""
    columns = ["by_month_incident_date", "analysis_neighborhood", "incident_category", "count"]
    raw = read_pages(spark, path, _text_schema(columns), lines)
    return (raw.where(F.col("analysis_neighborhood").isNotNull())
            .withColumn("count", to_number_or_zero(F.col("count"))))


def read_parcel_pages(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Parcels with geometry; implausible construction years are missing."""
    raw = read_pages(spark, path, "the_geom struct<type:string,coordinates:string>, "
                     + _text_schema(["blklot", "yrbuilt", "landuse", "resunits", "st_area_sh"]), lines)
    return type_parcels(raw.where(F.col("the_geom").isNotNull()))


def type_parcels(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "yrbuilt": within_range(to_number(F.col("yrbuilt")), *K.YEAR_BUILT_RANGE),
        "resunits": to_number(F.col("resunits")),
        "st_area_sh": to_number(F.col("st_area_sh")),
    })


def read_polygons(spark: SparkSession, path: str, name: str = "nhood") -> DataFrame:
    """GeoJSON feature collection to ``neighborhood`` and ``geometry`` (multi-polygon).

    A collection is one JSON document and so read by one task; the outlines are spread before they are parsed.
    """
    schema = (f"features array<struct<properties:struct<`{name}`:string>,"
              "geometry:struct<type:string,coordinates:string>>>")
    features = (spark.read.schema(schema).option("multiLine", True).json(path)
                .select(F.explode("features").alias("f"))).repartition(spark.sparkContext.defaultParallelism)
    return features.select(
        title_case(F.col("f.properties")[name]).alias("neighborhood"),
        parse_geometry(F.col("f.geometry.type"), F.col("f.geometry.coordinates")).alias("geometry"))


def read_table(spark: SparkSession, path: str, hint: str = "", columns: Sequence[str] = ()) -> DataFrame:
    """Parquet table with a clear error for a missing path or missing mandatory columns."""
    return require_columns(_existing(lambda: spark.read.parquet(path), path, hint), columns, hint)


def read_keyed_csv(
    spark: SparkSession, path: str, schema: str, hint: str = "", sep: str = ",", multi_line: bool = False,
) -> DataFrame:
    """CSV with header and explicit schema, so ids such as ``geoid`` stay text.

    Quotes inside a value are doubled. ``multi_line`` allows line ends inside quotes, at the price of
    one task per file.
    """
    reader = spark.read.schema(schema)
    return _existing(lambda: reader.csv(
        path, header=True, enforceSchema=False, sep=sep, quote='"', escape='"', multiLine=multi_line), path, hint)


def read_loose_csv(spark: SparkSession, path: str, numbers: Sequence[str] = (), multi_line: bool = False) -> DataFrame:
    """CSV read as text with four null tokens; the named columns become lenient numbers."""
    raw = spark.read.csv(path, header=True, mode="PERMISSIVE", quote='"', escape='"', multiLine=multi_line)
    text = raw.select(*[null_tokens(F.col(f"`{c}`"), K.NULL_TOKENS).alias(c) for c in raw.columns])
    return text.withColumns({c: to_number(F.col(c)) for c in numbers if c in raw.columns})


def find_source(spark: SparkSession, folder: str, name: str = "fire_incidents.parquet") -> DataFrame:
    """The parquet table in a folder if it exists, else the first CSV file by name.

    A CSV table that Spark wrote in parts counts as one file.
    """
    try:
        return spark.read.parquet(f"{folder}/{name}")
    except AnalysisException:
        pass
    try:
        first = (spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder)
                 .select("path").orderBy("path").first())
    except AnalysisException:
        first = None
    if first is None:
        raise FileNotFoundError(f"no parquet table {name} and no CSV file in {folder}")
    parts = re.sub(r"/part-\d+-([0-9a-f-]{36})[^/]*\Z", r"/part-*-\1*.csv", first["path"])
    return read_loose_csv(spark, parts, K.PROFILE_NUMBERS)


def file_sizes(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Size in bytes of every file below a folder; the content column is not read."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
            .option("recursiveFileLookup", True).load(folder).select("path", "length"))


def _existing(read, path: str, hint: str) -> DataFrame:
    try:
        return read()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"{path} not found. {hint}".strip()) from error
        raise
