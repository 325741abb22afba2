"""Landed files: each query writes driver rows in a landed format and reads them with the library."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import Tables, check, title_sql
from emberfield.session import scratch_path
from emberfield.functions.geometry import polygon_edges
from emberfield.sources.landed import (
    census_codes, census_measures, explode_census_array, find_source, read_census, read_crime_pages, read_crosswalk_pages,
    read_incident_pages, read_keyed_csv, read_loose_csv, read_parcel_pages, read_polygons, read_table)
from emberfield.sources.sinks import hash_sample, sample_rows, write_csv, write_statistics, write_table

#: Keys that share one array of a written census file.
ARRAY_KEYS = 5000


@check("census_array_json", """
SELECT '06' || '075' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS geoid,
       CAST(c_nationkey * 10 AS DOUBLE) AS total_population,
       CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN CAST(c_custkey AS DOUBLE) END AS median_household_income,
       CAST(NULL AS DOUBLE) AS median_gross_rent
FROM customer
""")
def census(t: Tables):
    """One header-first array per customer; sentinels and text among the numbers."""
    income = (F.when(F.col("c_mktsegment") == "BUILDING", "-666666666")
              .when(F.col("c_mktsegment") == "MACHINERY", "n/a").otherwise(F.col("c_custkey").cast("string")))
    row = F.array(F.lit("Tract"), (F.col("c_nationkey") * 10).cast("string"), income, F.lit("06"), F.lit("075"),
                  F.lpad(F.col("c_custkey").cast("string"), 6, "0"))
    head = F.array(*[F.lit(x) for x in ("NAME", "B01003_001E", "B19013_001E", "state", "county", "tract")])
    cells = explode_census_array(t.customer.select(F.to_json(F.array(head, row)).alias("value")), "value")
    measures = census_measures(census_codes(cells, ["B01003_001E", "B19013_001E"]))
    return measures.select("geoid", "total_population", "median_household_income", "median_gross_rent")


@check("csv_null_tokens", """
SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 'a "' || o_orderpriority || '", \\ b' END AS city,
       CASE WHEN o_orderstatus = 'O' THEN CAST(o_custkey AS DOUBLE) END AS ems_units
FROM orders
""")
def null_tokens(t: Tables):
    path = scratch_path(t.spark, "export-csv")
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    t.orders.select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.when(priority == "1-URGENT", "NA").when(priority == "2-HIGH", "")
        .otherwise(F.concat(F.lit('a "'), priority, F.lit('", \\ b'))).alias("city"),
        F.when(status == "P", "N/A").when(status == "F", "few").otherwise(F.col("o_custkey").cast("string"))
        .alias("ems_units")).write.csv(path, header=True, quote='"', escape='"')  # as other tools write it
    return read_loose_csv(t.spark, path, ["ems_units"])


@check("incident_pages", """
SELECT CAST(event_id AS VARCHAR) AS incident_number, 'Area ' || user_id AS neighborhood_district,
       date_trunc('millisecond', ts) AS alarm_dttm,
       CASE WHEN event_type <> 'click' THEN date_trunc('millisecond', ts) END AS arrival_dttm,
       CASE WHEN event_type <> 'view' THEN value ELSE 0.0 END AS ems_units, 0.0::DOUBLE AS civilian_injuries
FROM events WHERE event_type <> 'signup'
""")
def pages(t: Tables):
    path = scratch_path(t.spark, "incident-pages")
    kind, iso = F.col("event_type"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS")
    t.events.select(
        F.col("event_id").cast("string").alias("incident_number"),
        F.concat(F.lit("Area "), F.col("user_id").cast("string")).alias("neighborhood_district"),
        iso.alias("alarm_dttm"),
        F.when(kind == "click", "unknown").when(kind != "signup", iso).alias("arrival_dttm"),
        F.when(kind == "view", "none").otherwise(F.col("value").cast("string")).alias("ems_units"),
    ).write.json(path)
    return read_incident_pages(t.spark, path, lines=True).select(
        "incident_number", "neighborhood_district", "alarm_dttm", "arrival_dttm", "ems_units", "civilian_injuries")


@check("crosswalk_pages", f"""
SELECT CASE WHEN length(c_custkey::VARCHAR) < 11 THEN lpad(c_custkey::VARCHAR, 11, '0') ELSE c_custkey::VARCHAR END AS geoid,
       {title_sql("c_mktsegment || '/' || c_nationkey || 'x'")} AS neighborhood FROM customer
""")
def crosswalk(t: Tables):
    path = scratch_path(t.spark, "crosswalk-pages")
    t.customer.select(
        F.col("c_custkey").cast("string").alias("geoid"),
        F.concat(F.lit("  "), "c_mktsegment", F.lit("/"), F.col("c_nationkey").cast("string"), F.lit("x "))
        .alias("neighborhoods_analysis_boundaries")).write.json(path)
    return read_crosswalk_pages(t.spark, path, lines=True)


@check("crime_pages", """
SELECT strftime(ts, '%Y-%m') AS by_month_incident_date, 'Area ' || user_id AS analysis_neighborhood,
       event_type AS incident_category, CASE WHEN event_type = 'error' THEN 0.0 ELSE round_even(value, 0) END AS count
FROM events WHERE event_type <> 'signup'
""")
def crime(t: Tables):
    path = scratch_path(t.spark, "crime-pages")
    kind = F.col("event_type")
    t.events.select(
        F.date_format("ts", "yyyy-MM").alias("by_month_incident_date"),
        F.when(kind != "signup", F.concat(F.lit("Area "), F.col("user_id").cast("string"))).alias("analysis_neighborhood"),
        kind.alias("incident_category"),
        F.when(kind == "error", "?").otherwise(F.rint("value").cast("string")).alias("count")).write.json(path)
    return read_crime_pages(t.spark, path, lines=True)


@check("parcel_pages", """
SELECT CAST(p_partkey AS VARCHAR) AS blklot, CAST(CASE WHEN 1780 + p_size * 5 BETWEEN 1800 AND 2025 THEN 1780 + p_size * 5 END AS DOUBLE) AS yrbuilt,
       p_type AS landuse, CASE WHEN p_size <> 7 THEN CAST(p_size AS DOUBLE) END AS resunits, p_retailprice AS st_area_sh
FROM part WHERE p_brand <> 'Brand#2'
""")
def parcel_pages(t: Tables):
    path = scratch_path(t.spark, "parcel-pages")
    size = F.col("p_size")
    ring = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in ((0., 0.), (1., 0.), (0., 1.), (0., 0.))])
    t.part.select(
        F.when(F.col("p_brand") != "Brand#2", F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))
        .alias("the_geom"), F.col("p_partkey").cast("string").alias("blklot"),
        (1780 + size * 5).cast("string").alias("yrbuilt"), F.col("p_type").alias("landuse"),
        F.when(size == 7, "none").otherwise(size.cast("string")).alias("resunits"),
        F.col("p_retailprice").cast("string").alias("st_area_sh")).write.json(path)
    return read_parcel_pages(t.spark, path, lines=True).drop("the_geom")


@check("csv_round_trip", """
SELECT lpad(CAST(o_orderkey AS VARCHAR), 11, '0') AS geoid, o_totalprice AS total_population,
       CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus || ' says "x;y", \\' END AS status FROM orders
""")
def csv_round_trip(t: Tables):
    """Written with semicolons, read back with the key as text."""
    path = scratch_path(t.spark, "orders-csv")
    write_csv(t.orders.select(F.lpad(F.col("o_orderkey").cast("string"), 11, "0").alias("geoid"),
                              F.col("o_totalprice").alias("total_population"),
                              F.when(F.col("o_orderstatus") != "P", F.concat("o_orderstatus", F.lit(' says "x;y", \\'))).alias("status")),
              path, sep=";")
    return read_keyed_csv(t.spark, path, "geoid string, total_population double, status string", sep=";")


@check("table_round_trip", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def table_round_trip(t: Tables):
    path = scratch_path(t.spark, "customers")
    write_table(t.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), path, ["c_mktsegment"])
    return read_table(t.spark, path, columns=["c_custkey"])


@check("sample_export", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 100")
def sample(t: Tables):
    return sample_rows(t.orders, ["o_orderkey"], 100)


@check("hash_sample", "SELECT * FROM orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 5")
def hashed(t: Tables):
    return hash_sample(t.orders, ["o_orderkey"])


@check("polygons_file", f"""
SELECT {title_sql("n_name")} AS neighborhood, CAST(4 AS BIGINT) AS edges, CAST(n_nationkey * 3 AS DOUBLE) AS low_x FROM nation
""")
def polygons(t: Tables):
    """District outlines as one GeoJSON collection, boxes at a place of their own."""
    path = scratch_path(t.spark, "polygons")
    x = F.col("n_nationkey") * 3.0
    ring = F.array(*[F.array(x + dx, F.lit(dy)) for dx, dy in ((0., 0.), (2., 0.), (2., 1.), (0., 1.), (0., 0.))])
    feature = F.struct(F.struct(F.col("n_name").alias("nhood")).alias("properties"), F.struct(
        F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    # A collection is one document; the nation table has as many rows as there are districts.
    t.nation.agg(F.to_json(F.struct(F.collect_list(feature).alias("features"))).alias("value")).write.text(path)
    found = read_polygons(t.spark, path).select("neighborhood", F.explode(F.array(polygon_edges(F.col("geometry")))).alias("e"))
    return found.select("neighborhood", F.size("e").cast("long").alias("edges"),
                        F.array_min(F.transform("e", lambda v: v["x1"])).alias("low_x"))


@check("census_files", """
SELECT '06' || '075' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS geoid, CAST(c_nationkey AS DOUBLE) AS total_population,
       CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS DOUBLE) END AS median_household_income FROM customer
""")
def census_files(t: Tables):
    """Two landed files with different tracts and codes, merged on the tract."""
    path = scratch_path(t.spark, "census-files")
    key = F.lpad(F.col("c_custkey").cast("string"), 6, "0")

    def write(rows, code: str, value, name: str) -> str:
        head = F.array(*[F.lit(x) for x in ("NAME", code, "state", "county", "tract")])
        row = F.array(F.lit("Tract"), value.cast("string"), F.lit("06"), F.lit("075"), key)
        # One JSON array with the header first per line, of the tracts of a bounded range of keys.
        table = rows.groupBy(F.floor(F.col("c_custkey") / ARRAY_KEYS)).agg(F.concat(F.array(F.first(head)), F.collect_list(row)).alias("table"))
        table.select(F.to_json("table").alias("value")).write.text(f"{path}/{name}")
        return f"{path}/{name}"

    files = [write(t.customer, "B01003_001E", F.col("c_nationkey"), "population"),
             write(t.customer.where("c_custkey % 2 = 0"), "B19013_001E", F.col("c_custkey"), "income")]
    return read_census(t.spark, files, lines=True).select("geoid", "total_population", "median_household_income")


@check("source_lookup", """
SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_custkey AS DOUBLE) END AS ems_units FROM orders
""")
def source_lookup(t: Tables):
    """A folder without the parquet table: the CSV table in it is found, in all its parts, and typed."""
    path = scratch_path(t.spark, "lookup")
    write_csv(t.orders.select(F.col("o_orderkey").cast("string").alias("id"), F.when(
        F.col("o_orderstatus") == "P", "N/A").otherwise(F.col("o_custkey").cast("string")).alias("ems_units")), path)
    return find_source(t.spark, path)


@check("statistics_file", """
SELECT 'orders' AS section, o_orderpriority AS item, 'n' AS metric, CAST(count(*) AS VARCHAR) AS value FROM orders GROUP BY 2
UNION ALL SELECT 'orders', o_orderpriority, 'say "top", x', CAST(max(o_custkey) AS VARCHAR) FROM orders GROUP BY 2
""")
def statistics_file(t: Tables):
    """The long statistics table written and read back."""
    path = scratch_path(t.spark, "statistics")
    sums = t.orders.groupBy(F.col("o_orderpriority").alias("item")).agg(
        F.count("*").cast("string").alias("n"), F.max("o_custkey").cast("string").alias('say "top", x'))
    write_statistics(sums.withColumn("section", F.lit("orders")).unpivot(
        ["section", "item"], ["n", 'say "top", x'], "metric", "value"), path)
    return read_keyed_csv(t.spark, path, "section string, item string, metric string, value string")
