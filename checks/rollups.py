"""Roll-ups to groups, rates and totals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.facts import REGIONS_SQL, customer_regions
from checks.registry import Tables, check, r_sql, ratio_sql, round_columns
from emberfield.functions.numeric import safe_ratio
from emberfield.operators.frequency import top_rows
from emberfield.operators.rollup import (
    crime_rollup, grand_totals, group_rates, parcel_rollup, unify_crime_schema, weighted_rollup)
from emberfield.plans.incidents import add_rates


@check("weighted_rollup", f"""
WITH o AS (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1),
 c AS (SELECT r_name, CASE WHEN c_mktsegment <> 'MACHINERY' THEN orders END AS w,
              nullif(c_acctbal, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal END) AS v,
              CASE WHEN r_name <> 'ASIA' THEN c_acctbal END AS s
       FROM {REGIONS_SQL} LEFT JOIN o ON o_custkey = c_custkey)
SELECT r_name, CAST(coalesce(sum(w), 0) AS BIGINT) AS orders,
       CAST(round_even(coalesce(sum(v * w), 0) / sum(w), 0) AS BIGINT) AS balance,
       round_even(coalesce(sum(s), 0), 0) AS total_balance
FROM c GROUP BY 1
""")
def weighted(t: Tables):
    counts = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"))
    segment = F.col("c_mktsegment")
    rows = customer_regions(t).join(counts, "c_custkey", "left").select(
        "r_name", F.when(segment != "MACHINERY", F.col("orders")).alias("orders"),
        F.when(segment != "BUILDING", F.col("c_acctbal")).alias("balance"),
        F.when(F.col("r_name") != "ASIA", F.col("c_acctbal")).alias("total_balance"))
    return weighted_rollup(rows, ["r_name"], "orders", ["balance"], ["total_balance"])


@check("weighted_rollup_strict", f"""
WITH c AS (SELECT n_name, c_acctbal, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END AS v,
                  CASE WHEN c_acctbal > 0 THEN 2.0 ELSE 1.0 END AS w
           FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT n_name, CAST(trunc(sum(w)) AS BIGINT) AS weight,
       CAST(round_even(sum(v * w) / sum(CASE WHEN v IS NOT NULL THEN w END), 0) AS BIGINT) AS balance
FROM c GROUP BY 1
""")
def weighted_strict(t: Tables):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "n_name", F.when(F.col("c_acctbal") > 0, 2.0).otherwise(1.0).alias("weight"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal")).alias("balance"))
    return weighted_rollup(rows, ["n_name"], "weight", ["balance"], [], strict_weights=True)


def monthly_counts(t: Tables):
    """Events as offence counts: types stand for categories, users for districts."""
    kind = F.col("event_type")
    return t.events.select(
        F.concat(F.lit(" district/"), F.col("user_id").cast("string"), F.lit(" ")).alias("analysis_neighborhood"),
        F.when(kind == "error", " Assault ").when(kind == "click", "Burglary")
        .when(kind == "purchase", "Larceny").when(kind == "signup", " ").alias("incident_category"),
        F.when(F.col("value") < 200, F.rint("value").cast("int").cast("string")).otherwise("many").alias("count"))


CRIME_SQL = """(SELECT 'District/' || user_id AS neighborhood, event_type,
   CASE event_type WHEN 'error' THEN 'Assault' WHEN 'click' THEN 'Burglary' WHEN 'purchase' THEN 'Larceny' END AS category,
   CASE WHEN value < 200 THEN round_even(value, 0) ELSE 0.0 END AS cnt
 FROM events WHERE event_type IN ('error', 'click', 'purchase'))"""
CRIME_ROLLUP_SQL = f"""(SELECT neighborhood, CAST(sum(cnt) AS BIGINT) AS total_crimes,
   CAST(sum(CASE WHEN category = 'Assault' THEN cnt ELSE 0 END) AS BIGINT) AS violent_crime_count,
   CAST(sum(CASE WHEN category = 'Burglary' THEN cnt ELSE 0 END) AS BIGINT) AS property_crime_count
 FROM {CRIME_SQL} GROUP BY 1)"""


@check("category_rollup", f"SELECT * FROM {CRIME_ROLLUP_SQL}")
def category_rollup(t: Tables):
    return crime_rollup(monthly_counts(t))


@check("category_totals", f"""
SELECT count(*) AS groups, CAST(sum(total_crimes) AS BIGINT) AS total_crimes,
       CAST(sum(violent_crime_count) AS BIGINT) AS violent_crime_count,
       {r_sql('sum(violent_crime_count) / sum(total_crimes) * 100', 6)} AS share_pct
FROM {CRIME_ROLLUP_SQL}
""")
def category_totals(t: Tables):
    totals = grand_totals(crime_rollup(monthly_counts(t)), ["total_crimes", "violent_crime_count"],
                          share=("violent_crime_count", "total_crimes"))
    return round_columns(totals, ["share_pct"], 6)


@check("schema_variants", f"""
WITH a AS (SELECT neighborhood, category, cnt, CAST(category = 'Assault' AS INTEGER) AS is_violent,
                  CAST(category = 'Burglary' AS INTEGER) AS is_property FROM {CRIME_SQL}),
 b AS (SELECT 'User ' || user_id AS neighborhood, event_type AS category, round_even(value, 0) AS cnt,
              CAST(event_type = 'view' AS INTEGER) AS is_violent, 0 AS is_property FROM events)
SELECT category, is_violent, is_property, count(*) AS rows, count(DISTINCT neighborhood) AS districts,
       sum(cnt) AS total
FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2, 3
""")
def schema_variants(t: Tables):
    prepared = t.events.select(
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("neighborhood"),
        F.col("event_type").alias("incident_category"), F.rint("value").alias("count"),
        (F.col("event_type") == "view").cast("int").alias("is_violent"), F.lit(0).alias("is_property"))
    both = unify_crime_schema(monthly_counts(t)).unionByName(unify_crime_schema(prepared))
    return both.groupBy(F.col("incident_category").alias("category"), "is_violent", "is_property").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("neighborhood").alias("districts"),
        F.sum("count").alias("total"))


def parts_as_parcels(t: Tables):
    kind = F.col("p_type")
    return t.part.select(
        F.col("p_brand").alias("neighborhood"), F.col("p_partkey").cast("string").alias("blklot"),
        F.when(kind != "PROMO", 1880 + F.col("p_size") * 3).cast("double").alias("yrbuilt"),
        F.when(kind == "ECONOMY", "RESIDENT").when(kind == "SMALL", "MIXRES")
        .when(kind == "LARGE", "RETAIL/ENT").when(kind == "MEDIUM", "PDR").alias("landuse"),
        F.when(kind != "STANDARD", F.col("p_size")).cast("double").alias("resunits"),
        F.when(F.col("p_size") != 50, F.col("p_retailprice")).alias("st_area_sh"))


PARCEL_SQL = """(SELECT p_brand AS neighborhood, count(p_partkey) AS parcel_count,
  count(CASE WHEN p_type <> 'PROMO' THEN 1 END) AS yrbuilt_count,
  count(CASE WHEN p_type <> 'PROMO' AND 1880 + p_size * 3 < 1940 THEN 1 END) AS pre1940_count,
  count(CASE WHEN p_type <> 'PROMO' AND 1880 + p_size * 3 < 1960 THEN 1 END) AS pre1960_count,
  coalesce(sum(CASE WHEN p_type <> 'STANDARD' THEN p_size END), 0)::DOUBLE AS total_resunits,
  count(CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 1 END) AS residential_count,
  coalesce(sum(CASE WHEN p_size <> 50 THEN p_retailprice END), 0.0) AS total_area,
  coalesce(sum(CASE WHEN p_size <> 50 AND p_type IN ('LARGE', 'MEDIUM') THEN p_retailprice END), 0.0) AS risk_area
FROM part GROUP BY 1)"""


@check("parcel_rollup", f"""
SELECT * EXCLUDE (total_area, risk_area), {r_sql('total_area')} AS total_area_sqft,
       {r_sql('risk_area')} AS high_risk_commercial_area_sqft FROM {PARCEL_SQL}
""")
def parcels(t: Tables):
    return round_columns(parcel_rollup(parts_as_parcels(t)),
                         ["total_area_sqft", "high_risk_commercial_area_sqft"])


@check("safe_ratios", f"""
SELECT neighborhood, {ratio_sql('pre1940_count', 'yrbuilt_count')} AS pct_pre1940,
       {ratio_sql('pre1960_count', 'yrbuilt_count')} AS pct_pre1960,
       {ratio_sql('residential_count', 'parcel_count')} AS pct_residential,
       {ratio_sql('risk_area', 'total_area')} AS pct_high_risk_commercial_area,
       {ratio_sql('pre1940_count', '(residential_count - 28)')} AS guarded
FROM {PARCEL_SQL}
""")
def ratios(t: Tables):
    rolled = add_rates(parcel_rollup(parts_as_parcels(t)))
    return rolled.select(
        "neighborhood", "pct_pre1940", "pct_pre1960", "pct_residential", "pct_high_risk_commercial_area",
        safe_ratio(F.col("pre1940_count"), F.col("residential_count") - 28).alias("guarded"))


def order_nations(t: Tables):
    places = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("o_custkey"), "n_name", "c_acctbal")
    return t.orders.join(places, "o_custkey").withColumn(
        "price", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")))


RATES_SQL = """(SELECT n_name, count(o_orderkey) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS hits,
   arg_min(o_totalprice, o_orderdate::VARCHAR || '#' || lpad(o_orderkey::VARCHAR, 12, '0'))
     FILTER (WHERE o_orderstatus <> 'P') AS price,
   round_even(count(*) FILTER (WHERE o_orderstatus = 'F') / count(o_orderkey) * 100 * 1000, 0) / 1000 AS rate_pct
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)"""


@check("group_rates", f"SELECT * FROM {RATES_SQL} WHERE total >= (SELECT avg(total) FROM {RATES_SQL})")
def rates(t: Tables):
    rated = group_rates(order_nations(t), "n_name", "o_orderkey", F.col("o_orderstatus") == "F",
                        ["price"], ["o_orderdate", "o_orderkey"])
    mean = F.avg("total").over(Window.partitionBy())  # over the few groups of the result
    return rated.withColumn("mean", mean).where("total >= mean").drop("mean")


@check("top_rates", f"SELECT n_name, rate_pct, price FROM {RATES_SQL} ORDER BY rate_pct DESC, n_name LIMIT 5")
def top_rates(t: Tables):
    rated = group_rates(order_nations(t), "n_name", "o_orderkey", F.col("o_orderstatus") == "F",
                        ["price"], ["o_orderdate", "o_orderkey"])
    return top_rows(rated, "rate_pct", 5, ["n_name", "rate_pct", "price"], ["n_name"])
