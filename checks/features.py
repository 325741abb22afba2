"""The whole feature table from driver tables: every roll-up, both attachments, all rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import Tables, check, r_sql, ratio_sql, round_columns
from checks.shapes import LOCATED_SQL, nation_boxes, part_parcels
from emberfield import constants as K
from emberfield.functions.text import title_case, zero_pad
from emberfield.plans.incidents import base_table, feature_table

YEARS = [1996, 1998, 2001]


def nation_customers(t: Tables):
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))


def order_incidents(t: Tables):
    """Orders as incidents in the nation of their customer; the price sets the response time."""
    places = nation_customers(t).select(F.col("c_custkey").alias("o_custkey"), "n_name")
    seconds = F.floor(F.col("o_totalprice") / 100)
    return t.orders.join(places, "o_custkey").select(
        F.col("o_orderkey").cast("string").alias("incident_number"),
        F.col("o_orderdate").alias("incident_date"), F.col("o_orderdate").alias("alarm_dttm"),
        (F.col("o_orderdate") + F.make_dt_interval(secs=seconds)).alias("arrival_dttm"),
        F.concat(F.lit(" "), F.lower("n_name")).alias("neighborhood_district"))


def customer_tracts(t: Tables):
    """Each customer as a tract in three snapshots; education is missing in the first."""
    n, y = F.col("c_nationkey"), F.col("snapshot_year")
    rows = t.customer.withColumn("snapshot_year", F.explode(F.array(*[F.lit(v) for v in YEARS])))
    late = y > 1996
    return rows.select(
        zero_pad(F.col("c_custkey"), 11).alias("geoid"), "snapshot_year",
        (n + y - 1990).cast("double").alias("total_population"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal") + y).alias("median_household_income"),
        F.col("c_acctbal").alias("median_gross_rent"),
        F.when(F.col("c_acctbal") < 1000, n + 1.0).alias("poverty_below"), (n + 3.0).alias("poverty_universe_total"),
        F.when(late, n * 1.0).alias("bachelor_degree_count"), F.when(late, n * 2.0).alias("education_universe_total"),
        F.lit(1.0).alias("vacant_housing_units"), (y - 1980).cast("double").alias("total_housing_units"))


def nation_crosswalk(t: Tables):
    return nation_customers(t).select(zero_pad(F.col("c_custkey"), 11).alias("geoid"),
                                      title_case(F.col("n_name")).alias("neighborhood"))


def user_crime(t: Tables):
    """Events as monthly counts in the nation of the customer with the user's number."""
    places = nation_customers(t).select(F.col("c_custkey").alias("user_id"), "n_name")
    kind = F.col("event_type")
    return t.events.join(places, "user_id").select(
        F.col("n_name").alias("analysis_neighborhood"), F.rint("value").cast("string").alias("count"),
        F.when(kind == "error", "Robbery").when(kind == "click", "Theft").when(kind == "view", "Fraud")
        .alias("incident_category"))


def _title(column: str) -> str:
    return f"'Nation_' || substring({column}, 8)"


FEATURES_SQL = f"""
WITH facts AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS incident_number, {_title('n_name')} AS neighborhood,
         floor(o_totalprice / 100) / 60 AS response_time_min,
         CASE WHEN year(o_orderdate) <= 1997 THEN 1996 WHEN year(o_orderdate) <= 1999 THEN 1998 ELSE 2001 END AS y
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE floor(o_totalprice / 100) / 60 <= 60),
 tract AS (SELECT {_title('n_name')} AS neighborhood, y, c_nationkey AS n, c_acctbal AS b, c_nationkey + y - 1990 AS pop,
    CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal + y END AS income
  FROM customer JOIN nation ON c_nationkey = n_nationkey, (SELECT unnest([1996, 1998, 2001]) AS y)),
 census AS (SELECT neighborhood, y, sum(pop) AS total_population,
    round_even(coalesce(sum(income * pop), 0) / sum(pop), 0) AS median_household_income,
    round_even(sum(b * pop) / sum(pop), 0) AS median_gross_rent,
    coalesce(sum(CASE WHEN b < 1000 THEN n + 1 END), 0) AS poverty_below, sum(n + 3) AS poverty_universe_total,
    coalesce(sum(CASE WHEN y > 1996 THEN n END), 0) AS bachelor_degree_count,
    coalesce(sum(CASE WHEN y > 1996 THEN n * 2 END), 0) AS education_universe_total,
    count(*) AS vacant_housing_units, sum(y - 1980) AS total_housing_units FROM tract GROUP BY 1, 2),
 crime AS (SELECT {_title('n_name')} AS neighborhood, sum(round_even(value, 0)) AS total_crimes,
    sum(CASE WHEN event_type = 'error' THEN round_even(value, 0) ELSE 0 END) AS violent_crime_count,
    sum(CASE WHEN event_type = 'click' THEN round_even(value, 0) ELSE 0 END) AS property_crime_count
  FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE event_type IN ('error', 'click', 'view') GROUP BY 1),
 land AS (SELECT {_title('n_name')} AS neighborhood, count(*) AS parcel_count, count(*) FILTER (WHERE p_size > 5) AS yrbuilt_count,
    count(*) FILTER (WHERE p_size > 5 AND 1900 + p_size * 2 < 1940) AS pre1940_count,
    count(*) FILTER (WHERE p_size > 5 AND 1900 + p_size * 2 < 1960) AS pre1960_count,
    sum(p_size) AS total_resunits, count(*) FILTER (WHERE p_type <> 'LARGE') AS residential_count,
    sum(p_retailprice) AS total_area_sqft,
    coalesce(sum(CASE WHEN p_type = 'LARGE' THEN p_retailprice END), 0.0) AS high_risk_commercial_area_sqft
  FROM {LOCATED_SQL} WHERE n_name IS NOT NULL GROUP BY 1)
SELECT f.incident_number, f.neighborhood, f.response_time_min, CAST(f.y AS INTEGER) AS acs_year,
  {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in K.CENSUS_COLUMNS)},
  {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in (
      'total_crimes', 'violent_crime_count', 'property_crime_count', 'parcel_count', 'yrbuilt_count',
      'pre1940_count', 'pre1960_count', 'total_resunits', 'residential_count'))},
  {', '.join(f'{r_sql(c)} AS {c}' for c in ('total_area_sqft', 'high_risk_commercial_area_sqft'))},
  {', '.join(f'{ratio_sql(num, den)} AS {name}' for name, (num, den) in K.RATES.items())}
FROM facts f LEFT JOIN census s ON f.neighborhood = s.neighborhood AND f.y = s.y
  LEFT JOIN crime c ON f.neighborhood = c.neighborhood LEFT JOIN land l ON f.neighborhood = l.neighborhood
"""


@check("feature_table", FEATURES_SQL)
def features(t: Tables):
    polygons = nation_boxes(t).withColumn("neighborhood", title_case(F.col("neighborhood")))
    table = feature_table(base_table(
        order_incidents(t), customer_tracts(t), nation_crosswalk(t), user_crime(t), part_parcels(t), polygons, YEARS))
    numbers = [*K.CENSUS_COLUMNS, "total_crimes", "violent_crime_count", "property_crime_count", "parcel_count",
               "yrbuilt_count", "pre1940_count", "pre1960_count", "total_resunits", "residential_count"]
    areas = ["total_area_sqft", "high_risk_commercial_area_sqft"]
    picked = table.select("incident_number", "neighborhood", "response_time_min", "acs_year",
                          *[F.col(c).cast("double").alias(c) for c in numbers], *areas, *K.RATES)
    return round_columns(picked, areas)
