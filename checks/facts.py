"""Facts: calendar columns, elapsed times, names, lenient casts, snapshots, attachments."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import Tables, check, r_sql, ratio_sql, title_sql
from emberfield.functions import numeric as N
from emberfield.functions import text as X
from emberfield.functions import time as M
from emberfield.operators.nearest import (
    attach_snapshot, outer_merge, snapshot_mapping, stack_snapshots, with_nearest_snapshot)
from emberfield.operators.rollup import weighted_rollup
from emberfield.plans.incidents import prepare_incidents
from emberfield.session import materialize

YEARS = [1996, 1998, 2001]
DAY = 24 * 60

FLAGS_SQL = """CAST(hour({ts}) AS INTEGER) AS hour, CAST(isodow({ts}) - 1 AS INTEGER) AS weekday,
       CAST(isodow({ts}) >= 6 AS INTEGER) AS is_weekend,
       CAST(hour({ts}) >= 22 OR hour({ts}) <= 5 AS INTEGER) AS is_night"""


@check("prepared_facts", f"""
SELECT l_orderkey, l_linenumber, l_partkey,
       (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 1e6 / 60 AS response_time_min,
       CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
       {FLAGS_SQL.format(ts='o_orderdate')},
       {title_sql('o_orderpriority')} AS neighborhood
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 1e6 / 60 BETWEEN 0 AND {60 * DAY}
""")
def prepared_facts(t: Tables):
    facts = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return prepare_incidents(facts, "o_orderdate", "l_shipdate", "o_orderdate", "o_orderpriority",
                             bounds=(0, 60 * DAY)).select(
        "l_orderkey", "l_linenumber", "l_partkey", "response_time_min", "year", "month", "hour",
        "weekday", "is_weekend", "is_night", "neighborhood")


@check("event_calendar", f"""
SELECT event_id, {FLAGS_SQL.format(ts='ts')}, strftime(ts, '%b') AS month_name,
       strftime(ts, '%a') AS weekday_name
FROM events
""")
def event_calendar(t: Tables):
    hour, weekday = F.hour("ts"), F.weekday("ts")
    return t.events.select(
        "event_id", hour.alias("hour"), weekday.alias("weekday"),
        M.is_weekend(weekday).alias("is_weekend"), M.is_night(hour).alias("is_night"),
        M.month_name(F.col("ts")).alias("month_name"), M.weekday_name(F.col("ts")).alias("weekday_name"))


def event_gaps(t: Tables):
    """Each event with the time of the next one."""
    following = t.events.select((F.col("event_id") - 1).alias("event_id"), F.col("ts").alias("next_ts"))
    return t.events.select("event_id", "event_type", "user_id", "ts").join(following, "event_id")


GAPS_SQL = """(SELECT a.event_id, a.event_type, a.user_id, a.ts, b.ts AS next_ts
 FROM events a JOIN events b ON b.event_id = a.event_id + 1)"""


@check("elapsed_minutes", f"""
SELECT event_id, (epoch_us(next_ts) - epoch_us(ts)) / 1e6 / 60 AS minutes,
       trunc((epoch_us(next_ts) - epoch_us(ts)) / 1e6) / 60.0 AS whole_minutes
FROM {GAPS_SQL}
""")
def elapsed(t: Tables):
    start, end = F.col("ts"), F.col("next_ts")
    return event_gaps(t).select("event_id", M.elapsed_minutes(start, end).alias("minutes"),
                                M.elapsed_whole_minutes(start, end).alias("whole_minutes"))


@check("name_normalise", f"""
SELECT p_partkey, {title_sql("'  ' || p_name || '/' || p_brand || ' ' || p_type || ' '")} AS name,
       CASE WHEN length(CAST(p_partkey AS VARCHAR)) < 11 THEN lpad(CAST(p_partkey AS VARCHAR), 11, '0')
            ELSE CAST(p_partkey AS VARCHAR) END AS padded,
       CASE WHEN length(CAST(p_partkey AS VARCHAR)) < 2 THEN lpad(CAST(p_partkey AS VARCHAR), 2, '0')
            ELSE CAST(p_partkey AS VARCHAR) END AS padded_short,
       CAST(p_size AS VARCHAR) || nullif(p_brand, 'Brand#1') || p_type AS key,
       substring(p_name, 1, 6) AS label
FROM part
""")
def name_normalise(t: Tables):
    raw = F.concat(F.lit("  "), "p_name", F.lit("/"), "p_brand", F.lit(" "), "p_type", F.lit(" "))
    return t.part.select(
        "p_partkey", X.title_case(raw).alias("name"),
        X.zero_pad(F.col("p_partkey"), 11).alias("padded"),
        X.zero_pad(F.col("p_partkey"), 2).alias("padded_short"),
        X.composite_key(F.col("p_size"), F.nullif("p_brand", F.lit("Brand#1")), F.col("p_type")).alias("key"),
        X.short_label(F.col("p_name"), 6).alias("label"))


@check("lenient_cast", """
WITH raw AS (
  SELECT c_custkey, c_acctbal, 1700 + c_nationkey * 20 AS built,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'n/a' WHEN 'FURNITURE' THEN NULL
                           ELSE CAST(c_custkey AS VARCHAR) || '.5' END AS txt,
         CASE c_mktsegment WHEN 'MACHINERY' THEN NULL ELSE '  ' || c_mktsegment || ' ' END AS segment
  FROM customer)
SELECT c_custkey, TRY_CAST(txt AS DOUBLE) AS number, coalesce(TRY_CAST(txt AS DOUBLE), 0.0) AS number_or_zero,
       CASE WHEN c_acctbal >= -500 THEN c_acctbal END AS without_sentinel,
       CAST(CASE WHEN built BETWEEN 1800 AND 2025 THEN built END AS DOUBLE) AS built,
       coalesce(trim(segment), '') AS segment,
       CAST(trunc(c_acctbal) AS BIGINT) AS truncated, CAST(round_even(c_acctbal, 0) AS BIGINT) AS whole
FROM raw
""")
def lenient_cast(t: Tables):
    txt = (F.when(F.col("c_mktsegment") == "BUILDING", "n/a")
           .when(F.col("c_mktsegment") != "FURNITURE", F.concat(F.col("c_custkey").cast("string"), F.lit(".5"))))
    segment = F.when(F.col("c_mktsegment") != "MACHINERY",
                     F.concat(F.lit("  "), "c_mktsegment", F.lit(" ")))
    return t.customer.select(
        "c_custkey", N.to_number(txt).alias("number"), N.to_number_or_zero(txt).alias("number_or_zero"),
        N.sentinel_to_null(F.col("c_acctbal"), -500).alias("without_sentinel"),
        N.within_range(1700 + F.col("c_nationkey") * 20.0, 1800, 2025).alias("built"),
        X.clean_text(segment).alias("segment"),
        N.truncate(F.col("c_acctbal")).alias("truncated"), N.to_whole(F.col("c_acctbal")).alias("whole"))


@check("timestamp_parse", """
WITH raw AS (
  SELECT event_id, event_type, CASE event_type
           WHEN 'error' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
           WHEN 'view' THEN 'on ' || strftime(ts, '%Y-%m-%d')
           ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') END AS txt
  FROM events)
SELECT event_id, txt, CASE WHEN event_type IN ('error', 'view') THEN NULL
                           ELSE strptime(txt, '%Y-%m-%dT%H:%M:%S.%g') END AS strict,
       CASE WHEN event_type = 'view' THEN NULL ELSE CAST(txt AS TIMESTAMP) END AS lenient
FROM raw
""")
def timestamp_parse(t: Tables):
    kind = F.col("event_type")
    txt = (F.when(kind == "error", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
           .when(kind == "view", F.concat(F.lit("on "), F.date_format("ts", "yyyy-MM-dd")))
           .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS")))
    return t.events.select("event_id", txt.alias("txt")).select(
        "event_id", "txt", M.parse_iso_millis(F.col("txt")).alias("strict"),
        M.parse_time(F.col("txt")).alias("lenient"))


@check("code_bins", """
WITH coded AS (SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN p_name
                 ELSE CAST(44 + p_size * 17 AS VARCHAR) || ' - ' || p_name END AS situation FROM part),
 c AS (SELECT *, TRY_CAST(regexp_extract(situation, '^(\\d{3})', 1) AS DOUBLE) AS code FROM coded)
SELECT p_partkey, code, CASE WHEN code < 100 THEN NULL WHEN code < 200 THEN 'Feuer'
         WHEN code < 300 THEN 'Ueberhitzung' WHEN code < 400 THEN 'Rettung_EMS'
         WHEN code < 500 THEN 'Gefahrstoffe' WHEN code < 600 THEN 'Service'
         WHEN code < 700 THEN 'Suche_Sonstiges' WHEN code < 800 THEN 'Fehlalarm' END AS category,
       CASE WHEN code >= 100 AND code < 800 THEN floor(code / 100) END AS category_rank
FROM c
""")
def code_bins(t: Tables):
    situation = F.when(F.col("p_type") == "PROMO", F.col("p_name")).otherwise(
        F.concat((44 + F.col("p_size") * 17).cast("string"), F.lit(" - "), "p_name"))
    coded = t.part.select("p_partkey", X.leading_code(situation).alias("code"))
    return coded.withColumns({"category": N.code_bin(F.col("code")),
                              "category_rank": N.code_bin_rank(F.col("code")).cast("double")})


@check("flag_recode", """
WITH c AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'NA' WHEN 'click' THEN 'no'
             WHEN 'view' THEN ' Y' WHEN 'signup' THEN '3' ELSE 'YES' END AS flag FROM events)
SELECT event_id, CAST(CASE WHEN upper(trim(flag)) IN ('Y', 'YES') THEN 1
                           WHEN upper(trim(flag)) IN ('N', 'NO') THEN 0 END AS DOUBLE) AS recoded
FROM c
""")
def flag_recode(t: Tables):
    e = F.col("event_type")
    flag = (F.when(e == "error", "NA").when(e == "click", "no").when(e == "view", " Y")
            .when(e == "signup", "3").otherwise("YES"))
    return t.events.select("event_id", N.flame_spread_recode(flag).cast("double").alias("recoded"))


def customer_regions(t: Tables):
    return (t.customer
            .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(t.region, F.col("n_regionkey") == F.col("r_regionkey")))


REGIONS_SQL = """customer JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey"""


def snapshot_rollup(t: Tables):
    """Customers as tracts of their region, once per snapshot year; segments as missing values."""
    base = customer_regions(t).select("r_name", "c_acctbal", "c_mktsegment", "c_nationkey")
    years = {}
    for y in YEARS:
        grown = base.select(
            "r_name", (F.col("c_nationkey") + (y - 1995)).cast("double").alias("population"),
            F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal") * (y - 1990)).alias("income"),
            F.when(F.col("c_acctbal") < 0, F.col("c_nationkey") + 1.0).alias("below"),
            (F.col("c_nationkey") + 2.0).alias("universe"))
        # The last snapshot lacks one measure.
        years[y] = grown.drop("below") if y == 2001 else grown
    return weighted_rollup(stack_snapshots(years), ["r_name", "snapshot_year"], "population",
                           ["income"], ["below", "universe"])


ROLLUP_SQL = f"""(SELECT r_name, y AS snapshot_year,
   CAST(sum(c_nationkey + (y - 1995)) AS BIGINT) AS population,
   CAST(round_even(coalesce(sum(CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal * (y - 1990)
        * (c_nationkey + (y - 1995)) END), 0) / sum(c_nationkey + (y - 1995)), 0) AS BIGINT) AS income,
   coalesce(sum(CASE WHEN c_acctbal < 0 AND y <> 2001 THEN c_nationkey + 1.0 END), 0.0)::DOUBLE AS below,
   sum(c_nationkey + 2.0)::DOUBLE AS universe
 FROM {REGIONS_SQL}, (SELECT unnest([1996, 1998, 2001]) AS y) GROUP BY 1, 2)"""


@check("snapshot_rollup", f"SELECT * FROM {ROLLUP_SQL}")
def snapshot_rollup_query(t: Tables):
    return snapshot_rollup(t)



@check("enriched_facts", f"""
WITH facts AS (
  SELECT o_orderkey, r_name, CAST(year(o_orderdate) AS INTEGER) AS year,
         CAST(CASE WHEN year(o_orderdate) <= 1997 THEN 1996 WHEN year(o_orderdate) <= 1999 THEN 1998
              ELSE 2001 END AS INTEGER) AS snapshot_year
  FROM orders JOIN {REGIONS_SQL} ON o_custkey = c_custkey)
SELECT f.o_orderkey, f.r_name, f.year, f.snapshot_year, s.population, s.income,
       {ratio_sql('s.below', 's.universe')} AS below_rate
FROM facts f LEFT JOIN {ROLLUP_SQL} s ON f.r_name = s.r_name AND f.snapshot_year = s.snapshot_year
""")
def enriched_facts(t: Tables):
    """Each order with the measures of its region at the snapshot nearest to its year."""
    places = customer_regions(t).select(F.col("c_custkey").alias("o_custkey"), "r_name")
    facts = (t.orders.select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
             .join(places, "o_custkey"))
    table = materialize(snapshot_rollup(t), "snapshots")
    joined = attach_snapshot(facts, table, YEARS, ["r_name"])
    return joined.select("o_orderkey", "r_name", "year", "snapshot_year", "population", "income",
                         N.safe_ratio(F.col("below"), F.col("universe")).alias("below_rate"))


@check("snapshot_mapping", """
WITH m AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS year, y,
         row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(y - year(o_orderdate)), y) AS rn
  FROM orders, (SELECT unnest([1996, 1998, 2001]) AS y))
SELECT CAST(y AS INTEGER) AS snapshot_year, min(year) AS min_year, max(year) AS max_year, count(*) AS rows
FROM m WHERE rn = 1 GROUP BY y
""")
def mapping(t: Tables):
    return snapshot_mapping(with_nearest_snapshot(t.orders.select(F.year("o_orderdate").alias("year")), YEARS))


@check("outer_merge_groups", """
WITH a AS (SELECT c_nationkey AS nationkey, count(*) AS rich FROM customer WHERE c_acctbal > 9500 GROUP BY 1),
 b AS (SELECT s_nationkey AS nationkey, count(*) AS suppliers FROM supplier WHERE s_acctbal < 3000 GROUP BY 1),
 c AS (SELECT n_nationkey AS nationkey, n_name AS name FROM nation WHERE n_regionkey <> 2)
SELECT nationkey, rich::DOUBLE AS rich, suppliers::DOUBLE AS suppliers, name FROM a FULL JOIN b USING (nationkey) FULL JOIN c USING (nationkey)
""")
def outer_merge_groups(t: Tables):
    rich = (t.customer.where("c_acctbal > 9500").groupBy(F.col("c_nationkey").alias("nationkey"))
            .agg(F.count(F.lit(1)).alias("rich")))
    poor = (t.supplier.where("s_acctbal < 3000").groupBy(F.col("s_nationkey").alias("nationkey"))
            .agg(F.count(F.lit(1)).alias("suppliers")))
    names = t.nation.where("n_regionkey <> 2").select(
        F.col("n_nationkey").alias("nationkey"), F.col("n_name").alias("name"))
    merged = outer_merge([rich, poor, names], ["nationkey"])
    return merged.withColumns({c: F.col(c).cast("double") for c in ("rich", "suppliers")})


@check("static_attach", f"""
WITH dim AS (SELECT s_nationkey, count(*) AS suppliers, {r_sql('sum(s_acctbal)', 2)} AS balance
             FROM supplier WHERE s_nationkey <> 3 GROUP BY 1)
SELECT o_orderkey, c_nationkey, suppliers::DOUBLE AS suppliers, balance
FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN dim ON s_nationkey = c_nationkey
""")
def static_attach(t: Tables):
    dim = materialize(
        t.supplier.where("s_nationkey <> 3").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(
            F.count(F.lit(1)).alias("suppliers"),
            N.round_even(F.sum("s_acctbal"), 2).alias("balance")), "supplier-balance")
    places = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    facts = t.orders.select("o_orderkey", "o_custkey").join(places, "o_custkey")
    return facts.join(dim, "c_nationkey", "left").select(
        "o_orderkey", "c_nationkey", F.col("suppliers").cast("double").alias("suppliers"), "balance")
