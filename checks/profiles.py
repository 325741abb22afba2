"""Profiles: nulls, distributions, quantiles, coverage, inventories."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.facts import GAPS_SQL, event_gaps
from checks.registry import Tables, check, nearest_sql, r_sql, round_columns
from emberfield.functions.time import elapsed_whole_minutes
from emberfield.operators.frequency import distinct_count, top_values, top_values_by_column
from emberfield.operators.profile import (
    casualty_totals, column_summary, completeness, describe, duration_profile, missing_columns,
    null_profile, response_profile, table_inventory, temporal_coverage)
from emberfield.operators.quantiles import exact_quantiles
from emberfield.functions.text import short_label

ALL_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
              "pages benchmark labels conversations").split()


def gappy_orders(t: Tables):
    """Orders with values taken out, since the tables hold no nulls."""
    status, total = F.col("o_orderstatus"), F.col("o_totalprice")
    return t.orders.select(
        "o_orderkey", F.when(status != "P", status).alias("status"),
        F.when(total > 100000, total).alias("price"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority")).alias("urgent"),
        F.when(total > 10000, F.col("o_orderdate")).alias("day"),
        F.when(total > 400000, F.col("o_custkey")).alias("big_customer"))


GAPPY_SQL = """(SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status,
  CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS price,
  CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderpriority END AS urgent,
  CASE WHEN o_totalprice > 10000 THEN o_orderdate END AS day,
  CASE WHEN o_totalprice > 400000 THEN o_custkey END AS big_customer FROM orders)"""
GAPPY_COLUMNS = ["o_orderkey", "status", "price", "urgent", "day", "big_customer"]


def _nulls_sql() -> str:
    return " UNION ALL ".join(
        f'SELECT \'{c}\' AS "column", count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(*) AS rows '
        f"FROM {GAPPY_SQL}" for c in GAPPY_COLUMNS)


@check("null_profile", f"SELECT *, {r_sql('nulls / rows * 100')} AS null_pct FROM ({_nulls_sql()})")
def nulls(t: Tables):
    return round_columns(null_profile(gappy_orders(t)), ["null_pct"])


@check("missing_columns", f"SELECT * FROM (SELECT *, {r_sql('nulls / rows * 100')} AS null_pct "
                          f"FROM ({_nulls_sql()})) WHERE nulls > 0")
def missing(t: Tables):
    return round_columns(missing_columns(gappy_orders(t)), ["null_pct"])


@check("completeness", f"""
SELECT "column", nulls, rows, {r_sql('nulls / rows * 100')} AS null_pct,
       CASE WHEN nulls / rows > 0.5 THEN 'sparse' WHEN nulls / rows > 0.1 THEN 'partial' ELSE 'complete' END AS grade
FROM ({_nulls_sql()}) WHERE "column" <> 'o_orderkey'
""")
def grades(t: Tables):
    return round_columns(completeness(gappy_orders(t), skip=["o_orderkey"]), ["null_pct"])


NUMBERS = {"quantity": "l_quantity", "price": "CASE WHEN l_tax > 0.01 THEN l_extendedprice END",
           "discount": "l_discount", "nothing": "CAST(NULL AS DOUBLE)"}


def lineitem_numbers(t: Tables):
    return t.lineitem.select(
        F.col("l_quantity").alias("quantity"),
        F.when(F.col("l_tax") > 0.01, F.col("l_extendedprice")).alias("price"),
        F.col("l_discount").alias("discount"), F.lit(None).cast("double").alias("nothing"))


def _describe_sql() -> str:
    one = """SELECT '{c}' AS "column", count(v) AS count, count(*) - count(v) AS null_count,
      {mean} AS mean, {std} AS std, min(v) AS min, {q25} AS q25, {q50} AS q50, {q75} AS q75, max(v) AS max
      FROM (SELECT {e} AS v FROM lineitem)"""
    return " UNION ALL ".join(one.format(
        c=c, e=e, mean=r_sql("avg(v)"), std=r_sql("stddev_samp(v)"), q25=nearest_sql("v", 0.25),
        q50=nearest_sql("v", 0.5), q75=nearest_sql("v", 0.75)) for c, e in NUMBERS.items())


@check("describe", _describe_sql())
def described(t: Tables):
    return round_columns(describe(lineitem_numbers(t), list(NUMBERS)), ["mean", "std"])


def _summary_sql() -> str:
    one = """SELECT '{c}' AS "column", count(v) AS n, {mean} AS mean, {median} AS median, min(v) AS min,
      max(v) AS max, {pct} AS null_pct FROM (SELECT {e} AS v FROM lineitem)"""
    return " UNION ALL ".join(one.format(
        c=c, e=e, mean=r_sql("avg(v)"), median=r_sql("median(v)"),
        pct=r_sql("(count(*) - count(v)) / count(*) * 100")) for c, e in NUMBERS.items())


@check("column_summary", _summary_sql())
def summary(t: Tables):
    return round_columns(column_summary(lineitem_numbers(t), list(NUMBERS)),
                         ["mean", "median", "null_pct"])


@check("temporal_coverage", f"""
SELECT 'ordered' AS "column", min(day) AS first, max(day) AS last FROM {GAPPY_SQL}
UNION ALL SELECT 'placed', min(o_orderdate), max(o_orderdate) FROM orders
""")
def coverage(t: Tables):
    total = F.col("o_totalprice")
    times = t.orders.select(F.when(total > 10000, F.col("o_orderdate")).alias("ordered"),
                            F.col("o_orderdate").alias("placed"),
                            F.lit(None).cast("timestamp_ntz").alias("never"))
    return temporal_coverage(times, ["ordered", "placed", "never"])


@check("table_inventory", " UNION ALL ".join(
    f"SELECT '{n}' AS \"table\", count(*) AS rows, "
    f"(SELECT CAST(count(*) AS INTEGER) FROM (DESCRIBE SELECT * FROM {n})) AS columns FROM {n}"
    for n in ALL_TABLES))
def inventory(t: Tables):
    return table_inventory({n: getattr(t, n) for n in ALL_TABLES})


@check("distinct_counts", """
SELECT count(DISTINCT status) + max(CAST(status IS NULL AS INTEGER)) AS with_null,
       count(DISTINCT status) AS without_null, count(DISTINCT big_customer) AS customers,
       count(DISTINCT o_orderkey) + max(CAST(o_orderkey IS NULL AS INTEGER)) AS orders
FROM """ + GAPPY_SQL)
def distincts(t: Tables):
    return gappy_orders(t).agg(
        distinct_count("status", True).alias("with_null"), distinct_count("status", False).alias("without_null"),
        distinct_count("big_customer", False).alias("customers"),
        distinct_count("o_orderkey", True).alias("orders"))


def _topk_sql(source: str, columns: dict[str, str], k: int) -> str:
    long = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({e} AS VARCHAR) AS value FROM {source}" for c, e in columns.items())
    return f"""
WITH c AS (SELECT "column", value, count(*) AS n FROM ({long}) GROUP BY 1, 2),
 t AS (SELECT "column", count(*) AS n_unique, sum(n) AS rows FROM c GROUP BY 1),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS INTEGER) AS rank
       FROM c WHERE value IS NOT NULL)
SELECT r."column", rank, substring(value, 1, 52) AS label, md5(value) AS value_md5, n, {r_sql('n / rows * 100')} AS pct, n_unique
FROM r JOIN t ON r."column" = t."column" WHERE rank <= {k}"""


def _labelled(df):
    """Label for print, and the digest of the whole value."""
    return round_columns(df, ["pct"]).withColumn("label", short_label(F.col("value"), 52)).withColumn(
        "value_md5", F.md5(F.col("value").cast("binary"))).drop("value")


@check("top_values_orders", _topk_sql("orders", {
    "status": "nullif(o_orderstatus, 'P')", "priority": "o_orderpriority", "customer": "o_custkey"}, 10))
def top_orders(t: Tables):
    rows = t.orders.select(F.nullif("o_orderstatus", F.lit("P")).alias("status"),
                           F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("customer"))
    return _labelled(top_values_by_column(rows, rows.columns, 10))


@check("top_values_parts", _topk_sql("part", {
    "p_name": "p_name", "p_brand": "p_brand", "p_type": "nullif(p_type, 'PROMO')", "p_size": "p_size"}, 8))
def top_parts(t: Tables):
    rows = t.part.withColumn("p_type", F.nullif("p_type", F.lit("PROMO")))
    return _labelled(top_values_by_column(rows, ["p_name", "p_brand", "p_type", "p_size"], 8))


@check("top_values_documents", _topk_sql("documents", {"lang": "lang", "source": "source", "text": "text"}, 10))
def top_documents(t: Tables):
    return _labelled(top_values_by_column(t.documents, ["lang", "source", "text"], 10))


@check("top_single", """
SELECT p_name, count(*) AS n FROM part WHERE p_name IS NOT NULL GROUP BY 1 ORDER BY n DESC, p_name LIMIT 20""")
def top_single(t: Tables):
    return top_values(t.part, "p_name", 20)


PROFILE_METRICS_SQL = f"""count(*) AS n, {r_sql('avg(m)')} AS mean, {r_sql('median(m)')} AS median,
   {nearest_sql('m', 0.90)} AS p90, {nearest_sql('m', 0.95)} AS p95, max(m) AS max"""


@check("response_profile", f"""
SELECT event_type, {PROFILE_METRICS_SQL} FROM (
  SELECT event_type, trunc((epoch_us(next_ts) - epoch_us(ts)) / 1e6) / 60.0 AS m FROM {GAPS_SQL})
WHERE m BETWEEN 0 AND 480 GROUP BY 1
""")
def responses(t: Tables):
    minutes = event_gaps(t).select("event_type", elapsed_whole_minutes(F.col("ts"), F.col("next_ts")).alias("m"))
    profiled = duration_profile(minutes.where(F.col("m").between(0, 480)), "m", ["event_type"], few_values=True)
    return round_columns(profiled, ["mean", "median"])


@check("response_pairs", f"""
SELECT label, {PROFILE_METRICS_SQL} FROM (
  SELECT 'order to ship' AS label, (epoch(l_shipdate) - epoch(o_orderdate)) / 60.0 AS m
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT 'ship to order', (epoch(o_orderdate) - epoch(l_shipdate)) / 60.0
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
WHERE m BETWEEN 0 AND {480 * 1440} GROUP BY 1
""")
def pairs(t: Tables):
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    profiled = response_profile(joined, [("order to ship", "o_orderdate", "l_shipdate"),
                                         ("ship to order", "l_shipdate", "o_orderdate")], 480 * 1440)
    return round_columns(profiled, ["mean", "median"])


@check("median_by_group", f"""
SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS n, {r_sql('median(l_extendedprice)')} AS median
FROM lineitem GROUP BY 1, 2
""")
def medians(t: Tables):
    return round_columns(
        exact_quantiles(t.lineitem, "l_extendedprice", {"median": 0.5}, by=["l_returnflag", "l_linestatus"]),
        ["median"])


@check("median_by_supplier", f"""
SELECT l_suppkey, count(*) AS n, {r_sql('median(l_extendedprice)')} AS median FROM lineitem GROUP BY 1
""")
def medians_many(t: Tables):
    return round_columns(
        exact_quantiles(t.lineitem, "l_extendedprice", {"median": 0.5}, by=["l_suppkey"]), ["median"])


@check("linear_percentiles", f"""
SELECT count(*) AS n, {r_sql('median(l_extendedprice)')} AS median,
       {r_sql('quantile_cont(l_extendedprice, 0.9)')} AS p90, {r_sql('quantile_cont(l_extendedprice, 0.99)')} AS p99
FROM lineitem
""")
def percentiles(t: Tables):
    q = {"median": 0.5, "p90": 0.9, "p99": 0.99}
    return round_columns(exact_quantiles(t.lineitem, "l_extendedprice", q), list(q))


@check("nearest_percentiles", f"""
SELECT event_type, count(value) AS n, {nearest_sql('value', 0.9)} AS p90, {nearest_sql('value', 0.95)} AS p95
FROM events GROUP BY 1
""")
def nearest(t: Tables):
    return exact_quantiles(t.events, "value", {"p90": 0.9, "p95": 0.95}, by=["event_type"], rule="nearest")


@check("casualty_totals", """
SELECT 'value' AS "column", CAST(trunc(sum(value)) AS BIGINT) AS total,
       count(*) FILTER (WHERE value > 0) AS rows_above_zero FROM events
UNION ALL SELECT 'excess', CAST(trunc(sum(CASE WHEN value > 100 THEN value - 101 END)) AS BIGINT),
       count(*) FILTER (WHERE value > 101) FROM events
UNION ALL SELECT 'never', 0, 0
""")
def casualties(t: Tables):
    v = F.col("value")
    return casualty_totals(t.events.select(
        "value", F.when(v > 100, v - 101).alias("excess"), F.lit(None).cast("double").alias("never")),
        ["value", "excess", "never"])
