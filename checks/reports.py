"""Report tables: key figures, calendars, yearly sums, histograms, capped counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.facts import GAPS_SQL, event_gaps
from checks.registry import Tables, check, nearest_sql, r_sql, round_columns, rounded
from emberfield import constants as K
from emberfield.functions.time import elapsed_whole_minutes
from emberfield.operators.frequency import (
    capped_value_counts, histogram, month_counts, value_counts, weekday_counts)
from emberfield.plans.report import casualties_by_year, key_figures, prepare_export, report_long
from emberfield.plans.statistics import statistics_long


def events_as_export(t: Tables):
    """Events as prepared incidents: gaps as response time, types as casualties."""
    kind, v = F.col("event_type"), F.rint("value")
    return event_gaps(t).join(t.events.select("event_id", "value"), "event_id").select(
        F.col("event_id").cast("string").alias("incident_number"), F.col("ts").alias("incident_date"),
        elapsed_whole_minutes(F.col("ts"), F.col("next_ts")).alias("response_min"),
        F.when(kind == "error", v).alias("fire_fatalities"), F.when(kind == "view", v).alias("fire_injuries"),
        F.when(kind == "click", v).alias("civilian_fatalities"), v.alias("civilian_injuries"),
        (v * 1000).alias("estimated_property_loss"),
        F.when(kind != "signup", F.concat(F.lit("D"), F.col("user_id").cast("string"))).alias("neighborhood_district"))


@check("key_figures", f"""
SELECT count(*) AS total_records, count(DISTINCT g.event_id) AS unique_incidents,
       min(g.ts) AS first_date, max(g.ts) AS last_date,
       {r_sql("avg(CASE WHEN m BETWEEN 0 AND 120 THEN m END)")} AS avg_response_min,
       sum(CASE WHEN g.event_type = 'error' THEN v END) AS total_fire_fatalities,
       sum(CASE WHEN g.event_type = 'view' THEN v END) AS total_fire_injuries,
       sum(CASE WHEN g.event_type = 'click' THEN v END) AS total_civilian_fatalities,
       sum(v) AS total_civilian_injuries, sum(v * 1000) AS total_estimated_property_loss,
       count(DISTINCT CASE WHEN g.event_type <> 'signup' THEN g.user_id END) + 1 AS unique_neighborhoods
FROM (SELECT *, trunc((epoch_us(next_ts) - epoch_us(ts)) / 1e6) / 60.0 AS m FROM {GAPS_SQL}) g
JOIN (SELECT event_id, round_even(value, 0) AS v FROM events) e ON g.event_id = e.event_id
""")
def figures(t: Tables):
    return round_columns(key_figures(events_as_export(t)), ["avg_response_min"])


def _calendar_sql() -> str:
    months = ", ".join(f"({i}, '{m}')" for i, m in enumerate(K.MONTH_NAMES, 1))
    days = ", ".join(f"({i}, '{d}')" for i, d in enumerate(K.WEEKDAY_NAMES, 1))
    part = """SELECT '{kind}' AS kind, CAST(p AS INTEGER) AS position, l AS label, count(event_id) AS n
      FROM (VALUES {values}) c(p, l) LEFT JOIN events ON strftime(ts, '{f}') = l GROUP BY 1, 2, 3"""
    return (part.format(kind="month", values=months, f="%b") + " UNION ALL "
            + part.format(kind="weekday", values=days, f="%a"))


@check("calendar_counts", _calendar_sql())
def calendar(t: Tables):
    months = month_counts(t.events, "ts").select(F.lit("month").alias("kind"), "position", "label", "n")
    days = weekday_counts(t.events, "ts").select(F.lit("weekday").alias("kind"), "position", "label", "n")
    return months.unionByName(days)


@check("hour_counts", "SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM events GROUP BY 1")
def hours(t: Tables):
    return value_counts(t.events.select(F.hour("ts").alias("hour")), "hour")


@check("group_counts_with_null", """
SELECT nullif(o_orderpriority, '5-LOW') AS battalion, count(*) AS n FROM orders GROUP BY 1""")
def counts_with_null(t: Tables):
    return value_counts(t.orders.select(F.nullif("o_orderpriority", F.lit("5-LOW")).alias("battalion")),
                        "battalion", keep_null=True)


@check("yearly_sums", """
SELECT CAST(year(o_orderdate) + 5 AS INTEGER) AS year,
       coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN floor(o_totalprice) END), 0.0) AS fire_fatalities,
       sum(floor(o_totalprice)) AS fire_injuries,
       0.0::DOUBLE AS civilian_fatalities, count(*)::DOUBLE AS civilian_injuries
FROM orders WHERE year(o_orderdate) + 5 >= 2003 GROUP BY 1
""")
def yearly(t: Tables):
    whole = F.floor("o_totalprice").cast("double")
    rows = t.orders.select(
        (F.year("o_orderdate") + 5).alias("year"),
        F.when(F.col("o_orderstatus") == "F", whole).alias("fire_fatalities"), whole.alias("fire_injuries"),
        F.lit(None).cast("double").alias("civilian_fatalities"), F.lit(1.0).alias("civilian_injuries"))
    return casualties_by_year(rows)


@check("counts_since_year", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders WHERE year(o_orderdate) >= 1997 GROUP BY 1""")
def since(t: Tables):
    years = t.orders.select(F.year("o_orderdate").alias("year"))
    return value_counts(years.where(F.col("year") >= 1997), "year")


def _histogram_sql(source: str, bins: int) -> str:
    return f"""
WITH v AS (SELECT v FROM ({source}) WHERE v IS NOT NULL), e AS (SELECT min(v) AS lo, max(v) AS hi FROM v),
 c AS (SELECT CAST(least(floor((v - lo) / ((hi - lo) / {bins})), {bins - 1}) AS BIGINT) AS bin, count(*) AS n
       FROM v, e GROUP BY 1)
SELECT b.bin, {r_sql(f'lo + b.bin * ((hi - lo) / {bins})')} AS low,
       {r_sql(f'lo + (b.bin + 1) * ((hi - lo) / {bins})')} AS high, coalesce(n, 0) AS n
FROM (SELECT unnest(range({bins})) AS bin) b, e LEFT JOIN c ON c.bin = b.bin"""


@check("histogram_linear", _histogram_sql("SELECT l_extendedprice AS v FROM lineitem", 60))
def linear(t: Tables):
    return round_columns(histogram(t.lineitem, F.col("l_extendedprice"), 60), ["low", "high"])


@check("histogram_log10", _histogram_sql("SELECT log10(c_acctbal) AS v FROM customer WHERE c_acctbal > 0", 40))
def logarithmic(t: Tables):
    positive = t.customer.where(F.col("c_acctbal") > 0)
    return round_columns(histogram(positive, F.log10("c_acctbal"), 40), ["low", "high"])


@check("capped_value_counts", f"""
WITH cap AS (SELECT {nearest_sql('l_quantity', 0.9)} AS cap FROM lineitem)
SELECT CAST(l_quantity AS BIGINT) AS l_quantity, count(*) AS n FROM lineitem, cap WHERE l_quantity <= cap GROUP BY 1
""")
def capped(t: Tables):
    return capped_value_counts(t.lineitem, "l_quantity", 0.9, few_values=True)


@check("capped_event_values", f"""
WITH cap AS (SELECT {nearest_sql('value', 0.99)} AS cap FROM events)
SELECT CAST(trunc(value) AS BIGINT) AS value, count(*) AS n FROM events, cap WHERE value <= cap GROUP BY 1
""")
def capped_events(t: Tables):
    return capped_value_counts(t.events, "value")


@check("significance_stars", f"""
SELECT CASE WHEN l_discount < 0.001 THEN '***' WHEN l_discount < 0.01 THEN '**' WHEN l_discount < 0.05 THEN '*'
            WHEN l_discount < 0.1 THEN '.' ELSE ' ' END AS stars, count(*) AS n, {r_sql('sum(l_discount)')} AS total
FROM lineitem GROUP BY 1
""")
def stars(t: Tables):
    from emberfield.functions.numeric import significance_stars

    return (t.lineitem.groupBy(significance_stars(F.col("l_discount")).alias("stars"))
            .agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("l_discount")).alias("total")))


def orders_as_export(t: Tables):
    """Orders as the wide incident export: eight years later, with gaps in times, places and counts."""
    key, customer, price = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    later = F.col("o_orderdate") + F.make_ym_interval(F.lit(8)) + F.make_dt_interval(secs=key % 86400)
    arrival = F.when(F.col("o_orderstatus") != "P", later + F.make_dt_interval(secs=F.floor(price / 100)))
    return t.orders.select(
        key.cast("string").alias("incident_number"), later.alias("incident_date"), later.alias("alarm_dttm"),
        arrival.alias("arrival_dttm"), (arrival + F.make_dt_interval(secs=customer)).alias("close_dttm"),
        F.col("o_orderpriority").alias("primary_situation"), F.nullif("o_orderstatus", F.lit("P")).alias("property_use"),
        F.nullif(F.concat(F.lit("B"), customer % 9), F.lit("B0")).alias("battalion"),
        F.concat(F.lit("D"), customer % 25).alias("neighborhood_district"),
        F.when(customer % 13 < 11, customer % 13).cast("string").alias("suppression_units"),
        F.when(F.col("o_orderstatus") == "F", F.floor(price)).otherwise(0).cast("double").alias("estimated_property_loss"),
        (key % 3).cast("double").alias("fire_fatalities"), F.when(key % 4 > 0, key % 4 - 1).cast("double").alias("civilian_injuries"))


EXPORT_SQL = """
WITH alarm AS (SELECT *, o_orderdate + INTERVAL 8 YEAR + to_seconds(o_orderkey % 86400) AS a FROM orders),
 arrival AS (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN a + to_seconds(CAST(floor(o_totalprice / 100) AS BIGINT)) END AS b FROM alarm),
 x AS (SELECT CAST(o_orderkey AS VARCHAR) AS incident_number, a AS incident_date, a AS alarm_dttm, b AS arrival_dttm,
   b + to_seconds(o_custkey) AS close_dttm, o_orderpriority AS primary_situation, nullif(o_orderstatus, 'P') AS property_use,
   nullif('B' || o_custkey % 9, 'B0') AS battalion, 'D' || o_custkey % 25 AS neighborhood_district,
   CASE WHEN o_custkey % 13 < 11 THEN CAST(o_custkey % 13 AS DOUBLE) END AS suppression_units,
   CASE WHEN o_orderstatus = 'F' THEN floor(o_totalprice) ELSE 0 END AS estimated_property_loss,
   CAST(o_orderkey % 3 AS DOUBLE) AS fire_fatalities, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderkey % 4 - 1 AS DOUBLE) END AS civilian_injuries,
   trunc(epoch_us(b - a) / 1e6) / 60.0 AS response_min, trunc(epoch_us(b + to_seconds(o_custkey) - a) / 1e6) / 60.0 AS duration_min
 FROM arrival)
"""
EXPORT_COLUMNS = ["incident_number", "incident_date", "alarm_dttm", "arrival_dttm", "close_dttm", "primary_situation", "property_use",
                  "battalion", "neighborhood_district", "suppression_units", "estimated_property_loss", "fire_fatalities", "civilian_injuries"]


def _long_sql(kind: str, name: str, item: str, metrics: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS {kind}, {item} AS item, '{m}' AS metric, {r_sql(f'CAST({e} AS DOUBLE)')} AS value FROM ({source})"
        for m, e in metrics.items())


def _report_sql() -> str:
    def part(name: str, item: str, metrics: dict[str, str], source: str) -> str:
        return _long_sql("report", name, item, metrics, source)

    def counts(name: str, key: str, where: str = "true") -> str:
        return part(name, "coalesce(CAST(k AS VARCHAR), 'missing')", {"n": "n"}, f"SELECT {key} AS k, count(*) AS n FROM x WHERE {where} GROUP BY 1")

    def calendar(name: str, form: str, labels: list[str]) -> str:
        values = ", ".join(f"({i}, '{m}')" for i, m in enumerate(labels, 1))
        return part(name, "CAST(p AS VARCHAR)", {"n": "n"}, f"SELECT p, count(incident_number) AS n FROM (VALUES {values}) c(p, l) "
                    f"LEFT JOIN x ON strftime(alarm_dttm, '{form}') = l GROUP BY 1")

    near = "response_min BETWEEN 0 AND 60"
    sums = {f"total_{c}": f"sum({c})" for c in ("fire_fatalities", "civilian_injuries", "estimated_property_loss")}
    bins = {"low": "low", "high": "high", "n": "n"}
    parts = [
        part("key_figures", "'all'", {"total_records": "count(*)", "unique_incidents": "count(DISTINCT incident_number)",
             "avg_response_min": "avg(CASE WHEN response_min BETWEEN 0 AND 120 THEN response_min END)", **sums,
             "unique_neighborhoods": "count(DISTINCT neighborhood_district)"}, "SELECT * FROM x"),
        counts("per_year", "year(alarm_dttm)", "year(alarm_dttm) >= 2003"), counts("per_hour", "hour(alarm_dttm)"),
        calendar("per_month", "%b", K.MONTH_NAMES), calendar("per_weekday", "%a", K.WEEKDAY_NAMES),
        part("casualties_by_year", "CAST(y AS VARCHAR)", {c: c for c in ("fire_fatalities", "civilian_injuries")},
             "SELECT year(alarm_dttm) AS y, sum(fire_fatalities) AS fire_fatalities, coalesce(sum(civilian_injuries), 0) AS civilian_injuries "
             "FROM x WHERE year(alarm_dttm) >= 2003 GROUP BY 1"),
        *[part("casualty_totals", f"'{c}'", {"total": f"trunc(sum({c}))", "rows_above_zero": f"count(*) FILTER (WHERE {c} > 0)"},
               "SELECT * FROM x") for c in ("fire_fatalities", "civilian_injuries")],
        *[counts(f"top_{c}", c, f"{c} IS NOT NULL") for c in ("primary_situation", "property_use")],
        part("top_neighborhood_district", "k", {"n": "n"}, "SELECT neighborhood_district AS k, count(*) AS n FROM x GROUP BY 1 ORDER BY n DESC, k LIMIT 20"),
        part("response_histogram", "CAST(bin AS VARCHAR)", bins, _histogram_sql(f"SELECT response_min AS v FROM x WHERE {near}", 60)),
        part("response_percentiles", "'all'", {"n": "count(*)", "median": "median(response_min)", "p90": "quantile_cont(response_min, 0.9)"},
             f"SELECT * FROM x WHERE {near}"),
        part("response_by_battalion", "battalion", {"n": "n", "median_min": "m"}, "SELECT battalion, count(*) AS n, median(response_min) AS m "
             f"FROM x WHERE {near} AND battalion IS NOT NULL GROUP BY 1"),
        part("values_suppression_units", "CAST(k AS VARCHAR)", {"n": "n"}, "SELECT CAST(suppression_units AS BIGINT) AS k, count(*) AS n FROM x, "
             f"(SELECT {nearest_sql('suppression_units', 0.99)} AS cap FROM x) WHERE suppression_units <= cap GROUP BY 1"),
        counts("per_battalion", "battalion"),
        part("loss_histogram", "CAST(bin AS VARCHAR)", bins,
             _histogram_sql("SELECT log10(estimated_property_loss) AS v FROM x WHERE estimated_property_loss > 0", 40)),
        *[part("completeness", f"'{c}'", {"nulls": f"count(*) - count({c})", "rows": "count(*)",
               "null_pct": f"(count(*) - count({c})) / count(*) * 100"}, "SELECT * FROM x") for c in EXPORT_COLUMNS]]
    return EXPORT_SQL + " UNION ALL ".join(parts)


@check("report_tables", _report_sql())
def report_page_tables(t: Tables):
    return round_columns(report_long(prepare_export(orders_as_export(t))), ["value"])


def _statistics_sql() -> str:
    def part(section: str, item: str, metrics: dict[str, str], source: str = "SELECT * FROM x") -> str:
        return f"SELECT *, NULL AS text FROM ({_long_sql('section', section, item, metrics, source)})"

    nulls = [c for c in EXPORT_COLUMNS if c in ("arrival_dttm", "close_dttm", "property_use", "battalion", "suppression_units", "civilian_injuries")]
    categories = ["primary_situation", "property_use", "battalion", "neighborhood_district"]
    top = " UNION ALL ".join(f"SELECT '{c}' AS c, {c} AS v FROM x" for c in categories)
    ranked = f"""SELECT c || ' #' || row_number() OVER (PARTITION BY c ORDER BY n DESC, v) AS item, * FROM (
      SELECT c, v, count(*) AS n, count(*) OVER (PARTITION BY c) AS n_unique, sum(count(*)) OVER (PARTITION BY c) AS rows FROM ({top}) GROUP BY 1, 2)
      WHERE v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY c ORDER BY n DESC, v) <= 10"""
    numbers = ["suppression_units", "fire_fatalities", "civilian_injuries", "estimated_property_loss"]
    pairs = {label: {"alarm_dttm arrival_dttm": "response_min", "alarm_dttm close_dttm": "duration_min"}[f"{a} {b}"]
             for label, a, b in K.RESPONSE_PAIRS}
    parts = [
        part("shape", "'incidents'", {"rows": "count(*)", "columns": f"max({len(EXPORT_COLUMNS)})"}),
        *[part("missing", f"'{c}'", {"nulls": f"count(*) - count({c})", "rows": "count(*)", "null_pct": f"(count(*) - count({c})) / count(*) * 100"})
          for c in nulls],
        part("categories", "item", {"n": "n", "pct": "n / rows * 100", "n_unique": "n_unique"}, ranked),
        f"SELECT 'categories' AS section, item, 'value' AS metric, CAST(NULL AS DOUBLE) AS value, v AS text FROM ({ranked})",
        *[part("numbers", f"'{c}'", {"count": f"count({c})", "null_count": f"count(*) - count({c})", "mean": f"avg({c})",
               "std": f"stddev_samp({c})", "min": f"min({c})", "q25": nearest_sql(c, 0.25), "q50": nearest_sql(c, 0.5),
               "q75": nearest_sql(c, 0.75), "max": f"max({c})"}) for c in numbers],
        *[part("response", f"'{label}'", {"n": "count(*)", "mean": f"avg({c})", "median": f"median({c})", "p90": nearest_sql(c, 0.9),
               "p95": nearest_sql(c, 0.95), "max": f"max({c})"}, f"SELECT * FROM x WHERE {c} BETWEEN 0 AND 480") for label, c in pairs.items()],
        *[part("casualties", f"'{c}'", {"total": f"trunc(sum({c}))", "rows_above_zero": f"count(*) FILTER (WHERE {c} > 0)"})
          for c in ("fire_fatalities", "civilian_injuries")]]
    return EXPORT_SQL + " UNION ALL ".join(parts)


@check("statistics_long", _statistics_sql())
def export_statistics(t: Tables):
    """All numeric rows of the profile, and the category values as text."""
    long = statistics_long(orders_as_export(t)).where("section <> 'schema' and metric not in ('first', 'last')")
    word = F.col("metric") == "value"
    return long.select("section", "item", "metric", rounded(F.when(~word, F.col("value").try_cast("double"))).alias("value"),
                       F.when(word, F.col("value")).alias("text"))
