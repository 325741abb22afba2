"""Unit-dispatch analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.facts import GAPS_SQL, event_gaps
from checks.registry import Tables, check, r_sql, round_columns
from emberfield.plans import dispatch as D

MINUTES_SQL = "(epoch_us(next_ts) - epoch_us(ts)) / 1e6 / 60"


@check("shift_counts", "SELECT CAST(ts - INTERVAL 8 HOUR AS DATE) AS shift, count(*) AS n FROM events GROUP BY 1")
def shifts(t: Tables):
    return D.calls_per_shift(t.events, "ts")


@check("calls_per_month", "SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS period, count(*) AS n FROM orders GROUP BY 1")
def monthly(t: Tables):
    return D.calls_per(t.orders, "o_orderdate", "month")


@check("heat_grid", """
SELECT CAST(floor(l_extendedprice / 5000) AS BIGINT) AS cell_x, CAST(floor(l_quantity / 4) AS BIGINT) AS cell_y,
       count(*) AS n FROM lineitem GROUP BY 1, 2""")
def grid(t: Tables):
    return D.heat_grid(t.lineitem, "l_extendedprice", "l_quantity", 5000, 4)


def _corr_sql() -> str:
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {r_sql(f'corr({a}, {b})', 8)} AS r FROM lineitem"
        for i, a in enumerate(names) for b in names[i + 1:])


@check("correlations", _corr_sql())
def corr(t: Tables):
    return round_columns(D.correlations(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), ["r"], 8)


@check("annualised", f"""
SELECT o_orderpriority, {r_sql('sum(o_totalprice) / (SELECT count(DISTINCT year(o_orderdate)) FROM orders)', 2)}
       AS o_totalprice_per_year FROM orders GROUP BY 1
""")
def yearly(t: Tables):
    rows = t.orders.withColumn("year", F.year("o_orderdate"))
    return round_columns(D.annualised(rows, ["o_orderpriority"], ["o_totalprice"], "year"),
                         ["o_totalprice_per_year"], 2)


@check("unit_activity", f"""
SELECT user_id, count(*) AS calls, {r_sql(f'avg({MINUTES_SQL})', 6)} AS mean_minutes FROM {GAPS_SQL} GROUP BY 1
""")
def units(t: Tables):
    return round_columns(D.unit_activity(event_gaps(t), "user_id", "ts", "next_ts"), ["mean_minutes"], 6)


@check("dispatch_response", f"""
SELECT event_type, count(m) AS n, count(*) AS calls, {r_sql('avg(m)', 6)} AS mean, {r_sql('median(m)', 6)} AS median,
       {r_sql('quantile_cont(m, 0.95)', 6)} AS p95
FROM (SELECT event_type, {MINUTES_SQL} AS m FROM {GAPS_SQL}) GROUP BY 1
""")
def response(t: Tables):
    return round_columns(D.response_summary(event_gaps(t), "ts", "next_ts", ["event_type"]),
                         ["mean", "median", "p95"], 6)
