"""Model inputs and regressions. Closed forms in SQL where they exist."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import Tables, check, r_sql, round_columns, rounded
from checks.rollups import RATES_SQL, order_nations
from emberfield.functions.time import elapsed_minutes
from emberfield.operators.absorbed import fit_absorbed
from emberfield.operators.design import (
    design_matrix, model_input, model_input_counts, one_hot, quartile_profile, sample_summary, stratum, zscore)
from emberfield.operators.levels import one_hot_sparse
from emberfield.operators.regression import coefficient_table, fit_ols, nested_rsquared, product_sums
from emberfield.operators.rollup import group_rates
from emberfield.session import materialize


@check("zscore", f"""
SELECT o_orderkey, {r_sql('(o_totalprice - avg(o_totalprice) OVER ()) / stddev_samp(o_totalprice) OVER ()', 6)} AS price_z,
       {r_sql('(o_custkey - avg(o_custkey) OVER ()) / stddev_samp(o_custkey) OVER ()', 6)} AS customer_z
FROM orders
""")
def standardised(t: Tables):
    rows = t.orders.select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("customer"))
    return round_columns(zscore(rows, ["price", "customer"]), ["price_z", "customer_z"], 6).select(
        "o_orderkey", "price_z", "customer_z")


@check("one_hot", "SELECT p_partkey, " + ", ".join(
    f"CAST(p_type = '{v}' AS DOUBLE) AS kind_{v}" for v in ("LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"))
    + " FROM part")
def dummies(t: Tables):
    return one_hot(t.part.select("p_partkey", "p_type"), "p_type", prefix="kind").drop("p_type")


@check("one_hot_sparse", """
WITH l AS (SELECT o_custkey, row_number() OVER (ORDER BY o_custkey) - 2 AS position, count(*) OVER () - 1 AS size
           FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IS NOT NULL))
SELECT o_orderkey, CASE WHEN position >= 0 THEN position END AS position, size,
       CASE WHEN position >= 0 THEN 1.0::DOUBLE END AS entry
FROM orders LEFT JOIN l USING (o_custkey)
""")
def sparse_dummies(t: Tables):
    """A dummy per customer, as one sparse vector a row."""
    v = one_hot_sparse(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", "v")
    return v.select("o_orderkey", F.get(F.col("v.indices"), F.lit(0)).alias("position"), "v.size",
                    F.get(F.col("v.values"), F.lit(0)).alias("entry"))


@check("design_matrix", f"""
SELECT p_partkey, 1.0::DOUBLE AS const,
       {r_sql('(p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER ()', 6)} AS p_retailprice,
       p_size, CAST(p_type = 'SMALL' AS DOUBLE) AS cat_SMALL, 0.0::DOUBLE AS "cat_NONE", CAST(p_type = 'PROMO' AS DOUBLE) AS cat_PROMO
FROM part
""")
def matrix(t: Tables):
    built = design_matrix(t.part, ["p_retailprice"], ["p_size"], "p_type",
                          levels=["LARGE", "SMALL", "NONE", "PROMO"], keep=["p_partkey"])
    return round_columns(built, ["p_retailprice"], 6)


@check("quartile_profile", f"""
WITH j AS (SELECT c_acctbal AS x, o_totalprice AS y FROM orders JOIN customer ON o_custkey = c_custkey),
 e AS (SELECT quantile_cont(x, 0.25) AS e1, quantile_cont(x, 0.5) AS e2, quantile_cont(x, 0.75) AS e3 FROM j)
SELECT CASE WHEN x <= e1 THEN 'q1' WHEN x <= e2 THEN 'q2' WHEN x <= e3 THEN 'q3' ELSE 'q4' END AS quartile,
       count(*) AS n, {r_sql('avg(y)')} AS mean, {r_sql('median(y)')} AS median
FROM j, e GROUP BY 1
""")
def quartiles(t: Tables):
    joined = materialize(t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
                         .select("c_acctbal", "o_totalprice"), "balances")
    return round_columns(quartile_profile(joined, "c_acctbal", "o_totalprice"), ["mean", "median"])


@check("sample_summary", f"""
SELECT o_orderstatus, count(*) AS n, {r_sql('median(o_totalprice)')} AS median, {r_sql('avg(o_totalprice)')} AS mean,
       {r_sql('stddev_samp(o_totalprice)')} AS std, min(o_totalprice) AS min, max(o_totalprice) AS max
FROM orders GROUP BY 1
""")
def sample(t: Tables):
    return round_columns(sample_summary(t.orders, "o_totalprice", ["o_orderstatus"]), ["median", "mean", "std"])


def shipments(t: Tables):
    """Line items with a response in scaled days, a coded situation and a gappy price."""
    joined = (t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
              .join(t.part, F.col("l_partkey") == F.col("p_partkey")))
    return joined.select(
        "l_orderkey", "l_linenumber", "l_quantity",
        (elapsed_minutes(F.col("o_orderdate"), F.col("l_shipdate")) / 1440 / 8).alias("response_time_min"),
        F.concat((44 + F.col("p_size") * 17).cast("string"), F.lit(" - "), "p_name").alias("primary_situation"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price"))


SHIPMENTS_SQL = """(SELECT l_orderkey, l_linenumber, l_quantity,
   (epoch(l_shipdate) - epoch(o_orderdate)) / 86400.0 / 8.0 AS response_time_min,
   TRY_CAST(regexp_extract((44 + p_size * 17) || ' - ' || p_name, '^(\\d{3})', 1) AS DOUBLE) AS incident_code,
   CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
MODEL_SQL = f"""(SELECT *, CASE CAST(floor(incident_code / 100) AS INTEGER) WHEN 1 THEN 'Feuer' WHEN 2 THEN 'Ueberhitzung'
   WHEN 3 THEN 'Rettung_EMS' WHEN 4 THEN 'Gefahrstoffe' WHEN 5 THEN 'Service' WHEN 6 THEN 'Suche_Sonstiges'
   WHEN 7 THEN 'Fehlalarm' END AS incident_category FROM {SHIPMENTS_SQL}
 WHERE response_time_min > 0 AND response_time_min < 60 AND incident_code >= 100 AND incident_code < 800 AND price IS NOT NULL)"""


@check("model_input", f"""
SELECT l_orderkey, l_linenumber, response_time_min, incident_code, incident_category, price FROM {MODEL_SQL}
""")
def inputs(t: Tables):
    return model_input(shipments(t), required=["price"]).select(
        "l_orderkey", "l_linenumber", "response_time_min", "incident_code", "incident_category", "price")


@check("model_input_counts", f"""
SELECT count(*) AS rows, count(*) FILTER (WHERE response_time_min > 0 AND response_time_min < 60) AS kept,
       count(*) FILTER (WHERE NOT (response_time_min > 0 AND response_time_min < 60)) AS removed
FROM {SHIPMENTS_SQL}
""")
def input_counts(t: Tables):
    return model_input_counts(shipments(t))


@check("stratum_counts", f"""
SELECT incident_category, count(*) AS n, {r_sql('avg(response_time_min)')} AS mean FROM {MODEL_SQL}
WHERE incident_code BETWEEN 300 AND 399 GROUP BY 1
""")
def strata(t: Tables):
    part = stratum(model_input(shipments(t), required=["price"]), "incident_code", (300, 399))
    return part.groupBy("incident_category").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.avg("response_time_min")).alias("mean"))


@check("product_sums", f"""
SELECT l_returnflag, count(*) AS rows, count(*)::DOUBLE AS s0, {r_sql('sum(l_quantity)')} AS s1_0,
       {r_sql('sum(l_discount)')} AS s1_1, {r_sql('sum(l_quantity * l_quantity)')} AS s2_0_0,
       {r_sql('sum(l_quantity * l_discount)')} AS s2_0_1, {r_sql('sum(l_discount * l_discount)')} AS s2_1_1
FROM lineitem GROUP BY 1
""")
def moments(t: Tables):
    sums = product_sums(t.lineitem, ["l_returnflag"], [F.col("l_quantity"), F.col("l_discount")])
    return round_columns(sums, ["s1_0", "s1_1", "s2_0_0", "s2_0_1", "s2_1_1"])


def reported(table, digits: int = 4):
    return round_columns(table.select("stratum", "term", "coef", "se", "n", "r2"), ["coef", "se", "r2"], digits)


@check("ols_robust_simple", f"""
WITH z AS (SELECT l_extendedprice AS y, (l_quantity - avg(l_quantity) OVER ()) / stddev_samp(l_quantity) OVER () AS z,
                  count(*) OVER () AS n FROM lineitem),
 m AS (SELECT count(*) AS n, avg(y) AS b0, sum(z * y) / (count(*) - 1) AS b1 FROM z),
 e AS (SELECT z, y - b0 - b1 * z AS e, y - b0 AS yc, 1 / m.n + z * z / (m.n - 1) AS h FROM z, m),
 w AS (SELECT sum(e * e / (1 - h) / (1 - h)) AS w0, sum(e * e / (1 - h) / (1 - h) * z * z) AS w2,
              1 - sum(e * e) / sum(yc * yc) AS r2 FROM e)
SELECT 'all' AS stratum, 'const' AS term, {r_sql('b0')} AS coef, {r_sql('sqrt(w0) / n')} AS se, n, {r_sql('r2')} AS r2 FROM m, w
UNION ALL
SELECT 'all', 'l_quantity', {r_sql('b1')}, {r_sql('sqrt(w2) / (n - 1)')}, n, {r_sql('r2')} FROM m, w
""")
def simple(t: Tables):
    return reported(coefficient_table(t.spark, fit_ols(t.lineitem, "l_extendedprice", ["l_quantity"])))


def _within_sql(stratum: str, select: str, category: str = "l_linenumber") -> str:
    """Two standardised slopes with category dummies, by demeaning inside the category."""
    return f"""
WITH s AS (SELECT {stratum} AS g, {category} AS c, l_extendedprice AS y,
   (l_quantity - avg(l_quantity) OVER p) / stddev_samp(l_quantity) OVER p AS z1,
   (l_discount - avg(l_discount) OVER p) / stddev_samp(l_discount) OVER p AS z2
   FROM lineitem WINDOW p AS (PARTITION BY {stratum})),
 d AS (SELECT g, y - avg(y) OVER p AS yd, z1 - avg(z1) OVER p AS a, z2 - avg(z2) OVER p AS b,
   count(*) OVER p AS nc, y - avg(y) OVER (PARTITION BY g) AS yc, z1, z2 FROM s WINDOW p AS (PARTITION BY g, c)),
 m AS (SELECT g, count(*) AS n, sum(a * a) AS saa, sum(a * b) AS sab, sum(b * b) AS sbb, sum(a * yd) AS say,
   sum(b * yd) AS sby, sum(yc * yc) AS sst, sum(z1 * z2) AS s12, sum(z1 * yc) AS s1y, sum(z2 * yc) AS s2y FROM d GROUP BY g),
 i AS (SELECT *, sbb / (saa * sbb - sab * sab) AS i11, -sab / (saa * sbb - sab * sab) AS i12,
   saa / (saa * sbb - sab * sab) AS i22 FROM m),
 k AS (SELECT *, i11 * say + i12 * sby AS b1, i12 * say + i22 * sby AS b2 FROM i),
 e AS (SELECT d.g, a, b, yd - b1 * a - b2 * b AS e,
   1 / nc + i11 * a * a + 2 * i12 * a * b + i22 * b * b AS h FROM d JOIN k ON d.g = k.g),
 w AS (SELECT g, sum(e * e / (1 - h) / (1 - h) * a * a) AS waa, sum(e * e / (1 - h) / (1 - h) * a * b) AS wab,
   sum(e * e / (1 - h) / (1 - h) * b * b) AS wbb, sum(e * e) AS ssr FROM e WHERE 1 - h > 1e-10 GROUP BY g),
 f AS (SELECT k.*, w.* EXCLUDE (g), 1 - ssr / sst AS r2,
   sqrt(i11 * i11 * waa + 2 * i11 * i12 * wab + i12 * i12 * wbb) AS se1,
   sqrt(i12 * i12 * waa + 2 * i12 * i22 * wab + i22 * i22 * wbb) AS se2,
   ((n - 1) * s1y * s1y - 2 * s12 * s1y * s2y + (n - 1) * s2y * s2y)
     / (((n - 1.0) * (n - 1.0) - s12 * s12) * sst) AS r2_base FROM k JOIN w ON k.g = w.g)
{select}"""


@check("ols_robust_by_stratum", _within_sql("l_returnflag", f"""
SELECT g AS stratum, 'l_quantity' AS term, {r_sql('b1')} AS coef, {r_sql('se1')} AS se, n, {r_sql('r2')} AS r2 FROM f
UNION ALL SELECT g, 'l_discount', {r_sql('b2')}, {r_sql('se2')}, n, {r_sql('r2')} FROM f"""))
def by_stratum(t: Tables):
    """One model per return flag with line-number dummies; only the slopes are reported."""
    fits = fit_ols(t.lineitem, "l_extendedprice", ["l_quantity", "l_discount"],
                   category="l_linenumber", strata="l_returnflag")
    return reported(coefficient_table(t.spark, fits, ["l_quantity", "l_discount"]))


@check("ols_nested", _within_sql("'all'", f"""
SELECT n, {r_sql('r2_base', 8)} AS r2_base, {r_sql('r2', 8)} AS r2, {r_sql('r2 - r2_base', 8)} AS delta FROM f"""))
def nested(t: Tables):
    fit = fit_ols(t.lineitem, "l_extendedprice", ["l_quantity", "l_discount"], category="l_linenumber")["all"]
    base = nested_rsquared(fit, ["l_quantity", "l_discount"])
    row = t.spark.createDataFrame([(fit.n, base, float(fit.rsquared), float(fit.rsquared) - base)],
                                  "n long, r2_base double, r2 double, delta double")
    return round_columns(row, ["r2_base", "r2", "delta"], 8)


@check("ols_absorbed", _within_sql("'all'", f"""
SELECT 'all' AS stratum, 'l_quantity' AS term, {r_sql('b1')} AS coef, {r_sql('se1')} AS se, n, {r_sql('r2')} AS r2 FROM f
UNION ALL SELECT 'all', 'l_discount', {r_sql('b2')}, {r_sql('se2')}, n, {r_sql('r2')} FROM f""", "l_orderkey"))
def absorbed(t: Tables):
    """Two slopes within orders: one effect per order, eliminated inside Spark."""
    fits = fit_absorbed(t.lineitem, "l_extendedprice", ["l_quantity", "l_discount"], absorb="l_orderkey").fits
    return reported(coefficient_table(t.spark, fits, ["l_quantity", "l_discount"]))


@check("ols_level_effects", f"""
WITH s AS (SELECT l_partkey, l_extendedprice AS y, (l_quantity - avg(l_quantity) OVER ()) / stddev_samp(l_quantity) OVER () AS z
           FROM lineitem),
 m AS (SELECT l_partkey, count(*) AS n, avg(y) AS ym, avg(z) AS zm FROM s GROUP BY 1),
 b AS (SELECT sum((z - zm) * (y - ym)) / sum((z - zm) * (z - zm)) AS b FROM s JOIN m USING (l_partkey))
SELECT CAST(l_partkey AS VARCHAR) AS level, n, {r_sql('ym - b * zm')} AS intercept FROM m, b
""")
def level_effects(t: Tables):
    """The intercept of every part, next to one slope."""
    found = fit_absorbed(t.lineitem, "l_extendedprice", ["l_quantity"], absorb="l_partkey", cov="classic")
    return round_columns(found.effects.select("level", "n", "intercept"), ["intercept"])


@check("ols_inference")
def inference(t: Tables):
    """The whole coefficient table with tests and stars."""
    fits = fit_ols(t.lineitem, "l_extendedprice", ["l_quantity", "l_discount"], ["l_tax"],
                   category="l_linenumber", strata="l_returnflag", prefix="line")
    return coefficient_table(t.spark, fits)


@check("ols_group_level", f"""
WITH z AS (SELECT rate_pct AS y, (price - avg(price) OVER ()) / stddev_samp(price) OVER () AS z1,
    (total - avg(total) OVER ()) / stddev_samp(total) OVER () AS z2 FROM {RATES_SQL}),
 m AS (SELECT count(*) AS n, avg(y) AS b0, sum(z1 * z2) AS s12, sum(z1 * y) AS s1y, sum(z2 * y) AS s2y FROM z),
 b AS (SELECT *, (n - 1.0) * (n - 1.0) - s12 * s12 AS det FROM m),
 c AS (SELECT *, ((n - 1) * s1y - s12 * s2y) / det AS b1, ((n - 1) * s2y - s12 * s1y) / det AS b2 FROM b),
 r AS (SELECT sum((y - b0 - b1 * z1 - b2 * z2) ** 2) AS ssr, sum((y - b0) ** 2) AS sst FROM z, c),
 f AS (SELECT c.*, ssr / (n - 3) AS s2, 1 - ssr / sst AS r2 FROM c, r)
SELECT 'all' AS stratum, 'const' AS term, {r_sql('b0')} AS coef, {r_sql('sqrt(s2 / n)')} AS se, n, {r_sql('r2')} AS r2 FROM f
UNION ALL SELECT 'all', 'price', {r_sql('b1')}, {r_sql('sqrt(s2 * (n - 1) / det)')}, n, {r_sql('r2')} FROM f
UNION ALL SELECT 'all', 'total', {r_sql('b2')}, {r_sql('sqrt(s2 * (n - 1) / det)')}, n, {r_sql('r2')} FROM f
""")
def group_level(t: Tables):
    rated = materialize(
        group_rates(order_nations(t), "n_name", "o_orderkey", F.col("o_orderstatus") == "F",
                    ["price"], ["o_orderdate", "o_orderkey"]), "rates")
    return reported(coefficient_table(t.spark, fit_ols(rated, "rate_pct", ["price", "total"], cov="classic")))


@check("cluster_robust", f"""
WITH z AS (SELECT l_suppkey, l_extendedprice AS y,
                  (l_quantity - avg(l_quantity) OVER ()) / stddev_samp(l_quantity) OVER () AS z FROM lineitem),
 m AS (SELECT count(*) AS n, avg(y) AS b0, sum(z * y) / (count(*) - 1) AS b1 FROM z),
 u AS (SELECT l_suppkey, sum(y - b0 - b1 * z) AS u0, sum((y - b0 - b1 * z) * z) AS u1,
              sum((y - b0 - b1 * z) ** 2) AS ssr, sum((y - b0) ** 2) AS sst FROM z, m GROUP BY 1),
 v AS (SELECT sum(u0 * u0) AS v0, sum(u1 * u1) AS v1, count(*) AS g, 1 - sum(ssr) / sum(sst) AS r2 FROM u),
 f AS (SELECT *, sqrt(g / (g - 1) * (n - 1) / (n - 2)) AS k FROM m, v)
SELECT 'all' AS stratum, 'const' AS term, {r_sql('b0')} AS coef, {r_sql('sqrt(v0) / n * k')} AS se, n, {r_sql('r2')} AS r2 FROM f
UNION ALL SELECT 'all', 'l_quantity', {r_sql('b1')}, {r_sql('sqrt(v1) / (n - 1) * k')}, n, {r_sql('r2')} FROM f
""")
def clustered(t: Tables):
    fits = fit_ols(t.lineitem, "l_extendedprice", ["l_quantity"], cov="cluster", cluster="l_suppkey")
    return reported(coefficient_table(t.spark, fits))
