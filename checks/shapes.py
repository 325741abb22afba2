"""Spatial queries: points in polygons, centroids, parcels to districts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from checks.registry import Tables, check, r_sql, round_columns
from emberfield.functions.geometry import any_centroid, centroid, parse_parts
from emberfield.operators.rollup import parcel_rollup
from emberfield.operators.spatial import join_within, match_rate
from emberfield.plans.incidents import locate_parcels, locate_parcels_left


def ring(*points: tuple) -> Column:
    """Closed ring from (x, y) columns or numbers."""
    def number(v):
        return (v if isinstance(v, Column) else F.lit(v)).cast("double")

    return F.array(*[F.array(number(x), number(y)) for x, y in (*points, points[0])])


def nation_triangles(t: Tables):
    """Overlapping right triangles along the x axis, one per nation."""
    x = F.col("n_nationkey") * 2
    return t.nation.select("n_name", F.array(F.array(ring((x, 0), (x + 10, 0), (x, 10)))).alias("geometry"))


def lineitem_points(t: Tables):
    """Lattice points, so that many of them lie exactly on an outline."""
    return t.lineitem.select("l_orderkey", F.col("l_quantity").alias("x"),
                             F.rint(F.col("l_discount") * 100).alias("y"))


WITHIN_SQL = """(SELECT l_orderkey, n_name FROM
  (SELECT l_orderkey, l_quantity AS x, round_even(l_discount * 100, 0) AS y FROM lineitem)
  LEFT JOIN nation ON x > n_nationkey * 2 AND y > 0 AND x - n_nationkey * 2 + y < 10)"""


@check("point_in_polygon", f"""
SELECT n_name, count(*) AS points, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM {WITHIN_SQL} GROUP BY 1
""")
def within(t: Tables):
    joined = join_within(lineitem_points(t), nation_triangles(t))
    return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("points"), F.sum("l_orderkey").alias("keys"))


@check("match_rate", f"""
SELECT count(n_name) AS matched, count(*) AS total, {r_sql('count(n_name) / count(*) * 100')} AS match_pct
FROM {WITHIN_SQL}
""")
def rate(t: Tables):
    return round_columns(match_rate(join_within(lineitem_points(t), nation_triangles(t)), "n_name"), ["match_pct"])


@check("polygon_centroid", f"""
SELECT c_custkey, {r_sql('(100 * (x + 5) - 4 * (x + 2) + 9 * (x + 22)) / 105', 6)} AS x,
       {r_sql('(100 * (y + 5) - 4 * (y + 2) + 9 * (y + 1)) / 105', 6)} AS y
FROM (SELECT c_custkey, -122 + c_custkey * 0.001 AS x, 37 + c_nationkey * 0.5 AS y FROM customer)
""")
def centroids(t: Tables):
    """A square with a hole plus a triangle, at a place of its own per customer."""
    x, y = F.lit(-122.0) + F.col("c_custkey") * 0.001, F.lit(37.0) + F.col("c_nationkey") * 0.5
    square = ring((x, y), (x + 10, y), (x + 10, y + 10), (x, y + 10))
    hole = ring((x + 1, y + 1), (x + 1, y + 3), (x + 3, y + 3), (x + 3, y + 1))
    triangle = ring((x + 20, y), (x + 20, y + 3), (x + 26, y))
    shape = F.array(F.array(square, hole), F.array(triangle))
    shapes = t.customer.select("c_custkey", F.explode(F.array(shape)).alias("shape"))
    return round_columns(shapes.select("c_custkey", F.inline(F.array(centroid(F.col("shape"))))), ["x", "y"], 6)


@check("geojson_geometry", """
SELECT s_suppkey, CAST(CASE WHEN s_nationkey >= 5 THEN s_nationkey + 2 WHEN s_nationkey >= 3 THEN s_nationkey + 1 ELSE s_nationkey END AS DOUBLE) AS x,
       CAST(CASE WHEN s_nationkey >= 5 THEN s_suppkey + 1 ELSE s_suppkey END AS DOUBLE) AS y FROM supplier
""")
def geojson(t: Tables):
    """Rectangles of both kinds, lines and points, written as GeoJSON text."""
    def point(x: Column, y: Column) -> Column:
        return F.concat(F.lit("["), x.cast("string"), F.lit(","), y.cast("string"), F.lit("]"))

    x, y = F.col("s_nationkey"), F.col("s_suppkey")
    outline = F.concat(F.lit("[["), F.concat_ws(",", point(x, y), point(x + 4, y), point(x + 4, y + 2),
                                                point(x, y + 2), point(x, y)), F.lit("]]"))
    kind = F.when(x < 3, "Point").when(x < 5, "LineString").when(x < 15, "Polygon").otherwise("MultiPolygon")
    text = (F.when(x < 3, point(x, y)).when(x < 5, F.concat(F.lit("["), point(x, y), F.lit(","), point(x + 2, y), F.lit("]"))).when(x < 15, outline)
            .otherwise(F.concat(F.lit("["), outline, F.lit("]"))))
    shapes = t.supplier.select("s_suppkey", F.explode(F.array(parse_parts(kind, text))).alias("shape"))
    return shapes.select("s_suppkey", F.inline(F.array(any_centroid(F.col("shape")))))


def nation_boxes(t: Tables):
    """Nations as boxes of a 5 x 5 grid."""
    k = F.col("n_nationkey")
    x, y = (k % 5) * 10, F.floor(k / 5) * 20
    box = ring((x, y), (x + 10, y), (x + 10, y + 20), (x, y + 20))
    return t.nation.select(F.col("n_name").alias("neighborhood"), F.array(F.array(box)).alias("geometry"))


def part_parcels(t: Tables):
    """Parts as small square parcels with GeoJSON outlines; promotional ones lie outside the grid."""
    x = F.when(F.col("p_type") == "PROMO", -F.col("p_size")).otherwise(F.col("p_size")) - 0.5
    y = F.col("p_retailprice") - 900 + 0.03
    corner = [(x + dx, y + dy) for dx, dy in ((-.25, -.25), (.25, -.25), (.25, .25), (-.25, .25), (-.25, -.25))]
    outline = F.to_json(F.array(F.array(*[F.array(a, b) for a, b in corner])))
    spot, line = F.to_json(F.array(x, y)), F.to_json(F.array(F.array(x - .25, y), F.array(x + .25, y)))
    brand = F.col("p_brand")
    return t.part.select(
        F.struct(F.when(brand == "Brand#1", "Point").when(brand == "Brand#2", "LineString").otherwise("Polygon").alias("type"),
                 F.when(brand == "Brand#1", spot).when(brand == "Brand#2", line).otherwise(outline).alias("coordinates")).alias("the_geom"),
        F.col("p_partkey").cast("string").alias("blklot"),
        F.when(F.col("p_size") > 5, 1900.0 + F.col("p_size") * 2).alias("yrbuilt"),
        F.when(F.col("p_type") == "LARGE", "PDR").otherwise("RESIDENT").alias("landuse"),
        F.col("p_size").cast("double").alias("resunits"), F.col("p_retailprice").alias("st_area_sh"))


LOCATED_SQL = """(SELECT p.*, n_name FROM
  (SELECT *, CASE WHEN p_type = 'PROMO' THEN -p_size ELSE p_size END - 0.5 AS x, p_retailprice - 900 + 0.03 AS y
   FROM part) p
  LEFT JOIN nation ON x > (n_nationkey % 5) * 10 AND x < (n_nationkey % 5) * 10 + 10
   AND y > floor(n_nationkey / 5) * 20 AND y < floor(n_nationkey / 5) * 20 + 20)"""


@check("located_parcels", f"""
SELECT n_name AS neighborhood, count(*) AS parcel_count, count(*) FILTER (WHERE p_size > 5) AS yrbuilt_count,
       count(*) FILTER (WHERE p_size > 5 AND 1900 + p_size * 2 < 1940) AS pre1940_count,
       count(*) FILTER (WHERE p_size > 5 AND 1900 + p_size * 2 < 1960) AS pre1960_count,
       sum(p_size)::DOUBLE AS total_resunits, count(*) FILTER (WHERE p_type <> 'LARGE') AS residential_count,
       {r_sql('sum(p_retailprice)')} AS total_area_sqft,
       {r_sql("coalesce(sum(CASE WHEN p_type = 'LARGE' THEN p_retailprice END), 0.0)")} AS high_risk_commercial_area_sqft
FROM {LOCATED_SQL} WHERE n_name IS NOT NULL GROUP BY 1
""")
def located(t: Tables):
    return round_columns(parcel_rollup(locate_parcels(part_parcels(t), nation_boxes(t))),
                         ["total_area_sqft", "high_risk_commercial_area_sqft"])


@check("parcel_match_rate", f"""
SELECT count(n_name) AS matched, count(*) AS total, {r_sql('count(n_name) / count(*) * 100')} AS match_pct
FROM {LOCATED_SQL}
""")
def parcel_rate(t: Tables):
    joined = locate_parcels_left(part_parcels(t), nation_boxes(t))
    return round_columns(match_rate(joined, "neighborhood"), ["match_pct"])
