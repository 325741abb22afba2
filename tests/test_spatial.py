"""Centroids and the point-in-polygon join against plain Python."""

import json
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from emberfield.functions.geometry import MULTIPOLYGON, centroid, parse_geometry, strictly_inside, polygon_edges
from emberfield.operators.spatial import join_within, match_rate, polygon_cells, unusable_geometries, with_centroid

# Three sample parcels.
PARCELS = {
    "0027001": [[-122.41912043184, 37.8057848887946], [-122.418815265608, 37.8058238290567],
                [-122.418797588546, 37.8057356825183], [-122.419102547256, 37.805696769104],
                [-122.41912043184, 37.8057848887946]],
    "0027001A": [[-122.419229395657, 37.8054580528662], [-122.419245904508, 37.8055393943837],
                 [-122.41907503194, 37.8055611986881], [-122.418770393042, 37.8056000716906],
                 [-122.418754076019, 37.8055187053657], [-122.419229395657, 37.8054580528662]],
    "0027001B": [[-122.419210377517, 37.8053909390644], [-122.419215638482, 37.805390267662],
                 [-122.419229395657, 37.8054580528662], [-122.418754076019, 37.8055187053657],
                 [-122.418740477778, 37.8054509004049], [-122.419210377517, 37.8053909390644]],
}


def shapes(spark, geometries):
    data = [(name, g) for name, g in geometries.items()]
    return spark.createDataFrame(data, f"name string, geometry {MULTIPOLYGON}")


def exact_centroid(geometry):
    """Area centroid in exact fractions: rings after the first of a polygon are holes."""
    area = mx = my = Fraction(0)
    for polygon in geometry:
        for i, ring in enumerate(polygon):
            a = x = y = Fraction(0)
            for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
                x1, y1, x2, y2 = map(Fraction, (x1, y1, x2, y2))
                c = x1 * y2 - x2 * y1
                a, x, y = a + c, x + (x1 + x2) * c, y + (y1 + y2) * c
            s = (1 if a > 0 else -1) * (1 if i == 0 else -1)
            area, mx, my = area + s * a, mx + s * x, my + s * y
    return float(mx / (3 * area)), float(my / (3 * area))


def inside(x, y, geometry):
    """Strictly inside by exact arithmetic."""
    x, y, odd = Fraction(x), Fraction(y), False
    for polygon in geometry:
        for ring in polygon:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
                x1, y1, x2, y2 = map(Fraction, (x1, y1, x2, y2))
                if ((x2 - x1) * (y - y1) == (y2 - y1) * (x - x1)
                        and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2)):
                    return False
                if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                    odd = not odd
    return odd


def test_sample_parcel_centroids(spark):
    text = [(k, "MultiPolygon", json.dumps([[ring]])) for k, ring in PARCELS.items()]
    df = spark.createDataFrame(text, "blklot string, kind string, coords string")
    got = {r["blklot"]: (r["x"], r["y"]) for r in
           with_centroid(df, F.col("kind"), F.col("coords"), ["blklot"]).collect()}
    want = {"0027001": (-122.4189589592175, 37.80576029737945),
            "0027001A": (-122.41899994274428, 37.80552905888513),
            "0027001B": (-122.41898489762353, 37.80545448344949)}
    for k, (x, y) in want.items():
        assert got[k] == pytest.approx((x, y), abs=2e-14)
        assert exact_centroid([[PARCELS[k]]]) == pytest.approx((x, y), abs=1e-14)


def test_centroid_of_parts_holes_and_windings(spark):
    square = [[0., 0.], [4., 0.], [4., 4.], [0., 4.], [0., 0.]]
    hole = [[1., 1.], [2., 1.], [2., 2.], [1., 2.], [1., 1.]]
    far = [[100., 50.], [103., 50.], [100., 58.], [100., 50.]]
    cases = {"hole": [[square, hole]], "reversed": [[square[::-1], hole]], "both": [[square, hole[::-1]], [far[::-1]]]}
    got = {r["name"]: r["c"] for r in shapes(spark, cases).select("name", centroid(F.col("geometry")).alias("c")).collect()}
    for name, g in cases.items():
        assert tuple(got[name]) == pytest.approx(exact_centroid(g), rel=1e-13)


def test_lines_and_points_have_a_centroid_and_the_rest_is_counted(spark):
    data = [("flat", "Polygon", "[[[0,0],[1,1],[0,0]]]", (0.5, 0.5)), ("spot", "Polygon", "[[[3,4],[3,4],[3,4]]]", (3, 4)),
            ("point", "Point", "[1,2]", (1, 2)), ("points", "MultiPoint", "[[1,2],[3,6]]", (2, 4)),
            ("line", "LineString", "[[0,0],[4,0],[4,2]]", (8 / 3, 1 / 3)), ("lines", "MultiLineString", "[[[0,0],[2,0]],[[0,4],[2,4]]]", (1, 2)),
            ("broken", "Polygon", "nope", None), ("null", None, None, None), ("other", "Sphere", "[1,2]", None),
            ("ok", "Polygon", "[[[0,0],[2,0],[2,2],[0,2],[0,0]]]", (1, 1))]
    df = spark.createDataFrame([d[:3] for d in data], "name string, kind string, coords string")
    got = {r["name"]: (r["x"], r["y"]) for r in with_centroid(df, F.col("kind"), F.col("coords"), ["name"]).collect()}
    want = {name: xy for name, _, _, xy in data if xy}
    assert got.keys() == want.keys()
    for name, xy in want.items():
        assert got[name] == pytest.approx(xy), name
    assert tuple(unusable_geometries(df, F.col("kind"), F.col("coords")).first()) == (10, 3)


def test_strictly_inside_on_the_outline(spark):
    square = shapes(spark, {"s": [[[[0., 0.], [4., 0.], [4., 4.], [0., 4.], [0., 0.]]]]})
    points = [(0., 0.), (2., 0.), (4., 4.), (4., 2.), (2., 4.), (0., 2.), (2., 2.), (5., 2.), (-1., 0.), (-1., 4.)]
    pts = spark.createDataFrame(points, "x double, y double")
    got = pts.join(square).where(strictly_inside(F.col("x"), F.col("y"), polygon_edges(F.col("geometry")))).collect()
    assert [(r["x"], r["y"]) for r in got] == [(2., 2.)]


def random_outline(rnd, cx, cy, n, grid):
    """Star-shaped ring around a centre; with ``grid`` on whole numbers, so points hit edges."""
    import math

    points = []
    for i in range(n):
        r, a = rnd.uniform(3, 9), 2 * math.pi * (i + rnd.random() * 0.8) / n
        x, y = cx + r * math.cos(a), cy + r * math.sin(a)
        points.append([float(round(x)), float(round(y))] if grid else [x, y])
    return points + [points[0]]


@pytest.mark.parametrize("grid", [False, True])
@pytest.mark.parametrize("step", [None, 0.7, 5.0, 1000.0])
def test_join_against_brute_force(spark, grid, step):
    rnd = random.Random(11)
    geometries = {}
    for k in range(7):
        cx, cy = rnd.uniform(-10, 10), rnd.uniform(-10, 10)
        outer = random_outline(rnd, round(cx), round(cy), 9, grid)
        hole = [[round(cx) + dx, round(cy) + dy] for dx, dy in ((-1., -1.), (1., -1.), (1., 1.), (-1., 1.), (-1., -1.))]
        parts = [[outer, hole]]
        if k % 2:
            parts.append([[[cx + 30, cy], [cx + 35, cy], [cx + 35, cy + 4], [cx + 30, cy]]])
        geometries[f"p{k}"] = parts
    points = [(i, float(rnd.randint(-20, 45)) if grid else rnd.uniform(-20, 45), float(rnd.randint(-20, 20)) if grid
               else rnd.uniform(-20, 20)) for i in range(500)]
    want = set()
    for i, x, y in points:
        hits = [name for name, g in geometries.items() if inside(x, y, g)]
        want |= {(i, name) for name in hits} or {(i, None)}
    joined = join_within(spark.createDataFrame(points, "i int, x double, y double"), shapes(spark, geometries), step=step)
    got = [(r["i"], r["name"]) for r in joined.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    rate = match_rate(joined, "name").first()
    assert (rate["matched"], rate["total"]) == (sum(n is not None for _, n in want), len(want))


def test_inner_cells_need_no_edges(spark):
    square = shapes(spark, {"s": [[[[0., 0.], [10., 0.], [10., 10.], [0., 10.], [0., 0.]]]]})
    cells = polygon_cells(square, "geometry", 1.0).collect()
    assert sum(r["_edges"] is None for r in cells) == 64
    assert len(cells) <= 11 * 11


def test_points_without_coordinates_stay(spark):
    square = shapes(spark, {"s": [[[[0., 0.], [1., 0.], [1., 1.], [0., 1.], [0., 0.]]]]})
    points = spark.createDataFrame([(1, None, 0.5), (2, 0.5, 0.5)], "i int, x double, y double")
    assert sorted((r["i"], r["name"]) for r in join_within(points, square).collect()) == [(1, None), (2, "s")]


def test_shared_edge_matches_neither_side(spark):
    left = [[[[0., 0.], [1., 0.], [1., 1.], [0., 1.], [0., 0.]]]]
    right = [[[[1., 0.], [2., 0.], [2., 1.], [1., 1.], [1., 0.]]]]
    points = spark.createDataFrame([(1, 1.0, 0.5), (2, 1.5, 0.5)], "i int, x double, y double")
    got = join_within(points, shapes(spark, {"l": left, "r": right})).collect()
    assert sorted((r["i"], r["name"]) for r in got) == [(1, None), (2, "r")]


def test_parse_geometry_kinds(spark):
    df = spark.createDataFrame([("Polygon", "[[[0,0],[1,0],[0,1],[0,0]]]"), ("MultiPolygon", "[[[[0,0],[1,0],[0,1],[0,0]]]]"),
                                ("LineString", "[[0,0],[1,1]]")], "kind string, coords string")
    got = [r[0] for r in df.select(parse_geometry(F.col("kind"), F.col("coords"))).collect()]
    assert got[0] == got[1] == [[[[0., 0.], [1., 0.], [0., 1.], [0., 0.]]]] and got[2] is None
