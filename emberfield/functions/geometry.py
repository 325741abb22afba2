"""Planar geometry on nested arrays: polygons -> rings -> points -> [x, y]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "array<double>"
LINE = "array<array<double>>"
POLYGON = "array<array<array<double>>>"
MULTIPOLYGON = "array<array<array<array<double>>>>"


def parse_geometry(kind: Column, coordinates: Column) -> Column:
    """GeoJSON type and coordinate text to a multi-polygon; anything else becomes null."""
    single = F.from_json(coordinates, POLYGON)
    return (F.when(kind == "MultiPolygon", F.from_json(coordinates, MULTIPOLYGON))
            .when((kind == "Polygon") & single.isNotNull(), F.array(single)))


def parse_parts(kind: Column, coordinates: Column) -> Column:
    """GeoJSON type and coordinate text to a struct ``polygons``, ``lines``, ``points``.

    ``lines`` also holds the rings of polygons and ``points`` the vertices of lines, for geometries
    whose area or length is zero. Fields that a geometry does not have are null.
    """
    polygons = parse_geometry(kind, coordinates)
    lines = (F.when(kind == "LineString", F.array(F.from_json(coordinates, LINE)))
             .when(kind == "MultiLineString", F.from_json(coordinates, POLYGON)).otherwise(F.flatten(polygons)))
    points = (F.when(kind == "Point", F.array(F.from_json(coordinates, POINT)))
              .when(kind == "MultiPoint", F.from_json(coordinates, LINE)).otherwise(F.flatten(lines)))
    return F.struct(polygons.alias("polygons"), lines.alias("lines"), points.alias("points"))


def line_centroid(lines: Column) -> Column:
    """Mid points of the segments weighted by length, as struct ``x, y``; null fields without length."""
    zero = F.struct(F.lit(0.0).alias("l"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def step(acc: Column, e: Column) -> Column:
        length = F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"])
        return F.struct((acc["l"] + length).alias("l"), (acc["mx"] + length * (e["x1"] + e["x2"]) / 2).alias("mx"),
                        (acc["my"] + length * (e["y1"] + e["y2"]) / 2).alias("my"))

    def finish(acc: Column) -> Column:
        length = F.when(acc["l"] > 0, acc["l"])
        return F.struct((acc["mx"] / length).alias("x"), (acc["my"] / length).alias("y"))

    return F.aggregate(F.flatten(F.transform(lines, ring_edges)), zero, step, finish)


def point_centroid(points: Column) -> Column:
    """Mean of the points as struct ``x, y``; null fields without a point of two numbers."""
    known = F.filter(points, lambda p: p[0].isNotNull() & p[1].isNotNull())
    n = F.when(F.size(known) > 0, F.size(known))

    def mean(i: int) -> Column:
        return F.aggregate(known, F.lit(0.0), lambda s, p: s + p[i]) / n
    return F.struct(mean(0).alias("x"), mean(1).alias("y"))


def any_centroid(parts: Column) -> Column:
    """Centroid by area, else by length, else of the points; ``parts`` from :func:`parse_parts`, as a column."""
    found = [centroid(parts["polygons"]), line_centroid(parts["lines"]), point_centroid(parts["points"])]
    return F.struct(*[F.coalesce(*[c[f] for c in found]).alias(f) for f in ("x", "y")])


def ring_edges(ring: Column) -> Column:
    """Consecutive vertex pairs of a closed ring as structs."""
    n = F.size(ring)
    return F.transform(
        F.slice(ring, 2, F.greatest(n - 1, F.lit(0))),
        lambda q, i: F.struct(
            ring[i][0].alias("x1"), ring[i][1].alias("y1"), q[0].alias("x2"), q[1].alias("y2")),
    )


def polygon_edges(geometry: Column) -> Column:
    """All edges of all rings of a multi-polygon."""
    return F.flatten(F.transform(F.flatten(geometry), ring_edges))


def _ring_moments(ring: Column) -> Column:
    """Twice the absolute area and the area-weighted offset from the ring's first vertex.

    Taking the vertices relative to the first one keeps full precision for coordinates that are
    large compared with the ring (longitudes of city parcels).
    """
    ox, oy = ring[0][0], ring[0][1]
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def step(acc: Column, e: Column) -> Column:
        x1, y1, x2, y2 = e["x1"] - ox, e["y1"] - oy, e["x2"] - ox, e["y2"] - oy
        cross = x1 * y2 - x2 * y1
        return F.struct((acc["a"] + cross).alias("a"),
                        (acc["mx"] + (x1 + x2) * cross).alias("mx"),
                        (acc["my"] + (y1 + y2) * cross).alias("my"))

    def finish(acc: Column) -> Column:
        turn = F.signum(acc["a"])
        return F.struct((acc["a"] * turn).alias("a"), (acc["mx"] * turn).alias("mx"),
                        (acc["my"] * turn).alias("my"), ox.alias("ox"), oy.alias("oy"))

    return F.aggregate(ring_edges(ring), zero, step, finish)


def centroid(geometry: Column) -> Column:
    """Area centroid as struct ``x, y``: holes count negative, parts add by area.

    The struct is null for a missing geometry; its fields are null for one without area. The
    geometry is referred to several times, so pass a column, not a parse expression.
    """
    signed = F.flatten(F.transform(
        geometry,
        lambda polygon: F.transform(polygon, lambda ring, i: F.struct(
            F.when(i == 0, 1.0).otherwise(-1.0).alias("sign"), _ring_moments(ring).alias("m"))),
    ))
    # One common origin (the first vertex of all) for the sum over the rings.
    ox, oy = geometry[0][0][0][0], geometry[0][0][0][1]
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def step(acc: Column, r: Column) -> Column:
        m, s = r["m"], r["sign"]
        return F.struct(
            (acc["a"] + s * m["a"]).alias("a"),
            (acc["mx"] + s * (m["mx"] + 3 * m["a"] * (m["ox"] - ox))).alias("mx"),
            (acc["my"] + s * (m["my"] + 3 * m["a"] * (m["oy"] - oy))).alias("my"))

    def finish(acc: Column) -> Column:
        area = F.when(acc["a"] > 0, acc["a"] * 3)
        return F.struct((ox + acc["mx"] / area).alias("x"), (oy + acc["my"] / area).alias("y"))

    return F.aggregate(signed, zero, step, finish)


def strictly_inside(x: Column, y: Column, edges: Column) -> Column:
    """Odd number of edges to the right of the point, and the point on none of them.

    One fold over the edges does both: a touched edge adds a step no number of crossings reaches.
    """
    touched = 1 << 24

    def step(acc: Column, e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        side = dx * (y - e["y1"]) - dy * (x - e["x1"])
        on_edge = ((side == 0) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
                   & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])))
        # Upward edges have the point on their left (side > 0) when it lies before them in x.
        crosses = (((e["y1"] <= y) & (e["y2"] > y) & (side > 0))
                   | ((e["y2"] <= y) & (e["y1"] > y) & (side < 0)))
        return F.when(on_edge, acc + touched).when(crosses, acc + 1).otherwise(acc)

    hits = F.aggregate(edges, F.lit(0), step)
    return (hits < touched) & (hits % 2 == 1)
