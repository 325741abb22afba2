"""Points strictly inside polygons, as an equi-join on grid cells.

A bare "point in polygon" condition plans as a nested loop over all pairs. Here the polygons are
cut into grid cells once. A cell wholly inside a polygon needs no further test. A cell on the
outline carries only those edges that matter to a point in it (edges that overlap its band of y and
do not lie wholly to its left), so the exact test stays short for detailed outlines. Points get
their cell from two floors and are not expanded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfield.functions.geometry import any_centroid, parse_parts, polygon_edges, strictly_inside
from emberfield.session import materialize


def with_centroid(df: DataFrame, kind: Column, coordinates: Column, keep: Sequence[str]) -> DataFrame:
    """``keep`` plus centroid ``x``, ``y`` of GeoJSON geometries; rows without one drop out.

    Polygons have theirs by area, lines by length, points by their mean; what has no area or length
    falls back to the next. ``unusable_geometries`` counts the rows that drop out.

    The generators are evaluated once per row, and a filter on their output cannot be copied below
    them, so each geometry is parsed once and folded once.
    """
    shapes = df.select(*keep, F.explode(F.array(parse_parts(kind, coordinates))).alias("_shape"))
    points = shapes.select(*keep, F.inline(F.array(any_centroid(F.col("_shape")))))
    return points.where(F.col("x").isNotNull() & F.col("y").isNotNull())


def unusable_geometries(df: DataFrame, kind: Column, coordinates: Column) -> DataFrame:
    """How many rows there are and how many of them have no centroid."""
    shapes = df.select(F.explode(F.array(parse_parts(kind, coordinates))).alias("_shape"))
    points = shapes.select(F.inline(F.array(any_centroid(F.col("_shape")))))
    return points.agg(F.count(F.lit(1)).alias("total"),
                      F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("unusable"))


def polygon_cells(polygons: DataFrame, geometry: str, step: float) -> DataFrame:
    """One row per polygon and grid cell it covers: ``_cx``, ``_cy``, ``_edges``, other columns.

    ``_edges`` is null for a cell wholly inside; cells wholly outside are left out.
    """
    others = [c for c in polygons.columns if c != geometry]
    edges = polygons.select(*others, F.explode(F.array(polygon_edges(F.col(geometry)))).alias("_all"))
    xs, ys = F.transform("_all", lambda e: e["x1"]), F.transform("_all", lambda e: e["y1"])
    # Bounds of the cell; the small widening covers the rounding of floor(x / step).
    slack = step * 1e-9
    left, bottom = F.col("_cx") * F.lit(step) - slack, F.col("_cy") * F.lit(step) - slack
    right, top = left + step + 2 * slack, bottom + step + 2 * slack

    def in_band(e: Column) -> Column:
        return (F.greatest(e["y1"], e["y2"]) >= bottom) & (F.least(e["y1"], e["y2"]) <= top)

    def not_left(e: Column) -> Column:
        return F.greatest(e["x1"], e["x2"]) >= left

    def meets_cell(e: Column) -> Column:
        """Not beyond the right side, and not all four corners strictly on one side of the edge."""
        corners = [(e["x2"] - e["x1"]) * (cy - e["y1"]) - (e["y2"] - e["y1"]) * (cx - e["x1"])
                   for cx in (left, right) for cy in (bottom, top)]
        return ((F.least(e["x1"], e["x2"]) <= right)
                & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0))

    rows = (edges.where(F.size("_all") > 0)
            .withColumns({"_x0": F.floor(F.array_min(xs) / step), "_x1": F.floor(F.array_max(xs) / step)})
            .withColumn("_cy", F.explode(F.sequence(F.floor(F.array_min(ys) / step),
                                                    F.floor(F.array_max(ys) / step))))
            .withColumn("_band", F.explode(F.array(F.filter("_all", in_band))))
            .withColumn("_cx", F.explode(F.sequence("_x0", "_x1")))
            .withColumn("_near", F.explode(F.array(F.filter("_band", not_left))))
            .where(F.size("_near") > 0)
            .withColumn("_border", F.exists("_near", meets_cell)))
    middle = strictly_inside(left + step / 2, bottom + step / 2, F.col("_near"))
    return (rows.where(F.col("_border") | middle)
            .select(*others, "_cx", "_cy", F.when(F.col("_border"), F.col("_near")).alias("_edges")))


def grid_step(polygons: DataFrame, geometry: str, cells_per_polygon: int = 32) -> float:
    """Cell size: a fraction of the average polygon's longer side, whatever the number of polygons.

    Smaller cells leave fewer points in border cells, the only ones that need the exact test. The
    size is at least 1/1024 of the whole extent, so one huge outline among small ones stays affordable.
    """
    edges = polygons.select(F.explode(F.array(polygon_edges(F.col(geometry)))).alias("e"))
    xs, ys = F.transform("e", lambda e: e["x1"]), F.transform("e", lambda e: e["y1"])
    boxes = edges.where(F.size("e") > 0).select(
        F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"),
        F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))
    box = boxes.agg(
        F.avg(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).alias("side"),
        F.greatest(F.max("x1") - F.min("x0"), F.max("y1") - F.min("y0")).alias("extent")).first()
    step = max((box["side"] or 0.0) / cells_per_polygon, (box["extent"] or 0.0) / 1024)
    return step if step > 0 else 1.0


def join_within(
    points: DataFrame,
    polygons: DataFrame,
    x: str = "x",
    y: str = "y",
    geometry: str = "geometry",
    step: float | None = None,
) -> DataFrame:
    """Left join: every point with each polygon it lies strictly inside, null columns if none.

    Points on an outline match nothing; a point in two polygons gives two rows. The cell table is
    materialised, so it is broadcast when its real size allows; beyond that the join shuffles on
    the cell and adaptive skew handling splits crowded cells on the point side.
    """
    if step is None:
        step = grid_step(polygons, geometry)
    cells = materialize(polygon_cells(polygons, geometry, step), "polygon-cells")
    px, py = points[x], points[y]
    match = ((F.floor(px / step) == cells["_cx"]) & (F.floor(py / step) == cells["_cy"])
             & (cells["_edges"].isNull() | strictly_inside(px, py, cells["_edges"])))
    return points.join(cells, match, "left").drop("_cx", "_cy", "_edges")


def match_rate(joined: DataFrame, name: str) -> DataFrame:
    return joined.agg(F.count(name).alias("matched"), F.count(F.lit(1)).alias("total")).withColumn(
        "match_pct", F.col("matched") / F.when(F.col("total") > 0, F.col("total")) * 100)
