"""Connected components of a link table by alternating star contraction.

Each turn hangs the larger neighbours of every node on its smallest neighbour, then the smaller ones,
until all nodes of a component hang on its smallest. Only aggregates and joins on node numbers are
used; every turn is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberfield.session import materialize

MOST_TURNS = 60


def _smallest(pairs: DataFrame) -> DataFrame:
    """Each node with its smallest neighbour. Written, so that a node with many links can be split in the join."""
    return materialize(pairs.groupBy("u").agg(F.min("v").alias("low")), "smallest")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _smallest(both).select("u", F.least("u", "low").alias("low"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u > v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """``links`` hold the larger node first."""
    low = _smallest(links)
    moved = links.join(low, "u").where("v > low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.union(low.select("u", F.col("low").alias("v"))).distinct()


def _settled(links: DataFrame) -> bool:
    """Every node hangs on one root, and no root hangs on another node."""
    roles = links.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("root")).union(
        links.select("v", F.lit(0), F.lit(1)))
    return roles.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("root").alias("root")).where(
        "hangs > 1 or hangs = 1 and root = 1").isEmpty()


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node with a link; the component is its smallest node."""
    turned = links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u > v").distinct()
    now = materialize(turned, "links")
    for _ in range(MOST_TURNS):
        if _settled(now):
            break
        now = materialize(_small_star(materialize(_large_star(now), "large_star")), "small_star")
    else:
        raise RuntimeError("components did not settle")
    root = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        root.select(F.col("v").alias("node"), F.col("v").alias("component")))
