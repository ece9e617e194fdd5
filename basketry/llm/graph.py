"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import pinned, remove


def components(edges: DataFrame) -> tuple[DataFrame, str]:
    """``node, component`` (the least node) for every node of ``edges`` (``u, v``), and the path it is kept at.

    Each round hangs the neighbours of a node on its least neighbour, first the
    larger ones, then the smaller, until every tree is a star: each node hangs on
    one other, and none of those hangs itself. The number of rounds is
    logarithmic. A half round is one aggregate and one join on the same key; the
    aggregate is written first, so that the join may split hot nodes.
    """
    spark = edges.sparkSession
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    edges, path = pinned(edges, "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        edges, path = _star(both, F.least(F.min("v"), F.col("u")), "v > u", path)
        edges, path = _star(edges, F.min("v"), "true", path, with_self=True)
        below = edges.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds"))
        above = edges.select(F.col("v").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds"))
        roles = below.unionByName(above).groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
        if roles.filter("hangs > 1 or (hangs = 1 and holds = 1)").isEmpty():
            break
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out, kept = pinned(nodes.unionByName(roots), "components")
    remove(spark, path)
    return out, kept


def _star(edges, least, which: str, path: str, with_self: bool = False):
    spark = edges.sparkSession
    mins, mins_path = pinned(edges.groupBy("u").agg(least.alias("m")), "mins")
    new = edges.filter(which).join(mins, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if with_self:
        new = new.unionByName(mins.select("u", F.col("m").alias("v")))
    out, out_path = pinned(new.filter("u <> v").distinct(), "edges")
    remove(spark, mins_path)
    remove(spark, path)
    return out, out_path
