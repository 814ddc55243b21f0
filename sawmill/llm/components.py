"""Connected components of a large edge list: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _stars(both: DataFrame) -> DataFrame:
    """u, v, and m: the least node among u and its neighbours v."""
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    return both.join(least, F.col("u") == F.col("c")).drop("c")


def components(edges: DataFrame, max_steps: int = 60) -> DataFrame:
    """node, component (the least node reachable) for the nodes of edges (a, b). Nodes: any orderable type.

    Every step is a grouped minimum and a join, written to the shared folder; a third of all edges at one
    node meets as partial minima and in a join whose skewed side may be split."""
    now = written(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).filter("u != v").distinct(), "edges")
    was = None
    for _ in range(max_steps):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        stars = _stars(large)  # large has v < u in every row
        small = stars.select(F.col("v").alias("u"), F.col("m").alias("v")).union(stars.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        now = written(small, "edges")
        sign = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == was:
            break
        was = sign
    else:
        raise RuntimeError("components did not settle")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
