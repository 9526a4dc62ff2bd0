"""Connected components by alternating stars, with every step a join or an aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.storage import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on (u, v) with u > v: the neighbours of a node are hung on the smallest of them and itself; those
    above it in a large star, those below it and itself in a small one. The minima are summed before the shuffle and written,
    so a node with a large share of all edges is an ordinary skewed join side."""
    if large:
        near = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = written(near.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low")), "star")
        moved = near.join(lowest, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        lowest = written(edges.groupBy("u").agg(F.min("v").alias("low")), "star")
        moved = edges.join(lowest, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        moved = moved.union(lowest.select("u", F.col("low").alias("v")))
    return moved.filter(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node of its component. Written."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "links")
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
        edges = written(_star(written(_star(edges, True), "large-star"), False), "small-star")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
