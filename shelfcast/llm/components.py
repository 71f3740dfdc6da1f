"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, comp)`` for every node that a link touches; ``comp`` is its component's least node.

    Each round points nodes at the least neighbour they know (a large star, then a small one),
    with aggregations that combine before their shuffle and equi-joins that AQE can split, so a
    node with very many links is no bottleneck. A round's edges are written to the shared folder,
    which cuts lineage; the rounds end when a round changes nothing. Links with a null end, and
    links from a node to itself, join nothing. No links: an empty table.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v")
    edges = written(edges.distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u > v").distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.where("u > v").unionByName(least.select("u", F.col("m").alias("v")))
        edges = written(small.distinct(), "small")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
    tops = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
        tops.select("node", F.col("node").alias("comp"))
    )
