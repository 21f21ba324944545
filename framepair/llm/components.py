"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framepair.llm.common import materialise, splittable


def large_star(edges: DataFrame) -> DataFrame:
    """Ties every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = splittable(least, "u", F.col("m").isNotNull())
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Ties a node and its smaller neighbours to the least of them. Expects u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    near = edges.join(splittable(least, "u", F.col("m").isNotNull()), "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(u, v)`` for every node but the least of its component, ``v`` being that least node.

    Ids may have any type that orders. A hot node is a skewed side of joins with
    one row per node, which adaptive execution splits; minima are combined before
    they are shuffled. Each round is written to the shared folder, so no lineage
    grows and lost executors cost one round at most.
    """
    edges = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialise(edges, "edges")
    while not stars(edges):
        edges = materialise(small_star(large_star(edges)), "edges")
    return edges


def stars(edges: DataFrame) -> bool:
    """Whether every node has one edge at most towards a smaller node, which has none itself."""
    up = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    centres = edges.select(F.col("v").alias("u")).distinct()
    return up.join(centres.withColumn("c", F.lit(True)), "u", "left").where((F.col("n") > 1) | F.col("c")).isEmpty()
