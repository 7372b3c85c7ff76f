"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.scratch import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Join every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("of")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Join every smaller neighbour of a node, and the node, to the least of them; u > v in what comes in and goes out."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), "m")
    near = edges.join(least, F.col("u") == F.col("of")).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.union(least.select(F.col("of").alias("u"), F.col("m").alias("v"))).distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """``node`` and ``component``, the smallest node that links reach, for every node with a link to another.

    Each round is two aggregates and two joins over the links, written to the shared folder;
    only a count and a sum of hashes come to the driver.  Links may repeat, in either
    direction; a link to itself is none.
    """
    edges = links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where(F.col("u") != F.col("v")).distinct()
    edges = written(edges, "links")
    seen = _digest(edges)
    while True:
        edges = written(_small_star(_large_star(edges)), "stars")
        now = _digest(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
