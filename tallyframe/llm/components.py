"""Connected components of an undirected edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links a node's greater (large) or lesser (small) neighbours to the least of its neighbourhood; the node itself too."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    seen = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = seen.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    if large:
        linked = seen.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        linked = seen.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return linked.filter("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b: long, not null); component is the least node reachable.

    The steps end in stars around the least nodes, after about the logarithm of the longest chain; each is written to
    the shared folder. Aggregations combine before they shuffle, so a node with very many links costs no single task
    more than its share. Repeated edges, loops and an empty table are allowed.
    """
    now = stage(edges.select("a", "b").filter("a != b").distinct(), "edges")
    mark = None
    while True:
        now = stage(_star(_star(now, True), False), "stars")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if new == mark or not new[0]:
            break
        mark = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
