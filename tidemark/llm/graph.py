"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.session import cut_lineage


def dealt(least: DataFrame) -> DataFrame:
    """Takes a node table out of the partitioning of its aggregate: only a join of two
    exchanges is one whose large partitions, the edges of a hub, Spark can split."""
    return least.hint("rebalance")


def large_star(e: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its smallest one."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return both.filter("b > a").join(dealt(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def small_star(e: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest one."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(dealt(least), "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def settled(e: DataFrame) -> bool:
    """Whether every node has one smaller neighbour, a root, or is a root itself."""
    ends = e.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(e.select(F.col("b").alias("node"), F.lit(0).alias("up")))
    seen = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return not seen.filter("ups > 1 or ups = 1 and least = 0").agg(F.count("*")).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component, for every node of an edge (a, b).

    Every round keeps at most as many edges as before; rounds grow with the
    logarithm of the longest chain.  Rounds are cut with checkpoints.  Loops
    and repeated edges are allowed; nodes without an edge are not returned.
    """
    e = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while not settled(e):
        e = cut_lineage(small_star(large_star(e)))
    roots = e.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
