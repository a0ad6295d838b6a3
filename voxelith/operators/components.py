"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import cut, drop


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def stars(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b) for each node a of edges that isn't the smallest of its component, b the smallest.

    Minima are partial aggregates and meet the edges in joins that Spark can
    split, so a node with very many neighbours is not one task. Each round ends
    in a written table. Loops, nulls and repeated edges are left out.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "components")
    mark = _mark(now)
    for _ in range(most_rounds):
        both = _both(now)
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        now, last = cut(small, "components"), now
        drop(last)
        mark, before = _mark(now), mark
        if mark == before:
            return now
    raise RuntimeError("components did not settle")


def component_of(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """nodes with root, the smallest node that edges (a, b) reach from each; a node without edges is its own."""
    tree = stars(edges)
    return nodes.join(tree.select(F.col("a").alias(node), F.col("b").alias("root")), node, "left").withColumn("root", F.coalesce("root", node))
