"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage


def forest(edges: DataFrame) -> DataFrame:
    """Distinct edges (u, v) with u > v of edges (a, b)."""
    both = edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    return stage(both.distinct(), "components")


def contract(current: DataFrame) -> DataFrame:
    """One large-star and one small-star step on a staged forest: as connected as before, and flatter.

    Every step is an aggregation combined before the shuffle and a join against one row a node; each
    is written to the shared folder, which cuts the lineage. ``current`` is deleted.
    """
    # Large star: every larger neighbour of a node links to the smallest of its neighbourhood.
    around = current.select("u", "v").unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stage(around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "components-least")
    large = stage(around.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "components-large")
    # Small star: a node and its smaller neighbours link to the smallest of them.
    least2 = stage(large.groupBy("u").agg(F.min("v").alias("m")), "components-least")
    joined = large.join(least2, "u")
    small = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least2.select("u", F.col("m").alias("v"))).distinct()
    small = stage(small, "components")
    for done in (least, large, least2, current):
        unstage(done)
    return small


def labels(current: DataFrame, node: str, component: str) -> DataFrame:
    """(node, component): a smaller node that it is connected to, for nodes that have one.

    After one step of contraction nodes of one label are connected, though connected nodes may differ."""
    return current.groupBy(F.col("u").alias(node)).agg(F.min("v").alias(component))


def connected_components(edges: DataFrame, node: str, component: str) -> DataFrame:
    """(node, component) for each node of edges (a, b): the smallest node that it is connected to.

    Contracts the edge list until nothing changes, which takes a logarithmic number of steps.
    """
    current = forest(edges)
    seen = _digest(current)
    while True:
        current = contract(current)
        found = _digest(current)
        if found == seen:
            roots = current.select(F.col("v").alias("u"), "v").distinct()
            return stage(current.unionByName(roots).select(F.col("u").alias(node), F.col("v").alias(component)), "components-found")
        seen = found


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first()
    return tuple(row)
