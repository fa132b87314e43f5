"""Connected components of a graph given as a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import saved


def _large_star(e: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least node of its neighbourhood."""
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("lo")).withColumn("lo", F.least("u", "lo"))
    return e.join(least, "u").select(F.col("lo").alias("u"), "v")


def _small_star(e: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    least = e.groupBy("v").agg(F.min("u").alias("lo"))
    moved = e.join(least, "v").filter("u > lo").select(F.col("lo").alias("u"), F.col("u").alias("v"))
    return moved.union(least.select(F.col("lo").alias("u"), "v"))


def _signature(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of a link; root is the least node of its component.

    Nodes are longs. Links may be repeated, in either direction, or join a node with itself (ignored). Links with a
    null end are ignored. The work grows with the links; rounds grow with the logarithm of the nodes. Every round is a
    table in the shared folder, so a lost executor costs one round at most.
    """
    ends = links.filter(F.col(a) != F.col(b))
    e = saved(ends.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct(), "links")
    seen = _signature(e)
    while seen[0]:
        e = saved(_small_star(_large_star(e).distinct()).distinct(), "stars")
        now = _signature(e)
        if now == seen:
            break
        seen = now
    roots = e.groupBy(F.col("u").alias("node")).agg(F.first("u").alias("root"))
    return e.select(F.col("v").alias("node"), F.col("u").alias("root")).union(roots)
