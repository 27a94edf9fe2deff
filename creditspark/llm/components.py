"""Connected components of links, by alternating large and small stars (Kiveris et al., 2014) in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import kept


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), u > v. Large: every larger neighbour of a node moves to the node's least neighbour; small: the node and its smaller ones."""
    if large:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame, a: str, b: str, max_rounds: int = 100) -> DataFrame:
    """(node, component): the least node that each linked node reaches; nodes without links are not listed.

    Each round is kept on the executors' disks, which cuts the lineage; rounds grow with the logarithm of the longest chain.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") != F.col("v")).distinct()
    seen = None
    for _ in range(max_rounds):
        edges = kept(edges)
        state = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = state
        edges = _star(_star(edges, True), False)
    raise RuntimeError(f"links did not settle in {max_rounds} rounds")
