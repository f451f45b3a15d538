"""Connected components by alternating large-star and small-star, on DataFrames.

Each step takes the smallest neighbour by a grouped minimum, which is pre-aggregated, and writes it as a
table of one row a node; the join that brings it back to the edges then reads both sides from fresh
exchanges, which AQE can split where one node has very many links (it can't above an aggregate). Edges
never leave the cluster. The steps end when the edges are stars, which two small queries tell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch


def _large_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Every larger neighbour v of u is linked to the least of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    linked = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return scratch.table(linked.where("u != v").distinct(), edges, least)


def _small_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """u (the larger end of each edge) and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = scratch.table(down.groupBy("u").agg(F.min("v").alias("m")))
    across = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    linked = across.unionByName(least.select("u", F.col("m").alias("v")))
    return scratch.table(linked.where("u != v").distinct(), edges, least)


def _are_stars(edges: DataFrame) -> bool:
    """Whether every larger end u has one edge and no smaller end v is a larger end elsewhere.

    The driver sees two counts and one bit."""
    ends = edges.groupBy("u").agg(F.count("*").alias("c"))
    if not ends.where("c > 1").isEmpty():
        return False
    return edges.select(F.col("v").alias("u")).distinct().join(edges.select("u"), "u", "left_semi").isEmpty()


def components(edges: DataFrame, scratch: Scratch, drop_input: bool = False) -> DataFrame:
    """(u, v): each node that has a link, save the least of its component, and that least node.

    Takes edges (u, v) in any direction; self-links, repeats and nulls don't count.
    """
    source = edges
    edges = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = scratch.table(edges, *([source] if drop_input else []))
    while not _are_stars(edges):
        edges = _small_star(_large_star(edges, scratch), scratch)
    return edges
