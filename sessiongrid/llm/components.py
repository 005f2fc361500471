"""Connected components of a graph too large for one machine: alternating stars, a settled table per round."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessiongrid.session import settle


def _stars(links: DataFrame) -> bool:
    """Whether every node has one smaller neighbour that has none itself, or none: then the links are the result."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("v", F.lit(0), F.lit(1)))
    sums = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not sums.agg(F.max((F.col("up") > 1) | (F.col("up") + F.col("down") > 1))).first()[0]


def components(edges: DataFrame, a: str, b: str, settle: Callable[[DataFrame], DataFrame] = settle) -> DataFrame:
    """(node, root): the least node reachable, for every node with an edge to another node.

    Each round links the larger neighbours of every node to its least neighbour, then all its smaller
    neighbours to the least; rounds grow with the logarithm of the component size and end with the first forest of stars, so
    edges that are one already take none. Every round is written
    to the shared folder by ``settle``, so a lost executor costs a part of one round. Null ends and loops are ignored.
    """
    links = settle(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while not _stars(links):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = settle(small.union(lowest.select("u", F.col("m").alias("v"))).distinct())
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
