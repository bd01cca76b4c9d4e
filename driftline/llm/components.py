"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def _least(edges: DataFrame) -> DataFrame:
    """Each node with its smallest neighbour, itself included.  ``edges`` is (u, v); the hot nodes' rows meet as partial minima."""
    # written out, so that a join with it can split a node with many neighbours
    return cut(edges.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least")), "least")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    met = both.join(_least(both), "u")
    return met.filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    met = down.join(least, "u")
    others = met.filter("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return others.unionByName(least.select("u", F.col("least").alias("v"))).filter("u <> v").distinct()


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Every child has one parent, and no parent is a child."""
    if not edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return False
    return edges.select(F.col("v").alias("u")).distinct().join(edges.select("u"), "u", "left_semi").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every node of ``links`` (a, b); the component is its smallest node.

    Null ends and loops are no links.  A round halves the longest path at least, so the rounds
    grow with the logarithm of the largest component.
    """
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v").distinct()
    edges = cut(_small_star(edges), "stars")
    while not _is_forest_of_stars(edges):
        edges = cut(_small_star(_large_star(edges)), "stars")
    roots = edges.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
