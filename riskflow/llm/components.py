"""Connected components of a table of links, by rounds of joins over the links alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.session import materialise


def components(links: DataFrame) -> DataFrame:
    """Table (node, root): the smallest node that each node of ``links`` (a, b) reaches; nodes without links are absent.

    Alternates two steps on the edges until they are stars: every node hands its larger neighbours to its smallest
    neighbour, then its smaller ones. Each keeps components whole and halves paths; edges never become more than they
    were. A node with many neighbours is a group of narrow rows whose minimum is combined before the shuffle.
    """
    edges = materialise(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links"
    )
    while not _are_stars(edges):
        wide = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = wide.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = wide.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct()
        )
        edges = materialise(small, "links")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether each edge (u, v) leads from a node without others to one that leads nowhere: that is the smallest of its component."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    counted = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    return counted.where("up > 1 OR (up = 1 AND least = 0)").isEmpty()
