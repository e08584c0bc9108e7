"""Connected components of a link table by contraction, on distributed tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlens.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links (a, b)``; the root is the smallest node met.

    Every round points each node to its smallest neighbour below it, follows the pointers
    to their ends by doubling, and goes on with the links between the ends. Nodes without
    a smaller neighbour stay, so a round leaves at most half of the linked nodes. Tables
    are written to the shared folder after each step: a lost executor costs one step.
    """
    edges = staged(links.select("a", "b").where("a <> b").distinct())
    roots = staged(
        edges.select(F.col("a").alias("node"))
        .union(edges.select("b"))
        .distinct()
        .withColumn("root", F.col("node"))
    )
    while not edges.isEmpty():
        ends = staged(_ends(_parents(edges)))
        moved = ends.select(F.col("node").alias("root"), F.col("end"))
        roots = staged(
            roots.join(moved, "root", "left").select(
                "node", F.coalesce("end", "root").alias("root")
            )
        )
        left = ends.select(F.col("node").alias("a"), F.col("end").alias("__a"))
        right = ends.select(F.col("node").alias("b"), F.col("end").alias("__b"))
        edges = staged(
            edges.join(left, "a")
            .join(right, "b")
            .where(F.col("__a") != F.col("__b"))
            .select(F.col("__a").alias("a"), F.col("__b").alias("b"))
            .distinct()
        )
    return roots


def _parents(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    lowest = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
    return lowest.select("node", F.least("node", "low").alias("end"))


def _ends(parents: DataFrame) -> DataFrame:
    """Pointer doubling until every pointer leads to a node that points to itself."""
    now = staged(parents)
    while True:
        next_ = now.select(F.col("node").alias("end"), F.col("end").alias("__end"))
        far = staged(now.join(next_, "end").select("node", F.col("end").alias("old"), F.col("__end").alias("end")))
        if far.where(F.col("old") != F.col("end")).isEmpty():
            return far.select("node", "end")
        now = far.select("node", "end")
