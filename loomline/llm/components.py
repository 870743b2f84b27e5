"""Connected components of a table of links, by repeated contraction of both ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import checkpointed


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b); root is one node of its component, the same for all.

    Each round points every node at the least of its neighbours and itself, follows the pointers to
    their ends, and replaces the ends of each link; links within one point vanish. The number of
    points at least halves each round. Nothing is gathered on the driver but counts; a node with very
    many links is reduced by partial minima.
    """
    links = checkpointed(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    labels = checkpointed(nodes.select("node", F.col("node").alias("root")))
    while not links.isEmpty():
        both = links.select(F.col("b").alias("x"), F.col("a").alias("y")).union(links.select("a", "a")).union(links.select("b", "b"))
        points = checkpointed(both.groupBy("x").agg(F.min("y").alias("p")))
        while True:  # the depth of the pointers halves each time
            ends = points.select(F.col("x").alias("p"), F.col("p").alias("q"))
            jumped = checkpointed(points.join(ends, "p").select("x", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")))
            points, moved = jumped.select("x", "p"), jumped.where("moved")
            if moved.isEmpty():
                break
        ends = points.withColumnsRenamed({"x": "root", "p": "new"})
        labels = checkpointed(labels.join(ends, "root", "left").select("node", F.coalesce("new", "root").alias("root")))
        a, b = points.withColumnsRenamed({"x": "a", "p": "pa"}), points.withColumnsRenamed({"x": "b", "p": "pb"})
        moved = links.join(a, "a").join(b, "b").where("pa <> pb")
        links = checkpointed(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    return labels
