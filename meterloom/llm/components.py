"""Connected components of a graph given as a table of edges between longs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.llm.common import stored


def _oriented(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return stored(ends.where(F.col("a") < F.col("b")).distinct())


def _jump(parent: DataFrame) -> DataFrame:
    """Replace each parent by its own parent, where it has one."""
    up = parent.select(F.col("b").alias("a"), F.col("a").alias("up"))
    return parent.join(up, "a", "left").select("b", F.coalesce("up", "a").alias("a"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a long, b long); root is the least node of the component.

    Each round lets every node point to its least neighbour, shortens the paths by two jumps, and contracts the edges
    to what the ends point to. Contracted edges connect exactly the images of connected nodes, so the rounds end when
    no edge is left. Tables of a round are written to the shared folder; nothing but a count of edges reaches the driver.
    """
    edges = _oriented(edges)
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b"))).distinct()
    labels = nodes.select("node", F.col("node").alias("root"))
    while not edges.isEmpty():
        parent = stored(_jump(_jump(edges.groupBy("b").agg(F.min("a").alias("a")))))
        to = parent.select(F.col("b").alias("root"), F.col("a").alias("next"))
        labels = stored(labels.join(to, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        low = edges.join(parent.select(F.col("b").alias("a"), F.col("a").alias("ra")), "a", "left").select("b", F.coalesce("ra", "a").alias("ra"))
        edges = _oriented(low.join(parent.select("b", F.col("a").alias("rb")), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    return labels
