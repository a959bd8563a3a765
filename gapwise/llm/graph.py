"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long); the component is one of its nodes.

    Each round every node takes the least node of its neighbourhood as its
    parent, parents are followed two steps further, and what is left of the
    edges between parents is the next round's graph. Nodes are hashes, so their
    order is random and the graph shrinks by a constant factor a round; a star
    of any size is done in one. Only groupings with partial aggregation and
    joins that AQE can split touch a node with many neighbours. Rounds are cut
    by reliable checkpoints, nothing is collected.
    """
    rounds: list[DataFrame] = []
    edges = cut(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("up"))
        for _ in range(2):
            over = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            up = up.join(over, "up").select("node", F.col("top").alias("up"))
        up = cut(up)
        rounds.append(up)
        left = up.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        right = up.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        edges = edges.join(left, "a").join(right, "b").where(F.col("ua") != F.col("ub"))
        edges = cut(edges.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct())
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = rounds[0]
    for up in rounds[1:]:
        out = out.join(up.select(F.col("node").alias("up"), F.col("up").alias("top")), "up", "left").select("node", F.coalesce("top", "up").alias("up"))
    return cut(out.select("node", F.col("up").alias("component")))
