"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import drop_staged, staged


def _toward_minimum(pairs: DataFrame, keep: str) -> DataFrame:
    """(node, other) rows to edges from the others that ``keep`` holds for to the least of node and all others."""
    least = pairs.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least"))
    moved = pairs.filter(keep).join(least, "node").select(F.col("other").alias("a"), F.col("least").alias("b"))
    return moved.filter("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b) edges to (node, component): the smallest node reachable.  Nodes without edges have no row.

    Every step is a grouped minimum and a join on the node; each round is written, and rounds end
    when the edges stay as they are, which are then stars around the smallest nodes.  Rounds grow with
    the logarithm of the longest path; edges that ``most_rounds`` do not settle raise an error.
    """
    now = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        both = now.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(now.select(F.col("b").alias("node"), F.col("a").alias("other")))
        large = _toward_minimum(both, "other > node")
        down = large.select(F.col("a").alias("node"), F.col("b").alias("other"))
        itself = down.select("node", F.col("node").alias("other")).distinct()
        after = staged(_toward_minimum(down.unionByName(itself), "true"), "edges")
        found = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        drop_staged(now)
        now = after
        if (found.n, found.h) == mark:
            break
        mark = (found.n, found.h)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    stars = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
