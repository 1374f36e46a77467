"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflow.llm._shared import drop_written, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node hangs on the smallest node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours hang on the smallest of them. Edges have ``u > v``."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Edges ``(u, v)`` of longs, in any direction, to ``(node, root)``; root is the smallest node reachable.

    Loops, repeats and null ends are ignored; a node without an edge to another node has no row.
    Each round is written to the shared folder, so the plan stays short and a lost executor costs one
    round at most. The number of rounds grows with the logarithm of the longest chain; if
    ``max_rounds`` do not suffice, it raises.
    """
    now = written(
        edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    mark = None
    for _ in range(max_rounds):
        after = written(_small_star(_large_star(now)), "star")
        drop_written(now)
        now = after
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
