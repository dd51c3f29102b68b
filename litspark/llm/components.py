"""Connected components of an edge table, by alternating large and small stars.

Each step maps every edge of a node to the smallest neighbour; a fixed number of
shuffles per step, no edge list leaves the executors and a hub's edges are
joined, never collected. Steps end in checkpoints, so the plan stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspark.llm.common import checkpointed


#: Edges that one task handles.
TASK_EDGES = 200_000


def _large_star(edges: DataFrame, parts: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(parts)
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(parts)
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(parts)


def _small_star(edges: DataFrame, parts: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts)
    moved = edges.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    moved = moved.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).coalesce(parts).distinct().coalesce(parts)


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: bigint) that is not the
    smallest of its component; root is the smallest. Tasks are as many as the
    edges need."""
    edges = checkpointed(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _print(edges)
    while seen[0]:
        parts = 1 + seen[0] // TASK_EDGES
        edges = checkpointed(_small_star(_large_star(edges.coalesce(parts), parts), parts))
        now = _print(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
