"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.arrowtools import stored

#: Edges for each task of a round; a round's shuffles have files for each of its tasks.
TASK_EDGES = 20_000


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Each node's larger neighbours point to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(tasks).distinct()


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Each node's smaller neighbours, and the node, point to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).unionByName(moved).coalesce(tasks).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def components(edges: DataFrame) -> DataFrame:
    """u, v -> u, root: the smallest node that each node with an edge is connected to.

    Every round is checkpointed to the shared folder. Rounds stop when a round changes
    nothing; their number grows with the logarithm of the nodes. A round has tasks by its
    number of edges, so few edges leave few files, whatever the session's partitions.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    edges = stored(edges)
    seen = _state(edges)
    while True:
        tasks = 1 + seen[0] // TASK_EDGES
        edges = stored(_small_star(_large_star(edges.coalesce(tasks), tasks).coalesce(tasks), tasks).coalesce(tasks))
        state = _state(edges)
        if state == seen:
            break
        seen = state
    return edges.select("u", F.col("v").alias("root"))
