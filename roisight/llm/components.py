"""Connected components by alternating star contraction, for graphs of any size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roisight.llm._store import checkpointed


#: Edges that a task takes, about.
TASK_EDGES = 500_000


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Each larger neighbour of a node is tied to the node's least neighbour (or itself)."""
    near = _both(edges)
    least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).coalesce(tasks)
    return near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").coalesce(tasks).distinct()


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Each node and its smaller neighbours are tied to the least of them; edges run from large to small."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).coalesce(tasks)
    joined = edges.join(least, "a")
    tied = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return tied.where("a <> b").coalesce(tasks).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every edge runs from a node that has no other to one that is least of all."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select("b", F.lit(0), F.lit(1)).toDF("node", "up", "down"))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for every node with an edge; the component is its least node.

    Nulls take no part; edges may repeat, point to their own node, or be none.
    """
    e = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    tasks = max(1, math.ceil(e.count() / TASK_EDGES))
    e = e.coalesce(tasks)
    while not _settled(e):
        e = checkpointed(_small_star(_large_star(e, tasks), tasks).coalesce(tasks))
    roots = e.select(F.col("b").alias("node")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
