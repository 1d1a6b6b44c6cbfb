"""Typed edges: breadth-first search, degrees, supersession chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bfs(edges: DataFrame, seeds: DataFrame, depth: int, per_hop: int | None = None) -> DataFrame:
    """(seed, node, depth): nodes within `depth` hops of each seed, edges taken in both directions. One join a hop; per_hop keeps the newest edges of a hop and seed, as a feature."""
    both = edges.select("src", "dst", "created_at", "edge_id").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "created_at", "edge_id"))
    seen = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth")).distinct()
    front = seen
    for hop in range(1, depth + 1):
        step = front.join(both, front.node == both.src).select("seed", "dst", "created_at", "edge_id")
        if per_hop:
            w = Window.partitionBy("seed").orderBy(F.desc("created_at"), F.desc("edge_id"))
            step = step.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= per_hop)
        new = step.select("seed", F.col("dst").alias("node")).distinct().join(seen.select("seed", "node"), ["seed", "node"], "left_anti")
        front = new.withColumn("depth", F.lit(hop))
        seen = seen.union(front)
    return seen


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def context_scores(edges: DataFrame) -> DataFrame:
    """1 + min(degree / 10, 1) of each node."""
    return degrees(edges).withColumn("score", 1.0 + F.least(F.col("degree") / 10.0, F.lit(1.0)))
