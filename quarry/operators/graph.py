"""Reachability over an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.durable import written


def dependencies(edges: DataFrame, start: DataFrame, depth: int, reverse: bool = False) -> DataFrame:
    """node_id, depth of the nodes reached from ``start`` (node_id) in ``depth`` steps at most, the start left out.

    ``reverse`` follows edges backwards. Each step joins the newest nodes alone, and a node keeps its first depth. Steps
    are written, as each refers to all before it; the walk ends early when nothing is new.
    """
    a, b = ("to_id", "from_id") if reverse else ("from_id", "to_id")
    step = edges.select(F.col(a).alias("node_id"), F.col(b).alias("next_id"))
    newest = seen = written(start.select("node_id", F.lit(0).alias("depth")).distinct())
    for k in range(1, depth + 1):
        found = newest.join(step, "node_id").select(F.col("next_id").alias("node_id")).distinct()
        newest = written(found.join(seen.select("node_id"), "node_id", "left_anti").select("node_id", F.lit(k).alias("depth")))
        if newest.isEmpty():
            break
        seen = seen.union(newest)
    return seen.where("depth > 0")


def upserted(nodes: DataFrame) -> DataFrame:
    return nodes.dropDuplicates(["node_id"])
