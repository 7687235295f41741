"""Connected components by alternating large and small stars, a written table for each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._shared import removed, written


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node gets linked to the node's least neighbour."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours get linked to the least of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.bit_xor(F.xxhash64("b", "a"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node bigint, root bigint (the component's least node) for every node of ``edges`` (a, b) that isn't a root itself.

    Loops and repeated edges don't matter. Neither links nor components pass through the driver, but for two sums a
    round; a hub's links are never gathered: its least neighbour is an aggregate, and Spark may split the join.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(edges)
    while mark[0]:
        old, edges = edges, written(_small(_large(edges)))
        removed(old)
        before, mark = mark, _mark(edges)
        if before == mark:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def one_of_each(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """``documents`` (doc_id, text and more) with one row of each group: the least by doc_id (null last), then by text.

    ``rows``: doc_id, th (``xxhash64`` of the text) and root, the group, of each row of ``documents``. Equal ids with
    different texts are different rows; of rows that agree in both any one stays.
    """
    rows = written(rows)
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    least = written(rows.groupBy("root").agg(F.min(row).alias("least"), F.count("*").alias("n")))
    # roots that hold over a thousandth of the rows, a thousand at most, go to the rows instead of gathering them
    all_rows = least.agg(F.sum("n")).first()[0] or 0
    large = F.col("n") * 1000 > all_rows
    hot = F.broadcast(least.where(large).select("root", "least"))
    few = rows.join(hot.select("root"), "root", "left_anti").join(least.where(~large).select("root", "least"), "root")
    gone = few.unionByName(rows.join(hot, "root")).where(~row.eqNullSafe(F.col("least"))).select(F.col("doc_id").alias("__id"), F.col("th").alias("__hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    kept = documents.join(gone, same, "left_anti")
    again = written(least.join(rows.groupBy(row.alias("least")).count().where("count > 1"), "least").select(F.col("least.doc_id").alias("__id"), F.col("least.th").alias("__hash")))
    if again.isEmpty():
        return kept
    whole = F.struct(*[F.col(c) for c in documents.columns])
    one = kept.join(again, same).groupBy("__id", "__hash").agg(F.first(whole).alias("__row")).select("__row.*")
    return kept.join(again, same, "left_anti").unionByName(one)
