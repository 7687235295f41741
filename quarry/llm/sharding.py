"""Shards of nearly equal size in bytes: a minimax contiguous partition of ordered atomic groups.

A group is all rows of equal text (null and empty are one). Groups stand in the order of the text's 64-bit hash; a group
as large as the mean of what is left takes a shard of its own first, largest first, as no cut could part it. The rest is
cut into the shards left at the smallest capacity that they can hold: the capacity is found by binary search, and checked
greedily. Of the cuts that this capacity allows (between the greedy ones from the left and from the right) each is the one
nearest to an equal share.

The search runs on sums of ranges of hashes. Some thousand ranges bound the capacity and the greedy cuts from both sides:
a range of several groups may be cut anywhere at best, and nowhere at worst. Ranges in which a cut may lie are summed
again, 64 times finer, until the bounds meet; that takes a few passes over the groups' hashes and sizes, and the driver
gets sums of ranges alone: 4096, then 64 for each that may hold a cut, some hundreds of them, whatever the number of rows.

Law ``bytes``; ``grown_shard`` is null, since with one more shard all cuts move. Nulls: a null text has no bytes; a null
doc_id is an id like others. Repeated rows are one group and have a slot each. An empty table has no rows; with fewer groups
than shards some shards are empty. Columns other than doc_id and text are not looked at. Texts of equal hash but different
words would be one group: still whole.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm._shared import removed, written

#: Bytes that each row takes besides its text.
OVERHEAD = 8
#: Bits of the hash by which ranges are told first, and how many more at each pass.
FIRST_BITS, MORE_BITS = 12, 6
#: Rows numbered in one window, about.
ROWS = 1 << 16


class Ranges(NamedTuple):
    """Ranges of hashes in order: the first hash, the bits that tell the range, its size, whether it is one group."""

    low: np.ndarray
    bits: np.ndarray
    size: np.ndarray
    single: np.ndarray

    @property
    def edge(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.size)])


def greedy(edge: np.ndarray, single: np.ndarray, capacity: int, shards: int, fluid: bool) -> np.ndarray:
    """Where shards end that are filled up to ``capacity`` one after another; they hold all if the last ends at the end.

    ``edge``: sizes summed up to each range's start, and the whole. ``fluid``: ranges of several groups may be cut anywhere.
    """
    at, out = 0, []
    for _ in range(shards):
        k = int(np.searchsorted(edge, at + capacity, side="right")) - 1
        if k == len(edge) - 1:
            at = int(edge[-1])
        else:
            at = at + capacity if fluid and not single[k] else max(at, int(edge[k]))
        out.append(at)
    return np.array(out, dtype=np.int64)


def least_capacity(edge: np.ndarray, single: np.ndarray, shards: int, fluid: bool) -> int:
    """The smallest capacity with which ``greedy`` holds all, by binary search."""
    low, high = -(-int(edge[-1]) // shards), int(edge[-1])
    while low < high:
        middle = (low + high) // 2
        if greedy(edge, single, middle, shards, fluid)[-1] < edge[-1]:
            low = middle + 1
        else:
            high = middle
    return low


def bounds(ranges: Ranges, shards: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Bounds of the least capacity, and of the places (rows: greedy from the left, from the right, equal shares; columns:
    cuts) that decide on the cuts."""
    edge, single = ranges.edge, ranges.single
    total = int(edge[-1])
    low, high = (least_capacity(edge, single, shards, fluid) for fluid in (True, False))
    back, back_single = total - edge[::-1], single[::-1]
    ideal = np.arange(1, shards) * total // shards
    left = [greedy(edge, single, low, shards, False), greedy(edge, single, high, shards, True)]
    right = [greedy(back, back_single, low, shards, False), greedy(back, back_single, high, shards, True)]
    back_low, back_high = (total - x[:-1][::-1] for x in right)
    return low, high, np.array([left[0][:-1], back_high, ideal]), np.array([left[1][:-1], back_low, ideal])


def open_ranges(ranges: Ranges, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Ranges of several groups in whose inside some place may lie."""
    edge = ranges.edge
    out = np.zeros(len(ranges.size), dtype=bool)
    for a, b in zip(low.ravel(), high.ravel(), strict=True):
        out |= (edge[:-1] < b) & (edge[1:] > a) if a < b else (edge[:-1] < a) & (edge[1:] > a)
    return out & ~ranges.single


def cuts(ranges: Ranges, shards: int, capacity: int) -> np.ndarray:
    """Places of the cuts: within the greedy ones from both sides, nearest to equal shares."""
    edge = ranges.edge
    total = int(edge[-1])
    latest = greedy(edge, ranges.single, capacity, shards, False)[:-1]
    earliest = total - greedy(total - edge[::-1], ranges.single[::-1], capacity, shards, False)[:-1][::-1]
    out, before = [], 0
    for k in range(shards - 1):
        share = (k + 1) * total // shards
        i = int(np.searchsorted(edge, share))
        near = int(edge[i]) if i == 0 or edge[i] - share < share - edge[i - 1] else int(edge[i - 1])
        far = int(edge[np.searchsorted(edge, before + capacity, side="right") - 1])
        before = max(before, min(max(near, int(earliest[k])), int(latest[k]), far))
        out.append(before)
    return np.array(out, dtype=np.int64)


def _summed(groups: DataFrame, prefixes: np.ndarray | None, bits: int, finer: int) -> Ranges:
    """Sums of the ranges told by ``finer`` bits, of all groups or of those with these prefixes of ``bits`` bits."""
    if prefixes is not None:
        wanted = groups.sparkSession.createDataFrame([(int(x),) for x in prefixes], "prefix long")
        groups = groups.join(F.broadcast(wanted), F.shiftright("h", 64 - bits) == F.col("prefix"), "left_semi")
    told = groups.groupBy(F.shiftright("h", 64 - finer).alias("p")).agg(F.sum("size").alias("size"), (F.min("h") == F.max("h")).alias("single"))
    rows = told.toPandas()  # at most 2^FIRST_BITS ranges, then 2^MORE_BITS for each that may hold a cut
    p = rows["p"].to_numpy(dtype=np.int64)
    order = np.argsort(p)
    low = p[order] << np.int64(64 - finer)
    return Ranges(low, np.full(len(p), finer), rows["size"].to_numpy(dtype=np.int64)[order], rows["single"].to_numpy(dtype=bool)[order])


def _searched(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The least capacity of ``shards`` shards and the first hashes of all shards but the first."""
    ranges = _summed(groups, None, 0, FIRST_BITS)
    while True:
        low, high, a, b = bounds(ranges, shards)
        wanted = open_ranges(ranges, a, b)
        if not wanted.any():
            break
        parts = [Ranges(*[x[~wanted] for x in ranges])]
        for bits in np.unique(ranges.bits[wanted]).tolist():
            prefixes = ranges.low[wanted & (ranges.bits == bits)] >> np.int64(64 - bits)
            parts.append(_summed(groups, prefixes, bits, min(bits + MORE_BITS, 64)))
        both = [np.concatenate(x) for x in zip(*parts, strict=True)]
        order = np.argsort(both[0])
        ranges = Ranges(*[x[order] for x in both])
    places = cuts(ranges, shards, high)
    k = np.searchsorted(ranges.edge, places)
    last = np.iinfo(np.int64).max
    return high, [int(ranges.low[x]) if x < len(ranges.low) else last + 1 for x in k.tolist()]


def _alone(groups: DataFrame, shards: int) -> list[int]:
    """Hashes of the groups that take a shard of their own, largest first; fewer than ``shards``."""
    total = groups.agg(F.sum("size")).first()[0] or 0
    out: list[int] = []
    for h, size in groups.orderBy(F.desc("size"), "h").limit(shards - 1).select("h", "size").collect():
        if size * (shards - len(out)) < total:
            break
        out.append(h)
        total -= size
    return out


def _rows(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"))


def _plan(rows: DataFrame, shards: int) -> Column:
    """The shard of a row by its hash ``h``."""
    groups = written(rows.groupBy("h").agg(F.sum("size").alias("size")))
    alone = _alone(groups, shards)
    rest = groups.where(~F.col("h").isin(alone)) if alone else groups
    left = shards - len(alone)
    starts = _searched(rest, left)[1] if left > 1 and not rest.isEmpty() else []
    removed(groups)
    shard = F.lit(len(alone))
    for start in starts:
        if start < 1 << 63:
            shard = shard + (F.col("h") >= F.lit(start)).cast("int")
    for k, h in enumerate(alone):
        shard = F.when(F.col("h") == F.lit(h), k).otherwise(shard)
    return shard.cast("int")


def assigned(documents: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row; slots of a shard count from 0 without gaps.

    Rows alike in all these are told once with their number and numbered together, in buckets of some 65,536 rows, so
    neither a shard nor a crowd of copies meets in one task.
    """
    rows = written(_rows(documents))
    n = rows.count()
    buckets = -(-n // ROWS) or 1
    alike = rows.groupBy("doc_id", "size", "text_crc32", "h").agg(F.count("*").alias("n"))
    told = written(alike.withColumns({"shard": _plan(rows, shards), "bucket": F.pmod(F.xxhash64("doc_id", "h"), F.lit(buckets))}))
    removed(rows)
    of_shard = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = told.groupBy("shard", "bucket").agg(F.sum("n").alias("m")).withColumn("ahead", F.coalesce(F.sum("m").over(of_shard), F.lit(0))).drop("m")
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "h", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    first = told.withColumn("first", F.coalesce(F.sum("n").over(within), F.lit(0))).join(ahead, ["shard", "bucket"])
    each = first.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return each.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("ahead") + F.col("first") + F.col("k")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def stored(documents: DataFrame, path: str, shards: int = 24, rows_in_file: int = 1 << 20) -> None:
    """Writes ``documents``, all columns, below ``path``: a folder ``_shard=k`` each, of Parquet files of some
    ``rows_in_file`` rows. Rows are dealt over the writing tasks by shard and doc_id, so a large shard has many files."""
    rows = written(_rows(documents))
    files = F.lit(max(1, -(-rows.count() // rows_in_file)))
    h = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    told = documents.withColumn("h", h) if "h" not in documents.columns else documents.withColumnRenamed("h", "_h").withColumn("h", h)
    out = told.withColumn("_shard", _plan(rows, shards)).drop("h")
    out = out.withColumnRenamed("_h", "h") if "h" in documents.columns else out
    out.repartition("_shard", F.pmod(F.xxhash64("doc_id"), files)).write.partitionBy("_shard").parquet(path)
    removed(rows)
