"""Ordered folds over a file's lines or chunks, where each step depends on what the step before has put out.

They run as one aggregate over an array within a row, in the JVM; the array is a single file's. Closed spans are put
out in runs, so that a step copies a run of bounded length and not all that went before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import line_array, tokens

_SPAN = "struct<start_line:int,end_line:int,tokens:bigint>"
#: Closed spans in a run.
RUN = 512


def _fold(items: Column, step) -> Column:
    """Array of spans: ``step(last, item)`` tells whether an item joins the last span."""
    none = F.struct(F.array().cast(f"array<array<{_SPAN}>>").alias("runs"), F.array().cast(f"array<{_SPAN}>").alias("run"), F.lit(None).cast(_SPAN).alias("last"))

    def state(runs: Column, run: Column, last: Column) -> Column:
        return F.struct(runs.alias("runs"), run.alias("run"), last.cast(_SPAN).alias("last"))

    def merge(a: Column, x: Column) -> Column:
        last = a["last"]
        joined = F.struct(last["start_line"].alias("start_line"), F.greatest(last["end_line"], x["end_line"]).alias("end_line"), (last["tokens"] + x["tokens"]).alias("tokens"))
        full, closed = F.size(a["run"]) >= RUN, F.array(last)
        runs = F.when(full, F.concat(a["runs"], F.array(a["run"]))).otherwise(a["runs"])
        run = F.when(full, closed).otherwise(F.concat(a["run"], closed))
        return F.when(last.isNull(), state(a["runs"], a["run"], x)).when(step(last, x), state(a["runs"], a["run"], joined)).otherwise(state(runs, run, x))

    def finish(a: Column) -> Column:
        return F.when(a["last"].isNull(), a["run"]).otherwise(F.concat(F.flatten(a["runs"]), a["run"], F.array(a["last"])))

    return F.aggregate(items, none, merge, finish)


def _line_spans(content: Column) -> Column:
    return F.transform(line_array(content), lambda x, k: F.struct((k + 1).cast("int").alias("start_line"), (k + 1).cast("int").alias("end_line"), tokens(x).alias("tokens")))


def packed_lines(files: DataFrame, budget: int) -> DataFrame:
    """file_path, part (from 1), start_line, end_line, tokens: lines packed greedily, a new part where the budget would break.

    A file without lines has no part.
    """
    spans = _fold(_line_spans(F.col("content")), lambda last, x: last["tokens"] + x["tokens"] <= budget)
    return files.select("file_path", F.posexplode(spans).alias("k", "s")).select("file_path", (F.col("k") + 1).alias("part"), "s.*")


def merged_small(chunks: DataFrame, most: int, least: int, gap: int = 3) -> DataFrame:
    """file_path, start_line, end_line, tokens: neighbouring chunks merged while they lie ``gap`` lines apart at most,
    fit ``most`` tokens together, and one of the two has fewer than twice ``least``."""
    items = F.array_sort(F.collect_list(F.struct(F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), F.col("tokens").cast("long").alias("tokens"))))

    def step(last: Column, x: Column) -> Column:
        return (x["start_line"] - last["end_line"] <= gap) & (last["tokens"] + x["tokens"] <= most) & ((last["tokens"] < 2 * least) | (x["tokens"] < 2 * least))

    return chunks.groupBy("file_path").agg(items.alias("i")).select("file_path", F.explode(_fold(F.col("i"), step)).alias("s")).select("file_path", "s.*")


def coalesced(chunks: DataFrame, share: float = 0.3) -> DataFrame:
    """Chunks of a file merged while the next overlaps the last by over ``share`` of the shorter one."""
    items = F.array_sort(F.collect_list(F.struct(F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), F.col("tokens").cast("long").alias("tokens"))))

    def step(last: Column, x: Column) -> Column:
        common = F.least(last["end_line"], x["end_line"]) - x["start_line"] + 1
        shorter = F.least(last["end_line"] - last["start_line"], x["end_line"] - x["start_line"]) + 1
        return (common > 0) & (common > share * shorter)

    return chunks.groupBy("file_path").agg(items.alias("i")).select("file_path", F.explode(_fold(F.col("i"), step)).alias("s")).select("file_path", "s.*")


def logical_blocks(files: DataFrame, most: int = 100, reach: int = 10) -> DataFrame:
    """file_path, start_line, end_line: blocks of a third of the file, ``most`` lines at most, each drawn out by up to
    ``reach`` lines to end at a blank or comment line."""
    soft = F.transform(line_array(F.col("content")), lambda x: x.rlike(r"^\s*(#|//|$)"))
    told = files.select("file_path", soft.alias("soft")).where(F.size("soft") > 0)
    n = F.size("soft")
    told = told.select("file_path", "soft", n.alias("n"), F.greatest(F.lit(1), F.least(F.lit(most), F.floor(n / 3).cast("int"))).alias("size"))
    none = F.struct(F.array().cast("array<struct<start_line:int,end_line:int>>").alias("out"), F.lit(1).alias("start"))

    # a line closes its block if it is the last, or lies a block's size on and is soft, or the reach ends
    def merge(a: Column, x: Column) -> Column:
        far = x["k"] - a["start"] + 1
        end = (x["k"] == F.col("n")) | ((far >= F.col("size")) & (x["soft"] | (far >= F.col("size") + reach)))
        block = F.struct(a["start"].alias("start_line"), x["k"].alias("end_line"))
        return F.when(end, F.struct(F.concat(a["out"], F.array(block)).alias("out"), (x["k"] + 1).alias("start"))).otherwise(a)

    items = F.transform("soft", lambda x, k: F.struct((k + 1).cast("int").alias("k"), x.alias("soft")))
    return told.select("file_path", F.explode(F.aggregate(items, none, merge, lambda a: a["out"])).alias("b")).select("file_path", "b.*")


def merged_related(chunks: DataFrame, gap: int = 3, shared: int = 2) -> DataFrame:
    """file_path, start_line, end_line, members, deps (sorted): a file's chunks merged by nearness or by what they depend on.

    ``chunks``: file_path, start_line, end_line, deps (array of names; null counts as empty). In the order of their lines,
    each chunk joins the first group so far whose end lies at most ``gap`` lines from its start, or that shares ``shared``
    names with it at least; a group grows by the chunk's lines and names. Groups thus need not be of neighbours. One fold
    for each file; its state holds the file's groups.
    """
    none = F.array().cast("array<string>")
    deps = F.array_sort(F.array_distinct(F.filter(F.coalesce(F.col("deps"), none), lambda x: x.isNotNull())))
    item = F.struct(F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), deps.alias("deps"))
    start = F.array().cast("array<struct<start_line:int,end_line:int,deps:array<string>,members:int>>")

    def group(a: Column, b: Column, names: Column, n: Column) -> Column:
        return F.struct(a.alias("start_line"), b.alias("end_line"), names.alias("deps"), n.cast("int").alias("members"))

    def step(groups: Column, x: Column) -> Column:
        related = lambda g: (F.abs(g["end_line"] - x["start_line"]) <= gap) | (F.size(F.array_intersect(g["deps"], x["deps"])) >= shared)
        at = F.array_position(F.transform(groups, related), F.lit(True))
        grown = lambda g: group(F.least(g["start_line"], x["start_line"]), F.greatest(g["end_line"], x["end_line"]), F.array_sort(F.array_union(g["deps"], x["deps"])), g["members"] + 1)
        joined = F.transform(groups, lambda g, k: F.when(k == at - 1, grown(g)).otherwise(g))
        return F.when(at > 0, joined).otherwise(F.concat(groups, F.array(group(x["start_line"], x["end_line"], x["deps"], F.lit(1)))))

    own = chunks.groupBy("file_path").agg(F.array_sort(F.collect_list(item)).alias("i"))
    return own.select("file_path", F.explode(F.aggregate("i", start, step)).alias("g")).select("file_path", "g.start_line", "g.end_line", "g.members", "g.deps")
