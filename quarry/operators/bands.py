"""Joins of lines and spans of a file by equality on bands of lines, for files and chunks of any length.

A span is told once for each band of ``BAND`` lines that it touches, a line lies in one band; so pairs meet by equality on
file and band, a long file's bands lie in many tasks, and no pair is met that is further apart than a band. A pair of spans
is told in one band alone: the one in which the later of the two begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import lines, tokens
from quarry.operators import focus

BAND = 100


def _band(line: Column) -> Column:
    return F.floor(line / BAND)


def banded(spans: DataFrame, start: str = "start_line", end: str = "end_line") -> DataFrame:
    """``spans`` once for each band that they touch, with _band; a span that ends before it starts touches none."""
    some = F.when(F.col(end) >= F.col(start), F.sequence(_band(F.col(start)), _band(F.col(end))))
    return spans.withColumn("_band", F.explode(some))


def lines_within(spans: DataFrame, points: DataFrame, line: str, start: str = "start_line", end: str = "end_line") -> DataFrame:
    """Pairs of ``spans`` and of the rows of ``points`` whose line lies within them, in the same file; columns of both, whose
    names but file_path must differ."""
    return banded(spans, start, end).join(points.withColumn("_band", _band(F.col(line))), ["file_path", "_band"]).where(F.col(line).between(F.col(start), F.col(end))).drop("_band")


def overlapping(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of spans of a file that share a line: ``a`` (file_path, start_line, end_line and more) and ``b`` (file_path,
    b_start, b_end and more, of other names)."""
    met = banded(a).join(banded(b, "b_start", "b_end"), ["file_path", "_band"])
    own = F.col("_band") == _band(F.greatest("start_line", "b_start"))
    return met.where(own & (F.col("start_line") <= F.col("b_end")) & (F.col("b_start") <= F.col("end_line"))).drop("_band")


def focus_chunks(files: DataFrame, findings: DataFrame, context: int = focus.CONTEXT, order: list[str] | None = None) -> DataFrame:
    """What ``focus.focus_chunks`` tells, from rows of lines: no row holds more of a file than its own text on the way in and
    one chunk on the way out, and findings meet their chunks band by band, so a file of a million lines and as many findings
    takes many tasks. ``focus.focus_chunks`` shuffles less where files are short.

    Scores are null for a chunk in which no finding starts; findings of no known file are left out.
    """
    marked = focus.islands(findings, 2 * context, order)
    zone = focus.zones(marked, focus.line_counts(files), context)
    zone = zone.withColumn("chunk_id", focus.chunk_id("file_path", "start_line", "end_line"))
    spans = zone.select("file_path", "island", "start_line", "end_line")
    # only lines in some zone are kept; where zones are few, Spark sends them to the lines instead
    within = lines_within(spans, lines(files.select("file_path", "content")), "line_no")
    text = within.groupBy("file_path", "island").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("content"))
    scores = focus.chunk_scores(focus.associated(zone, findings))
    told = zone.join(text, ["file_path", "island"], "left").withColumn("content", F.coalesce("content", F.lit(""))).join(scores, "chunk_id", "left")
    return told.withColumns({
        "token_count": tokens(F.col("content")), "character_count": F.length("content").cast("long"), "line_count": F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0)).cast("long"),
    })


def with_context(chunks: DataFrame, units: DataFrame) -> DataFrame:
    """``chunks`` (file_path, start_line, end_line and more) with units, the sorted names of the units (file_path, kind,
    name, start_line, end_line) that share a line with them, functions and classes, how many of either; none: empty, 0."""
    named = units.select("file_path", F.col("start_line").alias("b_start"), F.col("end_line").alias("b_end"), F.col("kind").alias("_kind"), F.col("name").alias("_name"))
    keys = ["file_path", "start_line", "end_line"]
    met = overlapping(chunks.select(*keys).distinct(), named).groupBy(*keys).agg(
        F.array_sort(F.collect_set("_name")).alias("units"), F.count_if(F.col("_kind") == "function").alias("functions"), F.count_if(F.col("_kind") == "class").alias("classes"))
    none = F.array().cast("array<string>")
    return chunks.join(met, keys, "left").withColumns({"units": F.coalesce("units", none), "functions": F.coalesce("functions", F.lit(0).cast("long")), "classes": F.coalesce("classes", F.lit(0).cast("long"))})
