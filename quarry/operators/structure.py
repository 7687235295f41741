"""Chunks along a file's structure, and what lies within them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators import focus, units

#: Characters of a gram by which names are looked up.
GRAM = 3


def structural_chunks(files: DataFrame, spans: DataFrame, least: int = 50, check: bool = False) -> DataFrame:
    """Units (file_path, kind, name, start_line, end_line) of ``least`` lines or more as chunks with content; with
    ``check``, those whose content doesn't parse as Python are left out."""
    big = spans.where(F.col("end_line") - F.col("start_line") >= least)
    out = focus.sliced(big, files)
    return out.where(units.valid_python(F.col("content"))) if check else out


def contained(chunks: DataFrame, inner: DataFrame) -> DataFrame:
    """file_path, start_line, end_line of each chunk with the sorted names of the units that lie wholly within it."""
    c = chunks.select("file_path", F.col("start_line").alias("a"), F.col("end_line").alias("b"))
    within = c.join(inner, "file_path").where((F.col("start_line") >= F.col("a")) & (F.col("end_line") <= F.col("b")))
    names = within.groupBy("file_path", "a", "b").agg(F.array_sort(F.collect_set("name")).alias("names"))
    return names.select("file_path", F.col("a").alias("start_line"), F.col("b").alias("end_line"), "names")


def mentioned(functions: DataFrame, findings: DataFrame) -> DataFrame:
    """Functions whose name stands anywhere in some finding's description, within a longer word too.

    A name without white space lies within one run of other characters, so only the distinct runs are searched. Each name
    is looked up by one of its grams of ``GRAM`` characters (a shorter name is its own), the one that the fewest runs hold,
    and what that finds is verified; a semi join stops at a name's first. Runs are told once for each of their grams, a
    number that follows their length. Names that are null, empty or hold white space are not found.
    """
    words = findings.select(F.explode(F.array_distinct(F.split("description", r"\s+"))).alias("w")).where("w <> ''").distinct()
    names = functions.where(r"name <> '' and not name rlike '\\s'").select("name").distinct()
    sizes = names.agg(F.array_sort(F.collect_set(F.least(F.length("name"), F.lit(GRAM)))).alias("sizes"))  # one row, GRAM numbers at most

    def grams(text: str, sizes: Column) -> Column:
        fit = F.filter(sizes, lambda k: k <= F.length(text))
        return F.array_distinct(F.flatten(F.transform(fit, lambda k: F.transform(F.sequence(F.lit(1), F.length(text) - k + 1), lambda i: F.substring(text, i, k)))))

    held = words.crossJoin(F.broadcast(sizes)).select("w", F.explode(grams("w", F.col("sizes"))).alias("gram"))
    asked = names.select("name", F.explode(grams("name", F.array(F.least(F.length("name"), F.lit(GRAM))))).alias("gram"))
    # a gram that no run holds rules its name out
    counted = asked.join(held.groupBy("gram").agg(F.count("*").alias("n")), "gram", "left").groupBy("name").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("m"))
    keyed = counted.where("m.n > 0").select("name", F.col("m.gram").alias("gram"))
    found = keyed.join(held, (keyed["gram"] == held["gram"]) & F.contains("w", "name"), "left_semi")
    return functions.join(found.select("name"), "name", "left_semi")


def complexity_metrics(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """file_path, functions, classes, lines, units_per_line."""
    n = lines.groupBy("file_path").agg(F.count("*").alias("lines"))
    u = spans.groupBy("file_path").agg(F.count_if(F.col("kind") == "function").alias("functions"), F.count_if(F.col("kind") == "class").alias("classes"))
    told = n.join(u, "file_path", "left").fillna(0, ["functions", "classes"])
    return told.withColumn("units_per_line", (F.col("functions") + F.col("classes")) / F.greatest("lines", F.lit(1)))
