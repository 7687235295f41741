"""Focus zones: islands of findings that lie near each other, the text around them, and what lies between.

Windows run within a file; a file's findings are bounded by its lines times its rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.maps import severity_weight
from quarry.functions.text import line_array, tokens
from quarry.operators import pairs

CONTEXT = 10


def weighted(df: DataFrame) -> Column:
    return severity_weight(F.col("severity")) * F.col("confidence")


def islands(findings: DataFrame, gap: int = 2 * CONTEXT, order: list[str] | None = None) -> DataFrame:
    """``findings`` with island: a new one begins where a finding starts over ``gap`` lines behind the one before."""
    within = Window.partitionBy("file_path").orderBy("start_line", *(order or ["end_line"]))
    end = F.coalesce("end_line", "start_line")
    apart = F.coalesce((F.col("start_line") - F.lag(end).over(within) > gap).cast("int"), F.lit(0))
    marked = findings.withColumn("_apart", apart)
    return marked.withColumn("island", F.sum("_apart").over(within.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_apart")


def zones(marked: DataFrame, line_counts: DataFrame, context: int = CONTEXT) -> DataFrame:
    """file_path, island, start_line, end_line, n_findings, priority of each island, ``context`` lines wider at each end."""
    end = F.coalesce("end_line", "start_line")
    told = marked.groupBy("file_path", "island").agg(
        F.min("start_line").alias("a"), F.max(end).alias("b"), F.count("*").alias("n_findings"), F.least(F.avg(weighted(marked)), F.lit(1.0)).alias("priority"))
    return told.join(line_counts, "file_path").select(
        "file_path", "island", F.greatest(F.lit(1), F.col("a") - context).cast("int").alias("start_line"), F.least(F.col("b") + context, F.col("n_lines")).cast("int").alias("end_line"), "n_findings", "priority")


def line_counts(files: DataFrame) -> DataFrame:
    return files.select("file_path", F.size(line_array(F.col("content"))).alias("n_lines"))


def gaps(zone: DataFrame, line_counts: DataFrame, least: int = 2) -> DataFrame:
    """file_path, start_line, end_line of the stretches of ``least`` lines at least before, between and behind zones."""
    within = Window.partitionBy("file_path").orderBy("start_line")
    seen = F.max("end_line").over(within.rowsBetween(Window.unboundedPreceding, -1))
    told = zone.select("file_path", (F.coalesce(seen, F.lit(0)) + 1).alias("a"), (F.col("start_line") - 1).alias("b"))
    last = zone.groupBy("file_path").agg((F.max("end_line") + 1).alias("a")).join(line_counts, "file_path").select("file_path", "a", F.col("n_lines").alias("b"))
    out = told.union(last).where(F.col("b") - F.col("a") + 1 >= least)
    return out.select("file_path", F.col("a").cast("int").alias("start_line"), F.col("b").cast("int").alias("end_line"))


def sliced(spans: DataFrame, files: DataFrame) -> DataFrame:
    """``spans`` with content, token_count, character_count and line_count of their lines; none beyond the file's end."""
    rest = [x for x in spans.columns if x != "file_path"]
    own = spans.groupBy("file_path").agg(F.collect_list(F.struct(*rest)).alias("_s"))
    # a file meets its spans once, and its lines are split once
    met = files.select("file_path", line_array(F.col("content")).alias("_lines")).join(own, "file_path").select("file_path", "_lines", F.explode("_s").alias("_s"))
    lines = F.slice("_lines", F.col("start_line"), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0)))
    told = met.select("file_path", "_lines", "_s.*").withColumn("content", F.array_join(lines, "\n")).drop("_lines")
    return told.withColumns({
        "token_count": tokens(F.col("content")), "character_count": F.length("content").cast("long"), "line_count": F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0)).cast("long"),
    })


def associated(chunks: DataFrame, findings: DataFrame) -> DataFrame:
    """Pairs of chunks (with chunk_id) and the findings that start within them: a join by bands of lines."""
    from quarry.operators.bands import lines_within

    c = chunks.select("chunk_id", "file_path", F.col("start_line").alias("c_start"), F.col("end_line").alias("c_end"))
    return lines_within(c, findings, "start_line", "c_start", "c_end")


def chunk_scores(pairs: DataFrame) -> DataFrame:
    """chunk_id, finding_count, severity_score, focus_score, has_critical."""
    w = severity_weight(F.col("severity"))
    return pairs.groupBy("chunk_id").agg(
        F.count("*").alias("finding_count"), F.max(w).alias("severity_score"), F.least(F.sum(w * F.col("confidence")), F.lit(1.0)).alias("focus_score"), F.bool_or(F.col("severity") == "critical").alias("has_critical"))


def chunk_id(*parts: str) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(x).cast("string") for x in parts]))


def focus_chunks(files: DataFrame, findings: DataFrame, context: int = CONTEXT, order: list[str] | None = None) -> DataFrame:
    """The focus strategy: zones of findings as chunks with chunk_id, content, its counts, and the scores of the findings
    that start within (as ``chunk_scores``; null where none does). Chunks of one file never overlap where its findings'
    ends never decrease. Findings of no known file are left out.

    Findings are shuffled once, by file; a file's zones and findings then meet its text in one join, and its lines are
    split once.
    """
    end = F.coalesce("end_line", "start_line")
    marked = islands(findings, 2 * context, order)
    told = marked.groupBy("file_path", "island").agg(
        F.min("start_line").alias("a"), F.max(end).alias("b"), F.count("*").alias("n"), F.least(F.avg(weighted(marked)), F.lit(1.0)).alias("p"), F.collect_list(F.struct("start_line", severity_weight(F.col("severity")).alias("w"), "confidence", "severity")).alias("f"))
    own = told.groupBy("file_path").agg(F.collect_list(F.struct("island", "a", "b", "n", "p")).alias("_z"), F.flatten(F.collect_list("f")).alias("_f"))
    first = lambda z: F.greatest(F.lit(1), z["a"] - context).cast("int")
    last = lambda z, lines: F.least(z["b"] + context, F.size(lines)).cast("int")

    def cut(z: Column, lines: Column) -> Column:
        text = F.array_join(F.slice(lines, first(z), F.greatest(last(z, lines) - first(z) + 1, F.lit(0))), "\n")
        within = F.filter("_f", lambda f: f["start_line"].between(first(z), last(z, lines)))
        return F.struct(
            z["island"].alias("island"), first(z).alias("start_line"), last(z, lines).alias("end_line"), z["n"].alias("n_findings"), z["p"].alias("priority"), text.alias("content"), within.alias("_in"))

    # the lines are bound as an argument, lest each zone split the text again
    spans = F.flatten(F.transform(F.array(line_array(F.col("content"))), lambda lines: F.transform("_z", lambda z: cut(z, lines))))
    chunk = files.select("file_path", "content").join(own, "file_path").select("file_path", F.inline(spans))
    sure = F.filter(F.transform("_in", lambda f: f["w"] * f["confidence"]), lambda x: x.isNotNull())
    total = F.when(F.size(sure) > 0, F.aggregate(sure, F.lit(0.0), lambda x, y: x + y))
    some = F.size("_in") > 0
    return chunk.withColumns({
        "chunk_id": chunk_id("file_path", "start_line", "end_line"), "token_count": tokens(F.col("content")), "character_count": F.length("content").cast("long"), "line_count": F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0)).cast("long"),
        "finding_count": F.when(some, F.size("_in").cast("long")), "severity_score": F.array_max(F.transform("_in", lambda f: f["w"])), "focus_score": F.when(some, F.least(total, F.lit(1.0))),
        "has_critical": F.when(some, F.exists("_in", lambda f: F.coalesce(f["severity"] == "critical", F.lit(False)))),
    }).drop("_in")


def overlaps(chunks: DataFrame, most: int = 5) -> DataFrame:
    """file_path, first_end, next_start of neighbouring chunks no more than ``most`` lines apart."""
    within = Window.partitionBy("file_path").orderBy("start_line", "end_line")
    told = chunks.select("file_path", F.col("end_line").alias("first_end"), F.lead("start_line").over(within).alias("next_start"))
    return told.where((F.col("next_start").isNotNull()) & (F.col("first_end") >= F.col("next_start") - most))


def relationships(chunks: DataFrame, least: float = 0.1) -> DataFrame:
    """file_path, first, second (start lines), strength, kind for pairs of a file's chunks.

    ``chunks`` has functions and imports (arrays). Half a point for each shared function, 0.3 for an import, 0.4 if the
    second starts within five lines of the first's end; 1.0 at most. A chunk is shuffled once, by file, and sorted within
    its task; pairs come from shared names and neighbouring lines, never from all pairs of a file, and are told as they
    are met: none is shuffled, sorted or kept.
    """
    # only whether names are the same counts: a long one is told by its digest, which is longer than any that is kept
    short = lambda x: F.when(F.octet_length(x) < 64, x).otherwise(F.sha2(x, 256))
    names = [F.transform(F.array_distinct(x), short).alias(x) for x in ("functions", "imports")]
    rows = chunks.where("file_path is not null and start_line is not null").select("file_path", "start_line", "end_line", *names)
    line = dict(rows.dtypes)["start_line"]
    told = rows.repartition("file_path").sortWithinPartitions("file_path", "start_line").mapInArrow(pairs.told, f"file_path string, first {line}, second {line}, f bigint, i bigint, seq boolean")
    strength = F.least(F.lit(1.0), 0.5 * F.col("f") + 0.3 * F.col("i") + F.when(F.col("seq"), 0.4).otherwise(0.0))
    kind = F.when(F.col("seq"), "sequential").when(F.col("f") > 0, "functional").otherwise("related")
    return told.select("file_path", "first", "second", strength.alias("strength"), kind.alias("kind")).where(F.col("strength") >= least)
