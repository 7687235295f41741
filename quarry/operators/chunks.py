"""What is done to chunks once they are cut: validity, trimming, shortening, and the semantic strategy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from quarry.functions.budget import truncated
from quarry.functions.durable import written
from quarry.functions.text import lines as exploded
from quarry.functions.text import stripped, tokens
from quarry.operators import units as un

#: Words at which trimmed chunks begin, words that a good first line holds, and the marks of what was cut.
STARTS = ["def ", "class ", "if ", "for "]
FIRST_LINE = ["def ", "class ", "function ", "if ", "for ", "while ", "try "]
CUT_FUNCTION, CUT_UNIT = "    # ... function content truncated ...", "    # ... content truncated ..."


def _any(text: Column, words: list[str]) -> Column:
    out = text.contains(words[0])
    for word in words[1:]:
        out = out | text.contains(word)
    return out


def valid(content: Column, least: int, most: int) -> Column:
    """Not blank, and from ``least`` to ``most`` tokens."""
    return ~content.rlike(r"^\s*$") & tokens(content).between(least, most)


def has_boundary(content: Column) -> Column:
    """Whether the first line that isn't blank begins a unit."""
    return _any(F.get(F.split(stripped(content), "\n", 2), F.lit(0)), FIRST_LINE)


def fitted(chunks: DataFrame, least: int, most: int) -> DataFrame:
    """Chunks of ``least`` tokens at least, their content cut to ``most``; small ones are dropped, as ever."""
    kept = chunks.where(tokens(F.col("content")) >= least)
    return kept.withColumn("content", F.when(tokens(F.col("content")) > most, truncated(F.col("content"), most)).otherwise(F.col("content")))


def fitted_counted(chunks: DataFrame, least: int, most: int, seen: Observation) -> DataFrame:
    """``fitted``; the action that runs it also fills ``seen`` with chunks, dropped and tokens_dropped, counted in passing,
    without another scan. ``seen`` serves one action; chunks of null content count as dropped, of no tokens."""
    small = F.coalesce(tokens(F.col("content")) < least, F.lit(True))
    lost = F.coalesce(F.sum(F.when(small, tokens(F.col("content")))), F.lit(0))
    return fitted(chunks.observe(seen, F.count("*").alias("chunks"), F.count_if(small).alias("dropped"), lost.alias("tokens_dropped")), least, most)


def trimmed(chunks: DataFrame) -> DataFrame:
    """Chunks from their first line that begins a unit to their last that is neither blank nor comment; start_line and
    end_line (past the last line) follow. Chunks that need no trimming keep theirs."""
    lines = F.split("content", "\n", -1)
    marks = F.transform(lines, lambda x, k: F.struct(k.alias("k"), (~x.rlike(r"^\s*(#|$)") & _any(x, STARTS)).alias("starts"), (~x.rlike(r"^\s*(#|$)")).alias("code")))
    first = F.coalesce(F.get(F.filter("_m", lambda x: x["starts"]), F.lit(0))["k"], F.lit(0))
    last = F.coalesce(F.array_max(F.transform(F.filter("_m", lambda x: x["code"]), lambda x: x["k"])) + 1, F.size("_m"))
    told = chunks.withColumn("_m", marks).withColumns({"_a": first, "_b": last, "_n": F.size("_m")})
    told = told.withColumn("_t", (F.col("_a") > 0) | (F.col("_b") < F.col("_n")))
    out = told.withColumns({
        "content": F.when(F.col("_t"), F.array_join(F.slice(lines, F.col("_a") + 1, F.greatest(F.col("_b") - F.col("_a"), F.lit(0))), "\n")).otherwise(F.col("content")),
        "start_line": (F.col("start_line") + F.when(F.col("_t"), F.col("_a")).otherwise(0)).cast("int"),
        "end_line": F.when(F.col("_t"), F.col("start_line") + F.col("_b")).otherwise(F.col("end_line")).cast("int"),
    })
    return out.drop("_m", "_a", "_b", "_n", "_t")


def shortened_function(content: Column, most: int) -> Column:
    """A function of over ``most`` tokens cut where its lines reach nine tenths of them, with a mark; its first line stays."""
    lines = F.split(content, "\n", -1)
    none = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("kept"), F.lit(False).alias("full"))

    def step(a: Column, x: Column) -> Column:
        more = a["sum"] + tokens(x)
        full = a["full"] | ((a["kept"] > 0) & (more > 0.9 * most))
        return F.struct(F.when(full, a["sum"]).otherwise(more).alias("sum"), (a["kept"] + F.when(full, 0).otherwise(1)).alias("kept"), full.alias("full"))

    kept = F.aggregate(lines, none, step)
    cut = F.concat(F.slice(lines, F.lit(1), F.greatest(kept["kept"], F.lit(1))), F.when(kept["full"], F.array(F.lit(CUT_FUNCTION))).otherwise(F.array().cast("array<string>")))
    return F.when(tokens(content) <= most, content).otherwise(F.array_join(cut, "\n"))


def shortened_unit(content: Column) -> Column:
    """The first three and last two lines of more than five, with a mark between."""
    lines = F.split(content, "\n", -1)
    short = F.concat(F.slice(lines, 1, 3), F.array(F.lit(CUT_UNIT)), F.slice(lines, -2, 2))
    return F.when(F.size(lines) <= 5, content).otherwise(F.array_join(short, "\n"))


def heuristic_cuts(files: DataFrame) -> DataFrame:
    """file_path, start_line, end_line: cut before each class or function line once more than three lines have gathered."""
    flags = F.transform(F.split("content", "\n", -1), lambda x, k: F.struct((k + 1).alias("k"), x.rlike(r"^\s*(class |def |async def )").alias("d")))
    none = F.array(F.lit(1))

    def step(a: Column, x: Column) -> Column:
        return F.when(x["d"] & (x["k"] - F.element_at(a, -1) > 3), F.concat(a, F.array(x["k"]))).otherwise(a)

    told = files.select("file_path", F.aggregate(flags, none, step).alias("s"), F.size(F.split("content", "\n", -1)).alias("n"))
    ends = F.concat(F.transform(F.slice("s", F.lit(2), F.size("s")), lambda x: x - 1), F.array("n"))
    return told.select("file_path", F.explode(F.arrays_zip(F.col("s").alias("start_line"), ends.alias("end_line"))).alias("p")).select("file_path", F.col("p.start_line").alias("start_line"), F.col("p.end_line").alias("end_line"))


def decorator_start(units: DataFrame, lines: DataFrame) -> DataFrame:
    """``units`` with their start moved up to the first of the decorators above; blank and comment lines between count as
    nothing. ``lines`` has file_path, line_no, line. Units of files without lines stay as they are.

    Two windows over a file's lines in one shuffle: the last line of code above, and the first decorator behind it.
    """
    kind = F.when(F.col("line").rlike(r"^\s*@"), "d").when(F.col("line").rlike(r"^\s*(#|$)"), "s").otherwise("x")
    # a row for each start stands before the line of its number, so its windows end at the line above
    asked = units.select("file_path", F.col("start_line").alias("line_no"), F.lit(0).alias("o"), F.lit("u").alias("c")).distinct()
    both = lines.select("file_path", "line_no", F.lit(1).alias("o"), kind.alias("c")).unionByName(asked)
    above = Window.partitionBy("file_path").orderBy("line_no", "o").rowsBetween(Window.unboundedPreceding, -1)
    told = both.withColumn("wall", F.max(F.when(F.col("c") == "x", F.col("line_no"))).over(above))
    behind = Window.partitionBy("file_path", "wall").orderBy("line_no", "o").rowsBetween(Window.unboundedPreceding, -1)
    told = told.withColumn("top", F.min(F.when(F.col("c") == "d", F.col("line_no"))).over(behind))
    top = told.where("c = 'u'").select("file_path", F.col("line_no").alias("start_line"), "top")
    return units.join(top, ["file_path", "start_line"], "left").withColumn("start_line", F.coalesce("top", "start_line").cast("int")).drop("top")


def logical_bounds(units: DataFrame, lines: DataFrame) -> DataFrame:
    """``units`` with logical_start and logical_end.

    The start goes back from the second line above (the line just above is passed over unseen, as ever) over decorators,
    comments, doc strings and blank lines. The end goes forward over comments and blank lines, from the last line itself
    and two lines further at most, never to the file's last line. Where no such line stands, the bounds stay.
    """
    w = Window.partitionBy("file_path").orderBy("line_no")
    soft, blank = F.col("line").rlike(r"^\s*(@|#|\"\"\"|'''|$)"), F.col("line").rlike(r"^\s*(#|$)")
    told = lines.select("file_path", "line_no", soft.alias("soft"), (blank & F.lead("line_no").over(w).isNotNull()).alias("b"))
    wall = F.coalesce(F.max(F.when(~F.col("soft"), F.col("line_no"))).over(w), F.lit(0))
    on = lambda k: F.coalesce(F.lead("b", k).over(w), F.lit(False))
    more = F.when(F.col("b") & on(1) & on(2), 2).when(F.col("b") & on(1), 1).otherwise(0)
    told = told.select("file_path", "line_no", F.when(F.col("soft"), wall + 1).alias("_s"), more.alias("_m"))
    begin = told.select("file_path", (F.col("line_no") + 2).cast("int").alias("start_line"), "_s")
    end = told.select("file_path", F.col("line_no").cast("int").alias("end_line"), "_m")
    both = units.join(begin, ["file_path", "start_line"], "left").join(end, ["file_path", "end_line"], "left")
    return both.withColumns({
        "logical_start": F.coalesce("_s", "start_line").cast("int"), "logical_end": (F.col("end_line") + F.coalesce("_m", F.lit(0))).cast("int"),
    }).drop("_s", "_m")


def semantic_chunks(files: DataFrame) -> DataFrame:
    """file_path, chunk_type, start_line, end_line by five steps, each on lines that none before took: import blocks,
    classes at the margin, functions at the margin, blocks of assignments, what remains."""
    lines = exploded(files.select("file_path", "content"))
    margin = un.heuristic_units(lines, r"^(class|def|async def)\s+([A-Za-z_0-9]+)")
    # spans are few; written once, lest each step cuts the files' lines anew for all steps before it
    named = {"import": un.import_blocks(lines), None: margin, "global": un.global_blocks(lines)}
    parts = [df.select("file_path", (F.lit(k) if k else F.col("kind")).alias("chunk_type"), "start_line", "end_line") for k, df in named.items()]
    spans = written(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    out = None
    for name in ("import", "class", "function", "global"):
        span = spans.where(F.col("chunk_type") == name)
        if out is not None:
            taken = out.select(F.col("file_path").alias("f"), F.col("start_line").alias("a"), F.col("end_line").alias("b"))
            span = span.join(taken, (F.col("file_path") == F.col("f")) & (F.col("start_line") <= F.col("b")) & (F.col("a") <= F.col("end_line")), "left_anti")
        out = span if out is None else out.unionByName(span)
    rest = un.remaining_blocks(lines, out).select("file_path", F.lit("block").alias("chunk_type"), "start_line", "end_line")
    return out.unionByName(rest)


def differential(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files of ``after`` that are new or whose content has changed; contents are compared by hash."""
    key = lambda df: df.select("file_path", F.xxhash64("content").alias("h"))
    fresh = key(after).join(key(before), ["file_path", "h"], "left_anti")
    return after.join(fresh.select("file_path"), "file_path", "left_semi")
