"""Which way to chunk each file, and how two ways' chunks become one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.maps import severity_weight
from quarry.functions.text import suffix

#: What a line begins with in structured code, with weights.
STRUCTURE = {"class ": 0.2, "def ": 0.15, "function ": 0.15, "if ": 0.1, "for ": 0.1, "while ": 0.1, "try:": 0.1, "except:": 0.1}
#: Parts of structured code, of which three must occur; words of functions; extensions with functions.
ELEMENTS = ["class ", "def ", "function ", "if ", "for ", "while ", "try:", "except:", "import ", "from "]
FUNCTION_WORDS = ["def ", "function ", "func ", "public ", "private ", "static "]
FUNCTION_SUFFIXES = [".py", ".js", ".ts", ".java", ".go", ".cpp", ".c", ".cs"]
#: Strategies in the order that breaks ties; priorities of chunk types.
ORDER = ["ast", "focus", "hybrid", "function", "semantic"]
TYPE_PRIORITY = {"focused": 5, "function": 4, "class": 3, "context": 2, "block": 1, "overlap": 0}
AST_WEIGHT, FOCUS_WEIGHT = 0.6, 0.4


#: A line's start; what stands before a stripped line's text, and text behind a word, without which the word loses its end.
_LINE, _STRIPPED = r"(?<![^\n])", (r"[^\S\n]*+", r"(?=[^\S\n]*+\S)")
#: The same where lines lose nothing but the spaces before their text.
_BARE = (r"\p{Zs}*+", "")


def structure_score(content: Column, bare: bool = False) -> Column:
    """Weights of lines that begin like structured code, a score for each fifty lines, 1.0 at most. With ``bare`` lines
    are stripped of the spaces before their text only, so other white space stays and a word may end a line."""
    before, more = _BARE if bare else _STRIPPED
    words = "|".join(x + (more if x.endswith(" ") else "") for x in STRUCTURE)
    # only these lines are looked at, in one scan of the text
    found = F.regexp_extract_all(content, F.lit(f"{_LINE}{before}(?i)({words})"), 1)

    def weight(word: Column) -> Column:
        out = None
        for x, w in STRUCTURE.items():
            hit = F.lower(word) == x
            out = F.when(hit, w) if out is None else out.when(hit, w)
        return out

    total = F.aggregate(found, F.lit(0.0), lambda a, x: a + weight(x))
    size = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1
    return F.least(total / F.greatest(size / 50, F.lit(1.0)), F.lit(1.0))


def function_count(content: Column, bare: bool = False) -> Column:
    """Lines that begin with a function's word or hold ``function `` anywhere, in one scan of the text; ``bare`` as above."""
    before, more = _BARE if bare else _STRIPPED
    return F.regexp_count(content, F.lit(rf"{_LINE}(?:{before}(?:def|func) {more}|[^\n]*?function )"))


def _contained(text: Column, words: list[str]) -> Column:
    return sum((text.contains(x).cast("int") for x in words[1:]), text.contains(words[0]).cast("int"))


def _own(findings: DataFrame, order: Column) -> DataFrame:
    """file_path, own: mean weight of a file's findings, more if one is critical, 1.0 at most.

    Equal weights of one ``order`` are added up, then these sums by ``order``: they are told from counts, so the last bit,
    which may decide a tie, doesn't depend on the order of rows.
    """
    w = severity_weight(F.col("severity")) * F.col("confidence")
    told = findings.select("file_path", order.alias("k"), w.alias("w"), (F.col("severity") == "critical").alias("critical"))
    counts = told.groupBy("file_path", "k", "w").agg(F.count("*").alias("n"), F.bool_or("critical").alias("critical"))
    f = counts.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("k", "w", "n"))).alias("parts"), F.bool_or("critical").alias("critical"))
    parts = F.filter("parts", lambda x: x["w"].isNotNull())
    n = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    added = lambda x: F.aggregate(F.array_repeat(x["w"], x["n"].cast("int")), F.lit(0.0), lambda a, y: a + y)
    mean = F.least(F.aggregate(parts, F.lit(0.0), lambda a, x: a + added(x)) / F.nullif(n, F.lit(0)), F.lit(1.0))
    return f.select("file_path", F.least(F.lit(1.0), mean + F.when(F.col("critical"), 0.2).otherwise(0.0)).alias("own"))


def priorities(files: DataFrame, findings: DataFrame, valid: Column | None = None, order: Column | None = None, found: bool | None = None, bare: bool = False) -> DataFrame:
    """file_path, strategy, priority, can_handle: a row for each file and strategy.

    ``valid`` tells whether a file's syntax is valid (true if not given), ``found`` whether there are findings anywhere
    (looked up if not given). Findings are summed up per file before the join, by ``order``, else by their weights. Texts
    don't go through the join. With ``bare`` lines are stripped as in ``structure_score``, and a letter is lower-cased to one letter.
    """
    own = _own(findings, F.lit(0) if order is None else order)
    # \u0130 alone is lower-cased to an ASCII letter and a mark
    plain = F.replace("content", F.lit("\u0130"), F.lit("i")) if bare else F.col("content")
    text, low = F.coalesce("content", F.lit("")), F.col("_low")
    n = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + F.when((text == "") | text.endswith("\n"), 0).otherwise(1)
    c_function = suffix(F.col("file_path")).isin(FUNCTION_SUFFIXES) & (_contained(low, FUNCTION_WORDS) > 0)
    seen = {"_n": n, "_ok": F.lit(True) if valid is None else valid, "_funcs": function_count(F.col("content"), bare), "_score": structure_score(plain, bare), "_function": c_function, "_semantic": _contained(low, ELEMENTS) >= 3}
    f = files.withColumn("_low", F.lower(plain)).select("file_path", *[v.alias(k) for k, v in seen.items()]).join(own, "file_path", "left")
    some = F.col("some") if found is None else F.lit(found)
    if found is None:
        f = f.crossJoin(F.broadcast(findings.limit(1).agg((F.count("*") > 0).alias("some"))))  # one row
    c_function, c_semantic = F.col("_function"), F.col("_semantic")
    p_ast = F.least(F.lit(1.0), 0.7 + F.when(F.col("_n") > 200, 0.1).otherwise(0.0) + F.when(some, 0.0).otherwise(0.1) - F.when(F.col("_ok"), 0.0).otherwise(0.3))
    p_focus = F.when(~some, 0.0).otherwise(F.coalesce("own", F.lit(0.1)))
    p_function = F.when(~c_function, 0.0).when(F.col("_funcs") == 0, 0.1).when(F.col("_funcs") >= 5, 0.85).when(F.col("_funcs") >= 3, 0.75).otherwise(0.65)
    p_semantic = F.when(~c_semantic, 0.0).when(F.col("_score") >= 0.8, 0.9).when(F.col("_score") >= 0.6, 0.75).when(F.col("_score") >= 0.4, 0.6).otherwise(0.4)
    f = f.withColumns({"_ast": p_ast, "_focus": p_focus})
    high = F.greatest("_ast", "_focus")
    p_hybrid = F.when((F.col("_ast") > 0.7) & (F.col("_focus") > 0.7), 0.95).when(high > 0.8, 0.75).when((F.col("_ast") > 0.5) & (F.col("_focus") > 0.5), 0.65).otherwise(high * 0.7)
    c_ast = F.col("_ok") & (F.col("_n") >= 50)
    rows = [("ast", F.col("_ast"), c_ast), ("focus", F.col("_focus"), some), ("hybrid", p_hybrid, c_ast | some), ("function", p_function, c_function), ("semantic", p_semantic, c_semantic)]
    told = F.array(*[F.struct(F.lit(k).alias("ordinal"), F.lit(name).alias("strategy"), p.alias("priority"), c.alias("can_handle")) for k, (name, p, c) in enumerate(rows)])
    return f.select("file_path", F.inline(told))


def selected(rows: DataFrame) -> DataFrame:
    """The applicable strategy of the greatest priority for each file; files for which none applies are left out."""
    best = rows.where("can_handle").groupBy("file_path").agg(F.max_by(F.struct("strategy", "priority"), F.struct("priority", (-F.col("ordinal")).alias("o"))).alias("b"))
    return best.select("file_path", "b.*")


def hybrid_merge(structural: DataFrame, focused: DataFrame, order: list[str]) -> DataFrame:
    """Chunks of two strategies as one list: equal spans of a file become one chunk with both weights and the greater
    focus, others keep theirs times the strategy's weight. Of repeated spans the last by ``order`` counts.

    Both have file_path, start_line, end_line, priority, focus, has_findings, chunk_type.
    """
    key = ["file_path", "start_line", "end_line"]

    def last(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*key).agg(F.max_by(F.struct("priority", "focus", "has_findings", "chunk_type"), F.struct(*order)).alias(name))

    both = last(structural, "s").join(last(focused, "f"), key, "full_outer")
    found = F.coalesce("s.has_findings", F.lit(False)) | F.coalesce("f.has_findings", F.lit(False))
    # the base of a pair weighs as the structural one: the focused chunk if it alone has findings or the greater focus
    focus_base = (F.col("f.has_findings") & ~F.col("s.has_findings")) | ((F.col("f.has_findings") == F.col("s.has_findings")) & (F.col("f.focus") > F.col("s.focus")))
    a, b = F.when(focus_base, F.col("f.priority")).otherwise(F.col("s.priority")), F.when(focus_base, F.col("s.priority")).otherwise(F.col("f.priority"))
    pair = F.least(F.lit(1.0), a * AST_WEIGHT + b * FOCUS_WEIGHT + F.when(found, 0.2).otherwise(0.0))
    priority = F.when(F.col("f").isNull(), F.col("s.priority") * AST_WEIGHT).when(F.col("s").isNull(), F.col("f.priority") * FOCUS_WEIGHT).otherwise(pair)
    rank = {k: v for k, v in TYPE_PRIORITY.items()}
    from quarry.functions.maps import lookup

    kind = F.when(F.col("f").isNull(), F.col("s.chunk_type")).when(F.col("s").isNull(), F.col("f.chunk_type")).when(lookup(rank, F.col("s.chunk_type"), 0) >= lookup(rank, F.col("f.chunk_type"), 0), F.col("s.chunk_type")).otherwise(F.col("f.chunk_type"))
    origin = F.when(F.col("f").isNull(), "structural").when(F.col("s").isNull(), "focused").otherwise("both")
    return both.select(*key, origin.alias("origin"), priority.alias("priority"), F.greatest("s.focus", "f.focus").alias("focus"), found.alias("has_findings"), kind.alias("chunk_type"))


def best_first(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("position", F.row_number().over(Window.partitionBy("file_path").orderBy(F.desc("focus"), F.desc("priority"), "start_line", "end_line")))
