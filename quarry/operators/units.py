"""Code units: functions, classes and imports of source files, by parsing or by indentation."""

from __future__ import annotations

import ast
import textwrap
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import indent

UNITS = "file_path string, kind string, name string, start_line int, end_line int, complexity int, is_async boolean, parameters array<string>, docstring string"
_BRANCHES = (ast.If, ast.For, ast.While, ast.Try, ast.ExceptHandler, ast.AsyncFor)
#: Words whose occurrences make a function complex, and words that mark security-relevant code.
COMPLEX_WORDS = ["if ", "for ", "while ", "try ", "except ", "elif "]
SECURITY_WORDS = "password auth login token secret key admin sql query execute eval exec input raw_input subprocess os.system shell command pickle marshal".split()


def _python_units(path: str, code: str) -> Iterator[tuple]:
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            kind, names = "function", [a.arg for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]]
        elif isinstance(node, ast.ClassDef):
            kind, names = "class", [ast.unparse(x) for x in node.bases]
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            module = getattr(node, "module", None) or ", ".join(x.name for x in node.names)
            yield path, "import", module, node.lineno, node.end_lineno, 0, False, [x.name for x in node.names], None
            continue
        else:
            continue
        complexity = 1 + sum(isinstance(x, _BRANCHES) for x in ast.walk(node))
        start = min([node.lineno, *(x.lineno for x in node.decorator_list)])
        yield path, kind, node.name, start, node.end_lineno, complexity, isinstance(node, ast.AsyncFunctionDef), names, ast.get_docstring(node)


def python_units(files: DataFrame) -> DataFrame:
    """Units of Python files, decorators included. A file that doesn't parse, or is null, has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.string()), pa.string()]
        names = [x.strip().split(" ")[0] for x in UNITS.split(", ")]
        for batch in batches:
            rows = [u for path, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if code for u in _python_units(path, code)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    return files.select("file_path", "content").mapInArrow(run, UNITS)


def _parses(code: str | None) -> bool:
    try:
        ast.parse(textwrap.dedent(code or ""))
        return True
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False


def valid_python(code: Column) -> Column:
    """Whether a piece of code, its common indentation off, parses (an Arrow UDF)."""
    return F.udf(_parses, "boolean", useArrow=True)(code)


def heuristic_units(lines: DataFrame, opener: str = r"^\s*(class|def|async def)\s+([A-Za-z_0-9]+)") -> DataFrame:
    """file_path, kind, name, start_line, end_line of blocks told by indentation alone.

    ``lines`` has file_path, line_no, line. A block opens at a line that matches ``opener`` and ends before the first
    later line, blank and comment lines apart, that is indented no deeper. One shuffle by file, without texts; lines are taken
    once for each depth at which a file opens blocks, a handful, that is theirs or deeper, and the next of these ends a block.
    """
    code, opens = ~F.col("line").rlike(r"^\s*(#|$)"), F.col("line").rlike(opener)
    # texts stay behind: a line is its depth, and an opener's words
    told = lines.where("file_path is not null").select(
        "file_path", "line_no", F.when(code, indent(F.col("line"))).alias("depth"), F.when(code & opens, F.struct(F.regexp_extract("line", opener, 1).alias("word"), F.regexp_extract("line", opener, 2).alias("name"))).alias("u"))
    whole = Window.partitionBy("file_path")
    told = told.withColumns({"depths": F.collect_set(F.when(F.col("u").isNotNull(), F.col("depth"))).over(whole), "last": F.max("line_no").over(whole)})
    # a line deeper than every opener closes none
    dealt = told.withColumn("own", F.explode("depths")).where("depth <= own")
    after = F.lead("line_no").over(Window.partitionBy("file_path", "own").orderBy("line_no"))
    found = dealt.withColumn("next", after).where("u is not null and depth = own")
    return found.select(
        "file_path", F.when(F.col("u.word") == "class", "class").otherwise("function").alias("kind"), F.col("u.name").alias("name"),
        F.col("line_no").cast("int").alias("start_line"), F.coalesce(F.col("next") - 1, F.col("last")).cast("int").alias("end_line"))


def runs(lines: DataFrame, pattern: str, reach: int) -> DataFrame:
    """file_path, start_line, end_line of islands of lines that match, each at most ``reach`` lines behind the one before."""
    within = Window.partitionBy("file_path").orderBy("line_no")
    hit = lines.where(F.col("line").rlike(pattern)).select("file_path", "line_no")
    apart = F.coalesce((F.col("line_no") - F.lag("line_no").over(within) > reach).cast("int"), F.lit(0))
    marked = hit.withColumn("a", apart).withColumn("g", F.sum("a").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("file_path", "g").agg(F.min("line_no").cast("int").alias("start_line"), F.max("line_no").cast("int").alias("end_line")).drop("g")


def import_blocks(lines: DataFrame) -> DataFrame:
    return runs(lines, r"^(import|from)\s", 2)


def global_blocks(lines: DataFrame) -> DataFrame:
    return runs(lines, r"^[A-Za-z_][A-Za-z_0-9]*\s*=[^=]", 3)


def remaining_blocks(lines: DataFrame, taken: DataFrame, least: int = 2) -> DataFrame:
    """Stretches of lines that no span of ``taken`` holds, from the first to the last that is neither blank nor comment,
    of more than ``least`` lines."""
    spans = taken.select("file_path", F.explode(F.sequence("start_line", "end_line")).alias("line_no")).distinct()
    within = Window.partitionBy("file_path").orderBy("line_no")
    marked = lines.join(spans.withColumn("t", F.lit(1)), ["file_path", "line_no"], "left").withColumn("g", F.count("t").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    free = marked.where("t is null").where(~F.col("line").rlike(r"^\s*(#|$)"))
    out = free.groupBy("file_path", "g").agg(F.min("line_no").cast("int").alias("start_line"), F.max("line_no").cast("int").alias("end_line"))
    return out.where(F.col("end_line") - F.col("start_line") >= least).drop("g")


def split_large(spans: DataFrame, most: int) -> DataFrame:
    """Spans of over ``most`` lines as pieces that share their border lines."""
    starts = F.when(F.col("end_line") - F.col("start_line") > most, F.sequence("start_line", F.col("end_line") - 1, F.lit(most))).otherwise(F.array("start_line"))
    told = spans.withColumn("s", F.explode(starts))
    end = F.when(F.col("end_line") - F.col("start_line") > most, F.least(F.col("s") + most, F.col("end_line"))).otherwise(F.col("end_line"))
    return told.withColumn("e", end).withColumn("start_line", F.col("s")).withColumn("end_line", F.col("e")).drop("s", "e")


def call_names(code: Column) -> Column:
    """Names that are called, sorted, each once (ASCII words before a parenthesis)."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(code, F.lit(r"([A-Za-z_0-9]+)\s*\("), 1)))


def call_edges(units: DataFrame) -> DataFrame:
    """caller, callee, file_path among the functions of a file; ``units`` has file_path, name, content."""
    calls = units.select("file_path", F.col("name").alias("caller"), F.explode(call_names(F.col("content"))).alias("callee"))
    names = units.select("file_path", F.col("name").alias("callee")).distinct()
    return calls.join(names, ["file_path", "callee"]).where("caller <> callee").select("file_path", "caller", "callee").distinct()


def chunk_calls(chunks: DataFrame, calls: DataFrame) -> DataFrame:
    """file_path, source, target, function_name: for each call the first chunk of its file that holds the caller and the
    first that holds the callee.

    ``chunks``: file_path, chunk_id, place (the order of a file's chunks) and names (of functions it holds); ``calls``:
    file_path, caller, callee. A name's first chunk is one aggregate with map-side combining, so its chunks are never
    paired. Calls of names that no chunk holds, and null names, are left out; equal calls are told once.
    """
    held = chunks.select("file_path", F.explode("names").alias("name"), F.struct("place", "chunk_id").alias("c"))
    first = held.groupBy("file_path", "name").agg(F.min("c")["chunk_id"].alias("chunk"))
    told = calls.select("file_path", "caller", "callee").distinct()
    told = told.join(first.select("file_path", F.col("name").alias("caller"), F.col("chunk").alias("source")), ["file_path", "caller"])
    told = told.join(first.select("file_path", F.col("name").alias("callee"), F.col("chunk").alias("target")), ["file_path", "callee"])
    return told.select("file_path", "source", "target", F.col("callee").alias("function_name")).distinct()


def complexity_class(code: Column) -> Column:
    """simple, moderate, complex or very_complex: lines that aren't blank, and twice each branching word."""
    lines = F.size(F.filter(F.split(code, "\n"), lambda x: ~x.rlike(r"^\s*$")))
    n = lines
    for word in COMPLEX_WORDS:
        n = n + 2 * F.regexp_count(code, F.lit(word))
    return F.when(n <= 5, "simple").when(n <= 15, "moderate").when(n <= 30, "complex").otherwise("very_complex")


def security_relevant(code: Column) -> Column:
    return F.lower(code).rlike("|".join(x.replace(".", r"\.") for x in SECURITY_WORDS))
