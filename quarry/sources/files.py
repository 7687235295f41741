"""Source files as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.maps import lookup
from quarry.functions.text import suffix

#: Extensions by language, and the extensions that each analyser reads.
EXTENSIONS = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go", ".java": "java", ".php": "php", ".c": "c", ".cpp": "cpp", ".cxx": "cpp", ".cc": "cpp", ".rs": "rust", ".rb": "ruby"}
TOOL_EXTENSIONS = {"bandit": [".py"], "semgrep": [".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".go", ".php", ".rb", ".c", ".cpp", ".cs", ".scala", ".kt"], "safety": [".txt", ".in", ".pip"]}
#: Patterns whose matches count towards a language, languages in the order that breaks ties.
PATTERNS = {
    "python": [r"#!/usr/bin/env python", r"#!/usr/bin/python", r"# -\*- coding: utf-8 -\*-", r"def\s+\w+\s*\(", r"import\s+\w+", r"from\s+\w+\s+import"],
    "javascript": [r"#!/usr/bin/env node", r"function\s+\w+\s*\(", r"var\s+\w+\s*=", r"let\s+\w+\s*=", r"const\s+\w+\s*=", r"require\s*\(", r"module\.exports"],
    "typescript": [r"interface\s+\w+", r"type\s+\w+\s*=", r"class\s+\w+\s*implements", r":\s*\w+\s*=", r"export\s+interface", r"import\s+type"],
    "go": [r"package\s+\w+", r"import\s*\(", r"func\s+\w+\s*\(", r"type\s+\w+\s+struct", r"go\s+func"],
    "java": [r"package\s+[\w\.]+;", r"import\s+[\w\.]+;", r"public\s+class\s+\w+", r"private\s+\w+\s+\w+", r"public\s+static\s+void\s+main"],
}


def read(spark: SparkSession, path: str, extensions: list[str] | None = None, exclude: list[str] | None = None, most_mb: float | None = None) -> DataFrame:
    """file_path, content, size_bytes, mtime of the text files below ``path``.

    Extension, excluded part of the path (its stars taken off) and size are told from the file listing, so what they
    rule out isn't read; nothing is ruled out unless asked for. Bytes that aren't UTF-8 are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    if most_mb is not None:
        files = files.where(F.col("length") <= int(most_mb * 1024 * 1024))
    if extensions:
        files = files.where(suffix(F.col("path")).isin([x.lower() for x in extensions]))
    for pattern in exclude or []:
        files = files.where(~F.col("path").contains(pattern.replace("*", "")))
    content = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit(""))
    return files.select(F.col("path").alias("file_path"), content.alias("content"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"))


def language_by_suffix(path: Column, default: str | None = None) -> Column:
    return lookup(EXTENSIONS, suffix(path), default)


def language_by_content(content: Column) -> Column:
    """The language most of whose patterns match; of equal counts the first; null where none does."""
    counts = [sum((content.rlike(f"(?m){p}").cast("int") for p in patterns[1:]), content.rlike(f"(?m){patterns[0]}").cast("int")) for patterns in PATTERNS.values()]
    ranked = F.array(*[F.struct(n.alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("language")) for k, (name, n) in enumerate(zip(PATTERNS, counts, strict=True))])
    best = F.array_max(ranked)
    return F.when(best["n"] > 0, best["language"])


def readable_by(path: Column, tool: str) -> Column:
    return suffix(path).isin(TOOL_EXTENSIONS[tool])


def is_requirements(path: Column, content: Column) -> Column:
    """A dependency list: by its name, or by a pinned version in its first ten lines."""
    name = F.lower(F.substring_index(path, "/", -1))
    named = name.contains("requirements") | name.contains("req.txt") | name.contains("pipfile") | name.contains("pyproject.toml")
    head = F.slice(F.split(F.coalesce(content, F.lit("")), "\n"), 1, 10)
    return named | F.exists(head, lambda x: x.contains("=="))
