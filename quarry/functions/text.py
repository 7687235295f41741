"""Text expressions: lines, tokens, white space, paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: characters of a token where no tokenizer is at hand.
TOKEN_CHARS = 4


def tokens(text: Column) -> Column:
    """bigint: estimated tokens, a quarter of the characters, rounded down; null and empty texts have none."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / TOKEN_CHARS).cast("long")


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def squeezed(text: Column) -> Column:
    """Each run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


#: Fixed value: what ends a line where not the line feed alone does.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def line_array(content: Column, every_end: bool = False, last: bool = False) -> Column:
    """Lines without their ends; no empty last line behind a final line end, and no line in an empty content, unless
    ``last``. A line feed ends a line; with ``every_end`` so do all of ``LINE_ENDS``."""
    parts = F.split(F.coalesce(content, F.lit("")), LINE_ENDS if every_end else "\n", -1)
    return parts if last else F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def lines(files: DataFrame, content: str = "content", every_end: bool = False, last: bool = False) -> DataFrame:
    """A row for each line of each file by the rule of ``line_array``: the files' other columns, line_no from 1, line. A
    narrow generator, no shuffle."""
    rest = [x for x in files.columns if x != content]
    told = files.select(*rest, F.posexplode(line_array(F.col(content), every_end, last)).alias("k", "line"))
    return told.select(*rest, (F.col("k") + 1).alias("line_no"), "line")


def indent(line: Column) -> Column:
    """Spaces and tabs before a line's first other character."""
    return F.length(F.regexp_extract(line, r"^[ \t]*", 0))


def suffix(path: Column) -> Column:
    """Lower-cased extension with its dot, or the empty text."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def size_class(megabytes: Column) -> Column:
    return F.when(megabytes < 0.1, "tiny").when(megabytes < 1, "small").when(megabytes < 10, "medium").when(megabytes < 50, "large").otherwise("huge")


def cut(text: Column, chars: int = 200) -> Column:
    """The first ``chars`` characters, and three dots where there were more."""
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))).otherwise(text)
