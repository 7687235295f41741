"""Token budgets: truncation, windows, allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import TOKEN_CHARS, tokens

#: Tokens that a chat message and a conversation add, and the most of one request.
PER_MESSAGE, PER_CONVERSATION, REQUEST_LIMIT = 4, 2, 8192
#: Context limits by model.
MODEL_LIMIT = {"gpt-4": 8192, "gpt-3.5-turbo": 4096, "claude-3": 200_000, "llama3-70b-8192": 8192}


def truncated(text: Column, most: int) -> Column:
    """The longest beginning with at most ``most`` tokens."""
    return F.substring(text, 1, TOKEN_CHARS * most + TOKEN_CHARS - 1)


def truncated_sentences(text: Column, most: int) -> Column:
    """The longest run of first sentences (ended by a point and a space) that together keep within ``most`` tokens."""
    parts = F.split(text, r"\. ")
    none = F.struct(F.lit("").alias("out"), F.lit(False).alias("full"))

    def step(a: Column, x: Column) -> Column:
        more = F.concat(a["out"], x, F.lit(". "))
        fits = ~a["full"] & (tokens(more) <= most)
        return F.struct(F.when(fits, more).otherwise(a["out"]).alias("out"), (~fits).alias("full"))

    return F.rtrim(F.aggregate(parts, none, step)["out"])


def windows(files: DataFrame, size: int, overlap: int, text: str = "content") -> DataFrame:
    """file_path, part, start_char, end_char: windows of ``size`` tokens that share ``overlap`` with the one before."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    wide, step = size * TOKEN_CHARS, (size - overlap) * TOKEN_CHARS
    count = F.when(n == 0, 0).when(n <= wide, 1).otherwise(F.ceil((n - wide) / step) + 1)
    starts = F.when(count > 0, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    told = files.select("file_path", n.alias("n"), F.explode(starts).alias("k"))
    return told.select("file_path", (F.col("k") + 1).cast("long").alias("part"), (F.col("k") * step).cast("long").alias("start_char"), F.least(F.col("n"), F.col("k") * step + wide).cast("long").alias("end_char"))


def chunk_plan(total: Column, limit: int, least: int = 1, most: int = 10) -> Column:
    """struct<size, count>: the fewest chunks, from ``least`` to below ``most``, that bring the size within ``limit``."""
    counts = F.sequence(F.lit(least), F.lit(most - 1))
    good = F.filter(counts, lambda k: F.floor(total / k) <= limit)
    first = F.get(good, F.lit(0)).cast("long")
    pick = lambda size, count: F.struct(size.cast("long").alias("size"), count.cast("long").alias("count"))
    return F.when(total <= limit, pick(total, F.lit(1))).when(first.isNotNull(), pick(F.floor(total / first), first)).otherwise(pick(F.lit(limit), F.lit(most)))


def allocation(limit: int, template: Column, context: Column, response: int) -> Column:
    """struct<available, used_share>: what is left of ``limit`` beside template, context and response."""
    used = template + context + response
    return F.struct(F.greatest(F.lit(0), limit - used).cast("long").alias("available"), (used / limit).alias("used_share"))


def message_tokens(role: Column, text: Column) -> Column:
    return tokens(role) + tokens(text) + PER_MESSAGE


def template_tokens(template: Column, chars: int = 100) -> Column:
    """Tokens of a template whose ``{variables}`` are filled with ``chars`` characters each."""
    return tokens(F.regexp_replace(template, r"\{[^}]+\}", "x" * chars))
