"""What the strategies tell besides their chunks, in one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of what a strategy tells, and each kind's columns besides file_path.
KINDS = {"relationship": ["first", "second", "strength", "label"], "overlap": ["first", "second"], "error": ["message"], "warning": ["message"]}
_TYPES = {"first": "int", "second": "int", "strength": "double", "label": "string", "message": "string"}


def united(told: dict[str, dict[str, DataFrame]]) -> DataFrame:
    """strategy, kind, file_path, first, second, strength, label, message: all that each strategy tells, as ``told``
    (strategy, kind of ``KINDS``, rows), unchanged and with repeats; columns that a kind doesn't have are null."""
    parts = []
    for strategy, kinds in told.items():
        for kind, rows in kinds.items():
            own = KINDS[kind]
            columns = [(F.col(x) if x in own else F.lit(None)).cast(t).alias(x) for x, t in _TYPES.items()]
            parts.append(rows.select(F.lit(strategy).alias("strategy"), F.lit(kind).alias("kind"), "file_path", *columns))
    return reduce(DataFrame.unionByName, parts)


def summary(results: DataFrame) -> DataFrame:
    """file_path with the number of relationships, overlaps, errors and warnings, and ok: whether no strategy failed."""
    counts = [F.count_if(F.col("kind") == kind).alias(f"{kind}s") for kind in KINDS]
    return results.groupBy("file_path").agg(*counts).withColumn("ok", F.col("errors") == 0)
