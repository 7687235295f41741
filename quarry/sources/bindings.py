"""The domain's tables made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import lines

TYPES = ["sql_injection", "command_injection", "xss", "hardcoded_secrets", "weak_cryptography", "path_traversal"]
TOOLS = ["bandit", "semgrep", "safety"]
LEVELS = ["info", "low", "medium", "high", "critical"]
#: The columns that tell apart findings made from lineitem, which has no key.
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
#: rule id, pattern (in the dialect that Java and RE2 share), type, severity, confidence.
LINE_RULES = [
    ("licence", r"[Ll]icen[cs]e|[Cc]opyright", "license", "info", 0.4),
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "personal_data", "medium", 0.8),
    ("ipv4", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "personal_data", "low", 0.6),
    ("phone", r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", "personal_data", "high", 0.7),
    ("secret", r"(key|secret|token) *= *\"", "hardcoded_secrets", "critical", 0.9),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(names: list[str], k) -> F.Column:
    return F.element_at(F.array(*[F.lit(x) for x in names]), (k + 1).cast("int"))


def findings_synth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings made from lineitem: many files, repeated signatures, confidences in tenths."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    kind = _pick(TYPES, (F.col("l_partkey") + F.col("l_suppkey")) % 6)
    return l.select(
        F.expr("concat('order_', l_orderkey div 8)").alias("file_path"),
        (1 + (F.col("l_linenumber") - 1) * 4 + F.col("l_partkey") % 5).cast("int").alias("start_line"),
        (1 + (F.col("l_linenumber") - 1) * 4 + F.col("l_partkey") % 5 + F.col("l_suppkey") % 3).cast("int").alias("end_line"),
        _pick(TOOLS, F.col("l_suppkey") % 3).alias("source_tool"),
        _pick(LEVELS, F.col("l_partkey") % 5).alias("severity"),
        kind.alias("vulnerability_type"),
        (F.round(F.col("l_discount") * 100).cast("int") / 10.0).alias("confidence"),
        F.concat(F.lit("Possible "), F.replace(kind, F.lit("_"), F.lit(" "))).alias("description"),
        *ORDER,
    )


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("doc_"), "doc_id").alias("file_path"), F.col("text").alias("content"), F.col("lang").alias("language"), F.col("source").alias("project"))


def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_path, line_no, line."""
    return lines(source_files(spark, sf_dir).select("file_path", "content"))


def findings_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finding for each document line and rule that matches it: file_path, start_line, rule_id, type, severity, confidence."""
    rules = [F.when(F.col("line").rlike(p), F.struct(F.lit(r).alias("rule_id"), F.lit(t).alias("vulnerability_type"), F.lit(s).alias("severity"), F.lit(c).alias("confidence"))) for r, p, t, s, c in LINE_RULES]
    hit = source_lines(spark, sf_dir).select("file_path", F.col("line_no").alias("start_line"), F.col("line_no").alias("end_line"), F.explode(F.array(*rules)).alias("r"))
    return hit.where("r is not null").select("file_path", "start_line", "end_line", "r.*")


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts, key, kind, tokens, hit, value."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", F.col("user_id").alias("key"), F.col("event_type").alias("kind"), F.floor("value").cast("long").alias("tokens"), (F.col("event_type") != "error").alias("hit"), "value")
