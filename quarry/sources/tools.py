"""Findings from analysers' saved JSON reports.

Readers keep bad documents from failing a scan: what doesn't parse is null and gives no findings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import maps

BANDIT = "results ARRAY<STRUCT<test_id STRING, test_name STRING, issue_text STRING, filename STRING, line_number INT, issue_severity STRING, issue_confidence STRING, code STRING>>"
SEMGREP = "results ARRAY<STRUCT<check_id STRING, path STRING, message STRING, start STRUCT<line INT, col INT>, end STRUCT<line INT, col INT>, extra STRUCT<severity STRING, lines STRING, confidence STRING, message STRING>>>"
SAFETY = "ARRAY<STRUCT<package STRING, installed_version STRING, affected_versions STRING, advisory STRING, vulnerability_id STRING, CVE STRING, severity STRING>>"
COLUMNS = ["title", "description", "vulnerability_type", "severity", "confidence", "file_path", "start_line", "end_line", "start_column", "end_column", "source_tool", "rule_id", "cwe_id", "code_snippet", "metadata"]


def _or(name: str, value):
    return F.coalesce(F.col(name), F.lit(value))


def bandit(reports: DataFrame, json: str = "json") -> DataFrame:
    r = reports.select(F.explode(F.from_json(json, BANDIT)["results"]).alias("r")).select("r.*")
    line = _or("line_number", 1)
    severity, confidence = _or("issue_severity", "MEDIUM"), _or("issue_confidence", "MEDIUM")
    data = F.create_map(F.lit("test_id"), F.col("test_id"), F.lit("test_name"), F.col("test_name"), F.lit("issue_severity"), severity, F.lit("issue_confidence"), confidence)
    return r.select(
        F.concat(F.lit("Bandit "), _or("test_id", "Unknown"), F.lit(": "), _or("test_name", "Unknown")).alias("title"),
        _or("issue_text", "Unknown").alias("description"), maps.test_type(_or("test_id", "")).alias("vulnerability_type"),
        maps.tool_severity(F.lit("bandit"), severity).alias("severity"), maps.test_confidence(confidence).alias("confidence"),
        _or("filename", "Unknown").alias("file_path"), line.alias("start_line"), line.alias("end_line"), F.lit(None).cast("int").alias("start_column"), F.lit(None).cast("int").alias("end_column"),
        F.lit("bandit").alias("source_tool"), F.col("test_id").alias("rule_id"), F.lit(None).cast("string").alias("cwe_id"), F.col("code").alias("code_snippet"), data.alias("metadata"),
    )


def semgrep(reports: DataFrame, json: str = "json") -> DataFrame:
    r = reports.select(F.explode(F.from_json(json, SEMGREP)["results"]).alias("r")).select("r.*")
    message, rule, line = F.coalesce("message", "extra.message", F.lit("")), _or("check_id", "Unknown"), F.coalesce("start.line", F.lit(1))
    data = F.create_map(F.lit("check_id"), F.col("check_id"), F.lit("severity"), F.col("extra.severity"))
    return r.select(
        F.concat(F.lit("Semgrep: "), rule).alias("title"), message.alias("description"), maps.rule_type(rule, message).alias("vulnerability_type"),
        maps.tool_severity(F.lit("semgrep"), F.coalesce("extra.severity", F.lit("WARNING"))).alias("severity"), maps.rule_confidence(rule, F.col("extra.confidence")).alias("confidence"),
        _or("path", "").alias("file_path"), line.alias("start_line"), F.coalesce("end.line", line).alias("end_line"), F.col("start.col").alias("start_column"), F.col("end.col").alias("end_column"),
        F.lit("semgrep").alias("source_tool"), rule.alias("rule_id"), F.lit(None).cast("string").alias("cwe_id"), F.col("extra.lines").alias("code_snippet"), data.alias("metadata"),
    )


def safety(reports: DataFrame, json: str = "json", path: str | None = None, ignored: list[str] | None = None) -> DataFrame:
    """``path``: the column with the scanned list's path; none: the environment. Both an array and an object with
    ``vulnerabilities`` are read."""
    array = F.when(F.col(json).rlike(r"^\s*\["), F.col(json)).otherwise(F.get_json_object(json, "$.vulnerabilities"))
    listed = F.from_json(array, SAFETY)
    where = F.col(path) if path else F.lit("environment/installed_packages")
    r = reports.select(where.alias("_path"), F.explode(listed).alias("r")).select("_path", "r.*").where(F.col("package").isNotNull() | F.col("advisory").isNotNull())
    if ignored:
        r = r.where(~F.coalesce(F.col("vulnerability_id").isin(ignored), F.lit(False)))
    cve = F.nullif(_or("CVE", ""), F.lit(""))
    text = F.concat(_or("advisory", ""), F.lit("\n\nAffected versions: "), _or("affected_versions", "Unknown"), F.when(cve.isNotNull(), F.concat(F.lit("\nCVE: "), cve)).otherwise(""))
    data = F.create_map(*[x for k in ("package", "installed_version", "affected_versions", "vulnerability_id", "advisory") for x in (F.lit(k), F.col(k))], F.lit("cve"), _or("CVE", ""))
    one = F.lit(1)
    return r.select(
        F.concat(F.lit("Vulnerable dependency: "), _or("package", "Unknown"), F.lit(" "), _or("installed_version", "Unknown")).alias("title"), text.alias("description"),
        F.lit("vulnerable_dependency").alias("vulnerability_type"), maps.advisory_severity(F.col("severity"), F.col("advisory")).alias("severity"), F.lit(0.95).alias("confidence"),
        F.col("_path").alias("file_path"), one.alias("start_line"), one.alias("end_line"), F.lit(None).cast("int").alias("start_column"), F.lit(None).cast("int").alias("end_column"),
        F.lit("safety").alias("source_tool"), F.col("vulnerability_id").alias("rule_id"), cve.alias("cwe_id"), F.lit(None).cast("string").alias("code_snippet"), data.alias("metadata"),
    )


READERS = {"bandit": bandit, "semgrep": semgrep, "safety": safety}


def read_reports(spark: SparkSession, tool: str, path: str) -> DataFrame:
    """Findings of a tool's report files below ``path``, one document each."""
    return READERS[tool](spark.read.text(path, wholetext=True).withColumnRenamed("value", "json"))
