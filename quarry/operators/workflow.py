"""What a change touches, and what a set of reports holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Extensions worth a scan, and parts of paths that make a change critical.
SCANNED = r"\.(py|js|ts|java|php|rb|go|rs|cpp|c|h|sql|yaml|yml|json|xml|sh|ps1)$"
CRITICAL = r"(auth|security|crypto|login|admin|api|config)"


def changed_files(paths: DataFrame, path: str = "path") -> DataFrame:
    """``paths`` that are worth a scan, with critical."""
    return paths.where(F.col(path).rlike(SCANNED)).withColumn("critical", F.col(path).rlike(CRITICAL))


def diff_lines(patches: DataFrame, patch: str = "patch") -> DataFrame:
    """The added lines and hunk heads of patches."""
    rest = [x for x in patches.columns if x != patch]
    told = patches.select(*rest, F.posexplode(F.split(patch, "\n", -1)).alias("k", "line"))
    return told.where(F.col("line").rlike(r"^(\+[^+]|@@)")).select(*rest, (F.col("k") + 1).alias("line_no"), "line")


def parses(json: Column) -> Column:
    """Whether a text is one JSON value and nothing more; a null isn't. Spark's parser stops behind the first value (of
    ``42 and more``), so the text must parse both as an array's item and as an object's member: nothing but one value does."""
    within = lambda a, z: F.try_parse_json(F.concat(F.lit(a), json, F.lit(z))).isNotNull()
    return within("[", "]") & within('{"a":', "}")


def report_counts(reports: DataFrame, json: str = "json") -> DataFrame:
    """tool, n, status of each report: results or vulnerabilities in it; ``error`` if it doesn't parse, ``empty`` if blank."""
    size = lambda path: F.coalesce(F.json_array_length(F.get_json_object(json, path)), F.lit(0))
    blank, bad = F.col(json).rlike(r"^\s*$"), ~parses(F.col(json))
    n = F.greatest(size("$.results"), size("$.vulnerabilities"))
    return reports.select("tool", F.when(blank | bad, 0).otherwise(n).cast("long").alias("n"), F.when(blank, "empty").when(bad, "error").otherwise("read").alias("status"))


def missing(catalog: DataFrame, files: DataFrame, on: str = "file") -> DataFrame:
    """Catalogued files that aren't there."""
    return catalog.join(files.select(on), on, "left_anti")


def model_reply(reply: Column, schema: str) -> Column:
    """A model's JSON reply, code fences taken off; null if it doesn't parse."""
    return F.from_json(F.regexp_replace(reply, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""), schema)


def change_summary(paths: DataFrame, path: str = "path") -> DataFrame:
    """One row: files, files worth a scan, critical ones among these, and whether any critical path is touched."""
    scanned, critical = F.col(path).rlike(SCANNED), F.col(path).rlike(CRITICAL)
    return paths.agg(F.count("*").alias("files"), F.count_if(scanned).alias("scanned"), F.count_if(scanned & critical).alias("critical"), F.bool_or(critical).alias("touches_critical"))


def review_lists(findings: DataFrame, order: list[str], most: int = 5) -> DataFrame:
    """list, position and the findings of a review: the ``most`` first blocking (critical) ones and warnings (high, medium)."""
    from quarry.functions.maps import severity_ordinal

    parts = []
    for name, levels in (("blocking", ["critical"]), ("warning", ["high", "medium"])):
        top = findings.where(F.col("severity").isin(levels)).orderBy(severity_ordinal(F.col("severity")).desc(), F.desc("confidence"), *order).limit(most)
        parts.append(top.withColumn("list", F.lit(name)))
    return parts[0].unionByName(parts[1])


def more_than_shown(findings: DataFrame, severity: str, shown: int = 10) -> DataFrame:
    """One row: how many findings of a severity there are beyond those shown."""
    return findings.agg(F.greatest(F.count_if(F.col("severity") == severity) - shown, F.lit(0)).alias("more"))


def action(dashboard: DataFrame) -> DataFrame:
    """block with critical findings, warn with high ones, else pass."""
    return dashboard.select("critical", "high", F.when(F.col("critical") > 0, "block").when(F.col("high") > 0, "warn").otherwise("pass").alias("action"))


def read_templates(spark, path: str) -> DataFrame:
    """file, json, valid of the JSON documents below ``path``; invalid ones stay, marked."""
    docs = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("json"))
    return docs.select(F.regexp_extract("file", r"([^/]+)\.json$", 1).alias("file"), "json", parses(F.col("json")).alias("valid"))


def prompts(findings: DataFrame) -> DataFrame:
    """prompt: the question about each finding that a model is asked; replies come back as a table (``model_reply``)."""
    parts = [F.lit("Is this finding real? Reply as JSON with valid, remediation_advice and fix_suggestion.\nType: "), F.col("vulnerability_type"), F.lit("\nSeverity: "), F.col("severity"), F.lit("\nDescription: "), F.col("description")]
    return findings.withColumn("prompt", F.concat(*parts))


def encoded(diff: Column) -> Column:
    """A diff as workflows hand it on: base64 of its UTF-8 bytes in one line; null stays null."""
    return F.replace(F.base64(F.encode(diff, "UTF-8")), F.lit("\r\n"), F.lit(""))
