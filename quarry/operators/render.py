"""Reports: rows for tables, SARIF, JSON, Markdown and HTML documents, and files of reports of any size."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.maps import SARIF_LEVEL, SEVERITIES, lookup, severity_ordinal
from quarry.functions.text import cut


def title_case(kind: Column) -> Column:
    return F.initcap(F.replace(kind, F.lit("_"), F.lit(" ")))


def report_lines(findings: DataFrame, order: list[str]) -> DataFrame:
    """position within the file, and one line of text for each finding, files apart so that no sort is global."""
    within = Window.partitionBy("file_path").orderBy(severity_ordinal(F.col("severity")).desc(), "confidence", *order)
    text = F.concat(F.upper("severity"), F.lit(" "), title_case(F.col("vulnerability_type")), F.lit(" at "), "file_path", F.lit(":"), F.col("start_line").cast("string"), F.lit(" - "), cut(F.col("description")))
    return findings.select("file_path", F.row_number().over(within).cast("long").alias("position"), text.alias("line"))


def sarif_rules(findings: DataFrame, order: list[str]) -> DataFrame:
    """id and name of each type, and its place by first occurrence."""
    first = findings.groupBy(F.col("vulnerability_type").alias("id")).agg(F.min(F.struct(*order)).alias("_first"))
    place = F.row_number().over(Window.orderBy("_first"))  # of the types, a few dozen
    return first.select("id", title_case(F.col("id")).alias("name"), place.cast("long").alias("place"))


def sarif_artifacts(findings: DataFrame) -> DataFrame:
    return findings.groupBy(F.col("file_path").alias("uri")).agg(F.count("*").alias("n_results"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """json: one SARIF result object for each finding."""
    region = F.struct(F.col("start_line").alias("startLine"), F.coalesce("end_line", "start_line").alias("endLine"))
    place = F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    level = lookup(SARIF_LEVEL, F.col("severity"), "warning")
    whole = F.struct(F.col("vulnerability_type").alias("ruleId"), F.struct(F.col("description").alias("text")).alias("message"), level.alias("level"), F.array(place).alias("locations"))
    return findings.select(F.to_json(whole).alias("json"))


def json_rows(findings: DataFrame) -> DataFrame:
    return findings.select(F.to_json(F.struct(*findings.columns)).alias("json"))


def document(findings: DataFrame, form: str, order: list[str], most: int | None = None) -> str:
    """A report on all findings, or on the ``most`` worst, as one text on the driver; ``files`` writes reports that are too
    large for one text. Forms: table, json, sarif, html, markdown
    (csv gives the table)."""
    top = findings.orderBy(severity_ordinal(F.col("severity")).desc(), "confidence", *order)
    top = top if most is None else top.limit(most)
    counts = {r[0]: r[1] for r in findings.groupBy("severity").count().collect()}
    rows = [r.asDict() for r in top.select("file_path", "start_line", "end_line", "source_tool", "severity", "vulnerability_type", "confidence", "description").collect()]
    if form == "json":
        return json.dumps({"counts": counts, "findings": rows}, indent=2)
    if form == "sarif":
        rules = list(dict.fromkeys(r["vulnerability_type"] for r in rows))
        results = [json.loads(x[0]) for x in sarif_results(top).collect()]
        run = {"tool": {"driver": {"name": "quarry", "rules": [{"id": x, "name": x.replace("_", " ").title()} for x in rules]}}, "artifacts": [{"location": {"uri": x}} for x in dict.fromkeys(r["file_path"] for r in rows)], "results": results}
        return json.dumps({"version": "2.1.0", "runs": [run]}, indent=2)
    summary = [(x, counts.get(x, 0)) for x in reversed(SEVERITIES)]
    if form == "markdown":
        lines = ["# Findings", "", "| Severity | Count |", "|---|---|", *(f"| {a} | {n} |" for a, n in summary), ""]
        lines += [f"{k}. **{r['severity']}** `{r['file_path']}:{r['start_line']}` {r['description']}" for k, r in enumerate(rows, 1)]
        return "\n".join(lines)
    if form == "html":
        cells = "".join(f"<tr><td>{html.escape(r['severity'])}</td><td>{html.escape(r['file_path'])}:{r['start_line']}</td><td>{html.escape(r['description'])}</td></tr>" for r in rows)
        return "<html><body><h1>Findings</h1><p>" + ", ".join(f"{a}: {n}" for a, n in summary) + f"</p><table>{cells}</table></body></html>"
    lines = [f"{a}: {n}" for a, n in summary]
    return "\n".join(lines + [f"{k}. [{r['severity']}] {r['vulnerability_type']} {r['file_path']}:{r['start_line']} ({r['confidence']:.2f})" for k, r in enumerate(rows, 1)])


def files(findings: DataFrame, form: str, order: list[str], path: str) -> None:
    """All findings, the worst first, as part files below ``path``, sorted over all of them; nothing meets on the driver.
    Forms: json and sarif (an object a line), csv (with a header), table (a line of text each)."""
    top = findings.orderBy(severity_ordinal(F.col("severity")).desc(), "confidence", *order)
    if form == "csv":
        plain = [x.name for x in top.schema.fields if x.dataType.typeName() not in ("array", "map", "struct")]
        top.select(*plain).write.option("header", True).csv(path)
        return
    text = F.concat_ws(" ", F.concat(F.lit("["), "severity", F.lit("]")), "vulnerability_type", F.concat("file_path", F.lit(":"), F.col("start_line").cast("string")), F.format_string("(%.2f)", "confidence"))
    rows = {"json": json_rows, "sarif": sarif_results}[form](top) if form != "table" else top.select(text.alias("line"))
    rows.write.text(path)
