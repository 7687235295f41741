"""Results of strategies united, and operators on reports and files that had no query."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry.functions.durable import shared_top
from quarry.operators import findings as fd
from quarry.operators import focus as fo
from quarry.operators import render, results, strategies
from quarry.plans.more import _blocks
from quarry.plans.queries import _ZONES, COUNTS, SYN, WEIGHT, _zones, query
from quarry.sources import bindings as b
from quarry.sources import files as sf

_TOLD = f"""{_ZONES}, blocks AS (SELECT file_path, s::INTEGER AS start_line, least(s + 4, n_lines)::INTEGER AS end_line FROM counts, unnest(range(1, n_lines + 1, 5)) AS t(s)),
 near AS (SELECT 'focus' AS strategy, file_path, start_line AS first, lead(start_line) OVER w AS second, end_line AS e FROM zones WINDOW w AS (PARTITION BY file_path ORDER BY start_line, end_line) UNION ALL SELECT 'ast', file_path, start_line, lead(start_line) OVER w, end_line FROM blocks WINDOW w AS (PARTITION BY file_path ORDER BY start_line, end_line)),
 told AS (SELECT strategy, 'relationship' AS kind, file_path, first, second, 0.4::DOUBLE AS strength, 'sequential' AS label, NULL::VARCHAR AS message FROM near WHERE second - e BETWEEN 0 AND 5
 UNION ALL SELECT strategy, 'overlap', file_path, e, second, NULL, NULL, NULL FROM near WHERE second IS NOT NULL AND e >= second - 5
 UNION ALL SELECT 'focus', 'warning', file_path, NULL, NULL, NULL, NULL, 'no findings' FROM counts WHERE file_path NOT IN (SELECT file_path FROM zones)
 UNION ALL SELECT 'ast', 'error', file_path, NULL, NULL, NULL, NULL, 'no lines' FROM counts WHERE n_lines = 0
 UNION ALL SELECT 'ast', 'warning', file_path, NULL, NULL, NULL, NULL, 'long file' FROM counts WHERE n_lines > 40)"""


def _told(spark, d):
    counts = fo.line_counts(b.source_files(spark, d))
    zones, blocks = _zones(spark, d).select("file_path", "start_line", "end_line"), _blocks(spark, d)
    note = lambda rows, text: rows.select("file_path", F.lit(text).alias("message"))

    def of(chunks):
        ends = fo.overlaps(chunks)
        named = chunks.select("file_path", F.col("start_line").alias("first"), F.col("end_line").alias("first_end"))
        # neighbours that don't overlap: a chunk's end and the next one's start at most five lines on
        after = ends.where(F.col("next_start").between(F.col("first_end"), F.col("first_end") + 5)).join(named, ["file_path", "first_end"])
        related = after.select("file_path", "first", F.col("next_start").alias("second"), F.lit(0.4).alias("strength"), F.lit("sequential").alias("label"))
        return {"relationship": related, "overlap": ends.select("file_path", F.col("first_end").alias("first"), F.col("next_start").alias("second"))}

    focus = of(zones) | {"warning": note(counts.join(zones, "file_path", "left_anti"), "no findings")}
    ast = of(blocks) | {"error": note(counts.where("n_lines = 0"), "no lines"), "warning": note(counts.where("n_lines > 40"), "long file")}
    return results.united({"focus": focus, "ast": ast})


@query(f"WITH {_TOLD} SELECT * FROM told")
def hybrid_result(spark, d):
    """Relationships, overlaps, errors and warnings of two strategies on the documents."""
    return _told(spark, d)


@query(f"WITH {_TOLD} SELECT file_path, count(*) FILTER (kind = 'relationship') AS relationships, count(*) FILTER (kind = 'overlap') AS overlaps, count(*) FILTER (kind = 'error') AS errors, count(*) FILTER (kind = 'warning') AS warnings, count(*) FILTER (kind = 'error') = 0 AS ok FROM told GROUP BY 1")
def hybrid_summary(spark, d):
    return results.summary(_told(spark, d))


@query(f"WITH {SYN} SELECT file_path, start_line, end_line - 1 AS end_line, count(*) AS n FROM syn WHERE end_line - 1 >= start_line GROUP BY ALL")
def valid_span_filter(spark, d):
    """Findings whose end, moved up by a line, isn't before their start."""
    moved = b.findings_synth(spark, d).withColumn("end_line", F.col("end_line") - 1)
    return fd.valid_spans(moved).groupBy("file_path", "start_line", "end_line").agg(F.count("*").alias("n"))


@query(f"WITH {_ZONES}, {COUNTS.replace('counts AS', 'sized AS')}, p AS (SELECT z.file_path, start_line, end_line, priority, round(max({WEIGHT} * confidence), 6) AS focus FROM zones z JOIN (SELECT file_path, start_line AS at, severity, confidence FROM docs) f ON f.file_path = z.file_path AND f.at BETWEEN start_line AND end_line GROUP BY ALL) SELECT file_path, start_line, end_line, row_number() OVER (PARTITION BY file_path ORDER BY focus DESC, round(priority, 6) DESC, start_line, end_line)::INTEGER AS position FROM p")
def chunks_best_first(spark, d):
    """The focus chunks of each file, the most telling first."""
    z = _zones(spark, d).withColumn("chunk_id", fo.chunk_id("file_path", "start_line", "end_line"))
    pairs = fo.associated(z, b.findings_docs(spark, d))
    focus = pairs.groupBy("chunk_id").agg(F.round(F.max(fo.weighted(pairs)), 6).alias("focus"))
    told = z.join(focus, "chunk_id").withColumn("priority", F.round("priority", 6))
    return strategies.best_first(told).select("file_path", "start_line", "end_line", "position")


@query(f"WITH {SYN} SELECT file_path, count(*) AS n, sum(start_line)::BIGINT AS lines FROM syn GROUP BY 1")
def report_json(spark, d):
    """Findings written as rows of JSON, read again and counted."""
    told = render.json_rows(b.findings_synth(spark, d)).select(F.from_json("json", "file_path string, start_line int").alias("r"))
    return told.groupBy("r.file_path").agg(F.count("*").alias("n"), F.sum("r.start_line").alias("lines"))


@query("SELECT lang, source, count(*) AS texts, sum(strlen(text) + 1)::BIGINT AS size FROM documents WHERE lang <> 'de' AND text NOT LIKE '%' || chr(10) || '%' GROUP BY 1, 2")
def file_tree(spark, d):
    """Texts of one line written as files of a folder tree; the tree read by extension, one folder left out."""
    path = f"{shared_top(spark)}/quarry-tree-{uuid.uuid4().hex}"
    docs = b.table(spark, d, "documents").where("not contains(text, '\n')")
    docs.select("lang", "source", "text").write.partitionBy("lang", "source").text(path)
    read = sf.read(spark, path, [".txt"], ["lang=de"])
    part = lambda x: F.regexp_extract("file_path", f"{x}=([^/]*)", 1).alias(x)
    ends = F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit("")))
    return read.groupBy(part("lang"), part("source")).agg(F.sum(ends).alias("texts"), F.sum("size_bytes").alias("size"))
