"""Joins by bands of lines, names found in texts, chunks that call each other, counts in passing."""

from __future__ import annotations

import uuid

from pyspark.sql import Observation
from pyspark.sql import functions as F

from quarry.functions import maps
from quarry.functions.durable import shared_top, written
from quarry.operators import bands, chunks, folds, structure, units
from quarry.plans.extra import _BLOCK, _sliced
from quarry.plans.more import _CONTENT, CODE_LINES, UNITS, _corpus, _functions, _lines
from quarry.plans.queries import DOCS, LINES, ORACLES, _map, query
from quarry.sources import bindings as b
from quarry.sources import sarif


@query(ORACLES["focus_chunks"])
def focus_chunks_by_lines(spark, d):
    c = bands.focus_chunks(b.source_files(spark, d), b.findings_docs(spark, d), order=["rule_id"]).where("finding_count is not null")
    return c.select("file_path", "start_line", "end_line", F.md5("content").alias("digest"), "token_count", "finding_count", "severity_score", F.round("focus_score", 6).alias("focus_score"), "has_critical")


_PARTS = "parts AS (SELECT file_path, (k * 25 + 1)::INTEGER AS start_line, least(k * 25 + 25, n)::INTEGER AS end_line FROM (SELECT file_path, max(line_no) AS n FROM code_lines GROUP BY 1), unnest(range(0, (n + 24) // 25)) AS t(k))"


def _parts(spark, d):
    """The files of code in chunks of 25 lines."""
    n = _lines(spark, d).groupBy("file_path").agg(F.max("line_no").alias("n"))
    told = n.select("file_path", "n", F.explode(F.sequence(F.lit(0), F.expr("(n - 1) div 25"))).alias("k"))
    return told.select("file_path", (F.col("k") * 25 + 1).cast("int").alias("start_line"), F.least(F.col("k") * 25 + 25, F.col("n")).cast("int").alias("end_line"))


@query(f"""WITH {UNITS}, {_PARTS} SELECT p.file_path, p.start_line, p.end_line, coalesce(array_to_string(list_sort(list(DISTINCT name) FILTER (name IS NOT NULL)), ','), '') AS units, count(*) FILTER (kind = 'function') AS functions, count(*) FILTER (kind = 'class') AS classes
 FROM parts p LEFT JOIN units u ON u.file_path = p.file_path AND u.start_line <= p.end_line AND p.start_line <= u.end_line GROUP BY 1, 2, 3""")
def chunk_context(spark, d):
    """Units by the chunks that they share a line with."""
    return bands.with_context(_parts(spark, d), units.heuristic_units(_lines(spark, d))).withColumn("units", F.array_join("units", ","))


@query(f"""WITH {UNITS}, {_CONTENT}, {_PARTS}, calls AS (SELECT DISTINCT file_path, name AS caller, unnest(regexp_extract_all(c, '([A-Za-z_0-9]+)\\s*\\(', 1)) AS callee FROM fc),
 held AS (SELECT p.file_path, p.start_line, u.name FROM parts p JOIN units u ON u.file_path = p.file_path AND u.start_line BETWEEN p.start_line AND p.end_line WHERE kind = 'function'),
 pairs AS (SELECT file_path, callee, (SELECT min(h.start_line) FROM held h WHERE h.file_path = c.file_path AND h.name = c.caller) AS source, (SELECT min(h.start_line) FROM held h WHERE h.file_path = c.file_path AND h.name = c.callee) AS target FROM calls c)
 SELECT DISTINCT file_path, source, target, callee AS function_name FROM pairs WHERE source IS NOT NULL AND target IS NOT NULL""")
def chunk_call_edges(spark, d):
    """Calls between the first chunks that hold caller and callee."""
    f = _functions(spark, d)
    calls = f.select("file_path", F.col("name").alias("caller"), F.explode(units.call_names(F.col("content"))).alias("callee"))
    inner = f.select("file_path", "name", F.col("start_line").alias("at"))
    held = bands.lines_within(_parts(spark, d), inner, "at").groupBy("file_path", "start_line").agg(F.collect_set("name").alias("names"))
    return units.chunk_calls(held.withColumns({"chunk_id": F.col("start_line"), "place": F.col("start_line")}), calls)


@query(f"""WITH {CODE_LINES}, f AS (SELECT DISTINCT regexp_extract(line, '^\\s*(?:class|def|async def)\\s+([A-Za-z_0-9]+)', 1) AS name FROM code_lines), w AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '\\s+')) AS w FROM documents)
 SELECT name FROM f WHERE name <> '' AND EXISTS (SELECT 1 FROM w WHERE contains(w, name))""")
def names_mentioned(spark, d):
    """Names of functions and classes that stand somewhere in the documents' texts, within longer words too."""
    named = units.heuristic_units(_lines(spark, d)).select("name").distinct()
    return structure.mentioned(named, b.table(spark, d, "documents").select(F.col("text").alias("description")))


@query(f"WITH {_BLOCK} SELECT count(*) AS chunks, count(*) FILTER (length(c) // 4 < 50) AS dropped, coalesce(sum(length(c) // 4) FILTER (length(c) // 4 < 50), 0)::BIGINT AS tokens_dropped, count(*) FILTER (length(c) // 4 >= 50) AS kept FROM blocks")
def dropped_in_passing(spark, d):
    """Chunks are fitted and written once; how many were too small is counted by the same scan."""
    seen = Observation()
    kept = written(chunks.fitted_counted(_sliced(spark, d), 50, 200, seen)).count()
    told = seen.get
    row = {x: F.lit(told[x]).cast("long").alias(x) for x in ("chunks", "dropped", "tokens_dropped")}
    return spark.range(1).select(*row.values(), F.lit(kept).cast("long").alias("kept"))


_DEPS = "list_sort(list_distinct(list_filter(string_split(lower(line), ' '), lambda x: length(x) > 7)))"


@query(f"""WITH RECURSIVE {LINES}, items AS (SELECT file_path, start_line, start_line AS end_line, deps, row_number() OVER (PARTITION BY file_path ORDER BY start_line) AS k FROM (SELECT file_path, line_no AS start_line, {_DEPS} AS deps FROM doc_lines WHERE line_no % 5 = 0)),
 f AS (SELECT file_path, k, [{{'a': start_line, 'z': end_line, 'd': deps, 'n': 1}}] AS g FROM items WHERE k = 1
  UNION ALL SELECT file_path, k, CASE WHEN p IS NULL THEN list_append(g, {{'a': start_line, 'z': end_line, 'd': deps, 'n': 1}}) ELSE list_concat(list_append(g[:p - 1], {{'a': least(g[p].a, start_line), 'z': greatest(g[p].z, end_line), 'd': list_sort(list_distinct(list_concat(g[p].d, deps))), 'n': g[p].n + 1}}), g[p + 1:]) END
  FROM (SELECT i.file_path, i.k, i.start_line, i.end_line, i.deps, f.g, nullif(list_position(list_transform(f.g, lambda x: abs(x.z - i.start_line) <= 3 OR len(list_intersect(x.d, i.deps)) >= 2), true), 0) AS p FROM f JOIN items i ON i.file_path = f.file_path AND i.k = f.k + 1))
 SELECT file_path, x.a::INTEGER AS start_line, x.z::INTEGER AS end_line, x.n AS members, array_to_string(x.d, ' ') AS deps FROM (SELECT file_path, unnest(arg_max(g, k)) AS x FROM f GROUP BY 1)""")
def merge_related_chunks(spark, d):
    """Every fifth line of a document as a chunk that depends on its long words."""
    deps = F.filter(F.split(F.lower("line"), " ", -1), lambda x: F.length(x) > 7)
    c = b.source_lines(spark, d).where("line_no % 5 = 0").select("file_path", F.col("line_no").alias("start_line"), F.col("line_no").alias("end_line"), deps.alias("deps"))
    return folds.merged_related(c).withColumn("deps", F.array_join("deps", " "))


@query(f"WITH {DOCS} SELECT vulnerability_type AS rule_id, {_map('severity', maps.SARIF_LEVEL, repr('warning'))} AS level, file_path AS uri, start_line, end_line, count(*) AS n FROM docs GROUP BY ALL")
def sarif_log(spark, d):
    """All findings written as one SARIF log of many files, and read back by what its root file names."""
    path = f"{shared_top(spark)}/quarry-sarif-{uuid.uuid4().hex}"
    sarif.write(b.findings_docs(spark, d).withColumn("description", F.concat("rule_id", F.lit(' "found"'))), path)
    return sarif.read(spark, path).groupBy("rule_id", "level", "uri", "start_line", "end_line").agg(F.count("*").alias("n"))
