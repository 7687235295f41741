"""Reference operators on chunks as queries with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import scores
from quarry.functions import text as tx
from quarry.operators import chunks, structure, units, usage, workflow
from quarry.operators import findings as fd
from quarry.operators import focus as fo
from quarry.plans.more import _CONTENT, _PATH, CODE, CODE_LINES, UNITS, _blocks, _corpus, _functions, _lines, _pick
from quarry.plans.queries import COUNTS, DEDUP, LINES, ORDER, ORDINAL, SYN, query
from quarry.sources import bindings as b

_BLOCK = f"{COUNTS}, blocks AS (SELECT concat('doc_', doc_id) AS file_path, s::INTEGER AS start_line, least(s + 4, n_lines)::INTEGER AS end_line, array_to_string(list_slice(string_split(text, chr(10)), s, least(s + 4, n_lines)), chr(10)) AS c FROM documents JOIN counts ON counts.file_path = concat('doc_', doc_id), unnest(range(1, n_lines + 1, 5)) AS t(s))"
_FIRST = " OR ".join(f"contains(f, '{x}')" for x in chunks.FIRST_LINE)


def _sliced(spark, d):
    return fo.sliced(_blocks(spark, d), b.source_files(spark, d))


@query(f"WITH {_BLOCK} SELECT file_path, start_line, NOT regexp_matches(c, '^\\s*$') AND length(c)//4 BETWEEN 50 AND 400 AS valid, {_FIRST} AS boundary FROM (SELECT *, string_split(regexp_replace(c, '^\\s+|\\s+$', '', 'g'), chr(10))[1] AS f FROM blocks)")
def chunk_validation(spark, d):
    return _sliced(spark, d).select("file_path", "start_line", chunks.valid(F.col("content"), 50, 400).alias("valid"), chunks.has_boundary(F.col("content")).alias("boundary"))


@query(f"WITH {_BLOCK} SELECT file_path, start_line, md5(substring(c, 1, 803)) AS digest FROM blocks WHERE length(c)//4 >= 50")
def chunk_fit(spark, d):
    return chunks.fitted(_sliced(spark, d), 50, 200).select("file_path", "start_line", F.md5("content").alias("digest"))


@query(f"""WITH {_BLOCK} SELECT file_path, start_line, md5(CASE WHEN len(l) <= 5 THEN c ELSE array_to_string(list_concat(list_concat(list_slice(l, 1, 3), ['{chunks.CUT_UNIT}']), list_slice(l, -2, -1)), chr(10)) END) AS digest FROM (SELECT concat('doc_', doc_id) AS file_path, 0 AS start_line, text AS c, string_split(text, chr(10)) AS l FROM documents)""")
def unit_shortening(spark, d):
    return b.source_files(spark, d).select("file_path", F.lit(0).alias("start_line"), F.md5(chunks.shortened_unit(F.col("content"))).alias("digest"))


_START = " OR ".join(f"contains(line, '{x}')" for x in chunks.STARTS)


@query(f"""WITH {UNITS}, {_CONTENT}, l AS (SELECT file_path, start_line, end_line, c, i::INTEGER - 1 AS k, p[i] AS line, len(p) AS n FROM (SELECT *, string_split(c, chr(10)) AS p FROM fc), unnest(range(1, len(p)+1)) AS t(i)),
 m AS (SELECT file_path, start_line, end_line, any_value(c) AS c, any_value(n) AS n, coalesce(min(k) FILTER (NOT regexp_matches(line, '^\\s*(#|$)') AND ({_START})), 0) AS a, coalesce(max(k) FILTER (NOT regexp_matches(line, '^\\s*(#|$)')) + 1, any_value(n)) AS z FROM l GROUP BY 1, 2, 3)
 SELECT file_path, (start_line + a)::INTEGER AS start_line, (CASE WHEN a > 0 OR z < n THEN start_line + z ELSE end_line END)::INTEGER AS end_line, md5(array_to_string(list_slice(string_split(c, chr(10)), a + 1, z), chr(10))) AS digest FROM m""")
def boundary_trimming(spark, d):
    return chunks.trimmed(_functions(spark, d)).select("file_path", "start_line", "end_line", F.md5("content").alias("digest"))


@query(f"""WITH {UNITS}, {_CONTENT}, l AS (SELECT file_path, start_line, c, i, p[i] AS line, sum(length(p[i])//4) OVER (PARTITION BY file_path, start_line ORDER BY i) AS s FROM (SELECT *, string_split(c, chr(10)) AS p FROM fc), unnest(range(1, len(p)+1)) AS t(i)),
 cut AS (SELECT file_path, start_line, min(i) AS cutoff FROM l WHERE i > 1 AND s > 27 GROUP BY 1, 2) SELECT fc.file_path, fc.start_line, md5(CASE WHEN length(c)//4 <= 30 THEN c WHEN cutoff IS NULL THEN c ELSE array_to_string(list_slice(string_split(c, chr(10)), 1, cutoff - 1), chr(10)) || chr(10) || '{chunks.CUT_FUNCTION}' END) AS digest FROM fc LEFT JOIN cut ON fc.file_path = cut.file_path AND fc.start_line = cut.start_line""")
def function_shortening(spark, d):
    return _functions(spark, d).select("file_path", "start_line", F.md5(chunks.shortened_function(F.col("content"), 30)).alias("digest"))


@query(f"""WITH RECURSIVE {CODE}, l AS (SELECT file_path, i::INTEGER AS k, regexp_matches(p[i], '^\\s*(class |def |async def )') AS d, len(p)::INTEGER AS n FROM (SELECT file_path, string_split(content, chr(10)) AS p FROM code), unnest(range(1, len(p)+1)) AS t(i)),
 f AS (SELECT file_path, k, 1 AS s, n FROM l WHERE k = 1 UNION ALL SELECT l.file_path, l.k, CASE WHEN l.d AND l.k - f.s > 3 THEN l.k ELSE f.s END, l.n FROM f JOIN l ON l.file_path = f.file_path AND l.k = f.k + 1) SELECT file_path, s AS start_line, max(k) AS end_line FROM f GROUP BY 1, 2""")
def heuristic_cuts(spark, d):
    return chunks.heuristic_cuts(_corpus(spark, d))


@query(f"""WITH {UNITS}, k AS (SELECT file_path, line_no, CASE WHEN regexp_matches(line, '^\\s*@') THEN 'd' WHEN regexp_matches(line, '^\\s*(#|$)') THEN 's' ELSE 'x' END AS c FROM code_lines)
 SELECT u.file_path, name, coalesce((SELECT min(k.line_no) FROM k WHERE k.file_path = u.file_path AND c = 'd' AND k.line_no < u.start_line AND k.line_no > coalesce((SELECT max(w.line_no) FROM k w WHERE w.file_path = u.file_path AND w.c = 'x' AND w.line_no < u.start_line), 0)), start_line)::INTEGER AS start_line, end_line FROM units u""")
def decorator_starts(spark, d):
    lines = _lines(spark, d)
    return chunks.decorator_start(units.heuristic_units(lines), lines).select("file_path", "name", "start_line", "end_line")


def _islands(name: str, pattern: str, reach: int) -> str:
    return f"""{name}_a AS (SELECT file_path, line_no, CASE WHEN line_no - lag(line_no) OVER (PARTITION BY file_path ORDER BY line_no) > {reach} THEN 1 ELSE 0 END AS a FROM code_lines WHERE regexp_matches(line, '{pattern}')),
 {name} AS (SELECT file_path, '{name}' AS chunk_type, min(line_no) AS start_line, max(line_no) AS end_line FROM (SELECT *, sum(a) OVER (PARTITION BY file_path ORDER BY line_no) AS g FROM {name}_a) GROUP BY file_path, g)"""


def _free(name: str, taken: str) -> str:
    return f"SELECT file_path, chunk_type, start_line, end_line FROM {name} x WHERE NOT EXISTS (SELECT 1 FROM {taken} t WHERE t.file_path = x.file_path AND x.start_line <= t.end_line AND t.start_line <= x.end_line)"


_IMPORTS, _ASSIGNS = r"^(import|from)\s", r"^[A-Za-z_][A-Za-z_0-9]*\s*=[^=]"
_MARGIN = r"^(class|def|async def)\s+([A-Za-z_0-9]+)"


@query(rf"""WITH {CODE_LINES}, {_islands("import", _IMPORTS, 2)}, {_islands("global", _ASSIGNS, 3)},
 edge AS (SELECT *, lead(line_no) OVER (PARTITION BY file_path ORDER BY line_no) - 1 AS before FROM code_lines WHERE NOT regexp_matches(line, '^\s*(#|$)') AND NOT regexp_matches(line, '^[ \t]')),
 margin AS (SELECT file_path, CASE regexp_extract(line, '{_MARGIN}', 1) WHEN 'class' THEN 'class' ELSE 'function' END AS chunk_type, line_no AS start_line, coalesce(before, last) AS end_line FROM edge JOIN (SELECT file_path, max(line_no) AS last FROM code_lines GROUP BY 1) USING (file_path) WHERE regexp_matches(line, '{_MARGIN}')),
 c AS (SELECT * FROM margin WHERE chunk_type = 'class'), f AS (SELECT * FROM margin WHERE chunk_type = 'function'), t1 AS (SELECT * FROM import UNION ALL {_free("c", "import")}), t2 AS (SELECT * FROM t1 UNION ALL {_free("f", "t1")}), t3 AS (SELECT * FROM t2 UNION ALL {_free("global", "t2")}),
 held AS (SELECT DISTINCT file_path, unnest(range(start_line, end_line + 1)) AS line_no FROM t3), m AS (SELECT l.*, t.line_no AS t, count(t.line_no) OVER (PARTITION BY l.file_path ORDER BY l.line_no) AS g FROM code_lines l LEFT JOIN held t ON l.file_path = t.file_path AND l.line_no = t.line_no)
 SELECT file_path, chunk_type, start_line::INTEGER AS start_line, end_line::INTEGER AS end_line FROM t3 UNION ALL SELECT file_path, 'block', min(line_no)::INTEGER, max(line_no)::INTEGER FROM m WHERE t IS NULL AND NOT regexp_matches(line, '^\s*(#|$)') GROUP BY file_path, g HAVING max(line_no) - min(line_no) >= 2""")
def semantic_chunks(spark, d):
    return chunks.semantic_chunks(_corpus(spark, d))


@query("SELECT concat('doc_', d.doc_id) AS file_path, md5(text) AS digest FROM documents d WHERE doc_id % 7 = 0 OR doc_id % 11 = 0 AND doc_id % 5 <> 0")
def differential_scan(spark, d):
    now = b.source_files(spark, d).select("file_path", "content", F.regexp_extract("file_path", "[0-9]+", 0).cast("long").alias("n"))
    before = now.where("n % 7 <> 0").where("n % 11 <> 0 or n % 5 = 0").union(now.where("n % 7 = 0").withColumn("content", F.concat("content", F.lit("!"))))
    return chunks.differential(before.select("file_path", "content"), now.select("file_path", "content")).select("file_path", F.md5("content").alias("digest"))


@query(f"WITH {LINES} SELECT file_path, count(*) FILTER (regexp_matches(line, '^[A-Z]')) AS capitals, count(*) FILTER (regexp_matches(line, '[0-9]')) AS with_digits FROM doc_lines GROUP BY 1 HAVING count(*) FILTER (regexp_matches(line, '[0-9]')) > 0")
def line_pattern_counts(spark, d):
    told = b.source_lines(spark, d).groupBy("file_path").agg(F.count_if(F.col("line").rlike("^[A-Z]")).alias("capitals"), F.count_if(F.col("line").rlike("[0-9]")).alias("with_digits"))
    return told.where("with_digits > 0")


_ALL = f"{UNITS}, {_CONTENT}, scored AS (SELECT file_path, name, start_line, end_line, c, len(list_distinct(regexp_extract_all(c, '([A-Za-z_0-9]+)\\s*\\(', 1))) AS calls, len(list_filter(string_split(c, chr(10)), lambda x: NOT regexp_matches(x, '^\\s*$'))) + 2 * (" + " + ".join(f"len(string_split(c, '{w}')) - 1" for w in units.COMPLEX_WORDS) + ") AS k FROM fc)"


@query(f"""WITH {_ALL} SELECT file_path, name, round(least(1.0, 0.5::DOUBLE + CASE WHEN starts_with(name, '_') THEN 0 ELSE 0.2::DOUBLE END + CASE WHEN k > 15 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN calls > 5 THEN 0.1::DOUBLE ELSE 0 END), 6) AS priority,
 CASE WHEN contains('call of verify() is weak; see load', name) THEN 0.8::DOUBLE WHEN regexp_matches(lower(name), '{"|".join(scores.FOCUS_NAMES)}') THEN 0.6::DOUBLE WHEN k > 15 THEN 0.4::DOUBLE ELSE 0::DOUBLE END AS focus FROM scored""")
def function_scores(spark, d):
    f = _functions(spark, d).withColumns({"complexity": units.complexity_class(F.col("content")), "calls": F.size(units.call_names(F.col("content")))})
    findings = spark.createDataFrame([("call of verify() is weak; see load",), (None,)], "description string")
    told = f.join(structure.mentioned(f.select("name").distinct(), findings).withColumn("m", F.lit(True)), "name", "left")
    return told.select("file_path", "name", F.round(scores.function_priority(F.col("name"), F.col("complexity"), F.col("calls")), 6).alias("priority"), scores.function_focus(F.col("name"), F.col("complexity"), F.coalesce("m", F.lit(False))).alias("focus"))


@query(f"WITH {UNITS} SELECT u.file_path, kind, name, start_line, end_line, md5(array_to_string(list_slice(string_split(content, chr(10)), start_line, end_line), chr(10))) AS digest FROM units u JOIN code USING (file_path) WHERE end_line - start_line >= 5")
def structural_chunks(spark, d):
    c = _corpus(spark, d)
    return structure.structural_chunks(c, units.heuristic_units(_lines(spark, d)), 5).select("file_path", "kind", "name", "start_line", "end_line", F.md5("content").alias("digest"))


@query(f"WITH {UNITS} SELECT c.file_path, c.start_line, c.end_line, array_to_string(list_sort(list(DISTINCT u.name)), ',') AS names FROM units c JOIN units u ON c.file_path = u.file_path AND u.start_line >= c.start_line AND u.end_line <= c.end_line WHERE c.kind = 'class' GROUP BY 1, 2, 3")
def units_in_chunks(spark, d):
    u = units.heuristic_units(_lines(spark, d))
    return structure.contained(u.where("kind = 'class'"), u).withColumn("names", F.array_join("names", ","))


@query(f"WITH {UNITS}, n AS (SELECT file_path, count(*) AS lines FROM code_lines GROUP BY 1) SELECT file_path, lines, count(name) FILTER (kind = 'function') AS functions, count(name) FILTER (kind = 'class') AS classes, round(count(name) / lines::DOUBLE, 6) AS units_per_line FROM n LEFT JOIN units USING (file_path) GROUP BY 1, 2")
def complexity_metrics(spark, d):
    lines = _lines(spark, d)
    return structure.complexity_metrics(units.heuristic_units(lines), lines).withColumn("units_per_line", F.round("units_per_line", 6))


@query(f"SELECT count(*) AS files, count(*) FILTER (regexp_matches(path, '{workflow.SCANNED}')) AS scanned, count(*) FILTER (regexp_matches(path, '{workflow.SCANNED}') AND regexp_matches(path, '{workflow.CRITICAL}')) AS critical, bool_or(regexp_matches(path, '{workflow.CRITICAL}')) AS touches_critical FROM (SELECT {_PATH} AS path FROM lineitem)")
def change_summary(spark, d):
    return workflow.change_summary(_pick(spark, d))


@query(f"WITH {SYN} SELECT * FROM (SELECT 'blocking' AS list, file_path, start_line, severity FROM syn WHERE severity = 'critical' ORDER BY confidence DESC, {ORDER} LIMIT 5) UNION ALL SELECT * FROM (SELECT 'warning' AS list, file_path, start_line, severity FROM syn WHERE severity IN ('high', 'medium') ORDER BY {ORDINAL} DESC, confidence DESC, {ORDER} LIMIT 5)")
def review_lists(spark, d):
    return workflow.review_lists(b.findings_synth(spark, d), b.ORDER).select("list", "file_path", "start_line", "severity")


@query(f"WITH {SYN} SELECT greatest(count(*) FILTER (severity = 'high') - 10, 0) AS more FROM syn")
def more_than_shown(spark, d):
    return workflow.more_than_shown(b.findings_synth(spark, d), "high")


@query(f"WITH {SYN} SELECT count(*) FILTER (severity='critical') AS critical, count(*) FILTER (severity='high') AS high, CASE WHEN count(*) FILTER (severity='critical') > 0 THEN 'block' WHEN count(*) FILTER (severity='high') > 0 THEN 'warn' ELSE 'pass' END AS action FROM syn")
def review_action(spark, d):
    return workflow.action(fd.severity_dashboard(b.findings_synth(spark, d)))


@query(f"WITH {_BLOCK} SELECT file_path, start_line, round((length(c)//4) / (end_line - start_line + 1)::DOUBLE, 6) AS density, greatest(0, 300 - length(c)//4 - 20) AS usable FROM blocks")
def chunk_density(spark, d):
    c = _sliced(spark, d)
    return c.select("file_path", "start_line", F.round(scores.density(F.col("token_count"), F.col("line_count")), 6).alias("density"), scores.usable_tokens(F.lit(300), F.col("token_count"), F.lit(20)).alias("usable"))


@query("SELECT user_id AS key, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::DOUBLE, 6) AS seconds FROM events GROUP BY 1")
def scan_duration(spark, d):
    e = b.usage_events(spark, d).groupBy("key").agg(F.min("ts").alias("a"), F.max("ts").alias("z"))
    return e.select("key", F.round(scores.duration_seconds(F.col("a"), F.col("z")), 6).alias("seconds"))


_SOFT = r"""^\s*(@|#|\"\"\"|''''''|$)"""


_COMMENTED = "replace(replace(text, '. ', chr(10) || '# '), ', ', chr(10) || chr(10) || '@')"


@query(f"""WITH commented AS (SELECT concat('doc_', doc_id) AS file_path, string_split({_COMMENTED}, chr(10)) AS l FROM documents), k AS (SELECT file_path, i::INTEGER AS line_no, len(l)::INTEGER AS n, regexp_matches(l[i], '{_SOFT}') AS soft, regexp_matches(l[i], '^\\s*(#|$)') AND i < len(l) AS b FROM commented, unnest(range(1, len(l)+1)) AS t(i)),
 w AS (SELECT *, coalesce(max(CASE WHEN NOT soft THEN line_no END) OVER f, 0) AS wall, CASE WHEN b AND lead(b, 1, false) OVER f AND lead(b, 2, false) OVER f THEN 2 WHEN b AND lead(b, 1, false) OVER f THEN 1 ELSE 0 END AS m FROM k WINDOW f AS (PARTITION BY file_path ORDER BY line_no)),
 y AS (SELECT *, CASE WHEN lag(soft, 2, false) OVER f THEN lag(wall, 2) OVER f + 1 ELSE line_no END AS a, CASE n - line_no WHEN 0 THEN m WHEN 1 THEN lead(m, 1) OVER f ELSE lead(m, 2) OVER f END AS z FROM w WINDOW f AS (PARTITION BY file_path ORDER BY line_no))
 SELECT file_path, line_no AS start_line, least(line_no + 2, n) AS end_line, a::INTEGER AS logical_start, (least(line_no + 2, n) + z)::INTEGER AS logical_end FROM y WHERE line_no % 3 = 1""")
def logical_bounds(spark, d):
    commented = F.replace(F.replace(F.col("content"), F.lit(". "), F.lit("\n# ")), F.lit(", "), F.lit("\n\n@"))
    lines = tx.lines(b.source_files(spark, d).select("file_path", commented.alias("content")), last=True)
    spans = lines.groupBy("file_path").agg(F.max("line_no").alias("n")).select("file_path", "n", F.explode(F.expr("sequence(1, n, 3)")).alias("start_line"))
    spans = spans.select("file_path", "start_line", F.least(F.col("start_line") + 2, F.col("n")).cast("int").alias("end_line"))
    return chunks.logical_bounds(spans, lines).select("file_path", "start_line", "end_line", "logical_start", "logical_end")


_ENDS = "replace(replace(text, '. ', chr(13) || chr(10)), ', ', chr(13))"
_PARTS = f"string_split(replace(replace({_ENDS}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))"


@query(f"""SELECT doc_id, len(a)::INTEGER AS split_lines, (len(a) - CASE WHEN a[-1] = '' THEN 1 ELSE 0 END)::INTEGER AS lines, (len(e) - CASE WHEN e[-1] = '' THEN 1 ELSE 0 END)::INTEGER AS every_end
 FROM (SELECT doc_id, string_split({_ENDS}, chr(10)) AS a, {_PARTS} AS e FROM documents)""")
def line_rules(spark, d):
    text = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit("\r\n")), F.lit(", "), F.lit("\r"))
    told = b.table(spark, d, "documents").where("text is not null").select("doc_id", text.alias("t"))
    size = lambda *rule: F.size(tx.line_array(F.col("t"), *rule))
    return told.select("doc_id", size(False, True).alias("split_lines"), size().alias("lines"), size(True).alias("every_end"))


@query("""SELECT user_id AS key, event_id, rank::INTEGER AS rank, rank <= 2 AS shown FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events WHERE event_type = 'error') WHERE rank <= 20""")
def recent_errors(spark, d):
    e = b.usage_events(spark, d).where("kind = 'error'")
    return usage.recent_errors(e, "key", ["ts", "event_id"], 20, 2).select("key", "event_id", "rank", "shown")


@query("""WITH k AS (SELECT user_id AS key, max(ts) AS used, max(ts) FILTER (event_type <> 'error') AS written FROM events GROUP BY 1), r AS (SELECT key, row_number() OVER (ORDER BY used DESC, key) AS rank FROM k WHERE date_diff('microsecond', written, (SELECT max(ts) FROM events)) <= 86400000000)
 SELECT key, rank::INTEGER AS rank, CASE WHEN rank <= 16 THEN 'first' ELSE 'second' END AS tier FROM r WHERE rank <= 64""")
def cache_state(spark, d):
    return usage.cache_state(b.usage_events(spark, d).select("key", "ts", F.col("hit").alias("stored")), 64, 86_400)


@query("SELECT doc_id, md5(base64(encode(text))) AS digest FROM documents WHERE text IS NOT NULL")
def diff_base64(spark, d):
    return b.table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(workflow.encoded(F.col("text"))).alias("digest"))


@query(f"""WITH {DEDUP}, m AS (SELECT signature AS s, source_tool AS t, arg_max(l_orderkey::VARCHAR || '/' || l_linenumber::VARCHAR, rn) AS pos FROM ranked WHERE rn > 1 GROUP BY 1, 2),
 own AS (SELECT signature, l_orderkey::VARCHAR || '/' || l_linenumber::VARCHAR AS pos, n FROM ranked WHERE rn = 1)
 SELECT signature, pos AS own, coalesce((SELECT string_agg(t || '_metadata={{"at":"' || m.pos || '"}}', ' ' ORDER BY t) FROM m WHERE s = signature), '') AS others FROM own""")
def dedup_metadata(spark, d):
    at = F.concat(F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string"))
    out = fd.deduplicated(b.findings_synth(spark, d).withColumn("metadata", F.create_map(F.lit("at"), at)), b.ORDER, columns=[])
    others = F.array_sort(F.filter(F.map_entries("metadata"), lambda e: e["key"] != "at"))
    return out.select("signature", F.col("metadata")["at"].alias("own"), F.array_join(F.transform(others, lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ").alias("others"))
