"""The reference operators as queries over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import budget, maps
from quarry.functions import text as tx
from quarry.operators import findings as fd
from quarry.operators import focus as fo
from quarry.operators import folds, graph, usage
from quarry.sources import bindings as b

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return put


def _case(value: str, names: list[str]) -> str:
    return f"CASE {value} " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(names)) + " END"


def _map(column: str, table: dict, default: str = "NULL") -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in table.items()) + f" ELSE {default} END"


SYN = f"""syn AS (SELECT concat('order_', l_orderkey // 8) AS file_path, CAST(1 + (l_linenumber-1)*4 + l_partkey % 5 AS INTEGER) AS start_line,
 CAST(1 + (l_linenumber-1)*4 + l_partkey % 5 + l_suppkey % 3 AS INTEGER) AS end_line, {_case('l_suppkey % 3', b.TOOLS)} AS source_tool,
 {_case('l_partkey % 5', b.LEVELS)} AS severity, {_case('(l_partkey + l_suppkey) % 6', b.TYPES)} AS vulnerability_type,
 CAST(round(l_discount*100) AS INTEGER) / CAST(10.0 AS DOUBLE) AS confidence,
 concat('Possible ', replace({_case('(l_partkey + l_suppkey) % 6', b.TYPES)}, '_', ' ')) AS description, {', '.join(b.ORDER)} FROM lineitem)"""
LINES = """doc_lines AS (SELECT concat('doc_', doc_id) AS file_path, CAST(i AS INTEGER) AS line_no, l[i] AS line
 FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l)+1)) AS t(i) WHERE NOT (i = len(l) AND l[i] = ''))"""
_RULES = " UNION ALL ".join(
    f"SELECT file_path, line_no AS start_line, line_no AS end_line, '{r}' AS rule_id, '{t}' AS vulnerability_type, '{s}' AS severity, CAST({c} AS DOUBLE) AS confidence FROM doc_lines WHERE regexp_matches(line, '{p}')"
    for r, p, t, s, c in b.LINE_RULES
)
DOCS = f"{LINES}, docs AS ({_RULES})"
COUNTS = """counts AS (SELECT concat('doc_', doc_id) AS file_path, CAST(len(string_split(text, chr(10))) - CASE WHEN text = '' OR text LIKE '%' || chr(10) THEN 1 ELSE 0 END AS INTEGER) AS n_lines FROM documents)"""
WEIGHT = _map("severity", maps.SEVERITY_WEIGHT)
ORDINAL = _map("severity", {x: k for k, x in enumerate(maps.SEVERITIES)})
LEVEL = "CASE WHEN confidence >= 0.9 THEN 'very_high' WHEN confidence >= 0.7 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' WHEN confidence >= 0.3 THEN 'low' ELSE 'very_low' END"
ORDER = ", ".join(b.ORDER)


def _syn(spark: SparkSession, d: str) -> DataFrame:
    return b.findings_synth(spark, d)


@query(f"WITH {SYN} SELECT {LEVEL} AS level, count(*) AS n, min(confidence) AS least, max(confidence) AS most FROM syn GROUP BY 1")
def confidence_level_bucket(spark, d):
    return _syn(spark, d).groupBy(maps.confidence_level(F.col("confidence")).alias("level")).agg(F.count("*").alias("n"), F.min("confidence").alias("least"), F.max("confidence").alias("most"))


_WORDS = ["ERROR", "Warning", "INFO", "critical", "High", "strange"]
_SEV = "CASE tool WHEN 'bandit' THEN " + _map("w", maps.TOOL_SEVERITY["bandit"], "'medium'") + " WHEN 'semgrep' THEN " + _map("w", maps.TOOL_SEVERITY["semgrep"], "'medium'") + " ELSE " + _map("w", maps.TOOL_SEVERITY["safety"], "'medium'") + " END"


@query(f"SELECT tool, word, {_SEV} AS severity, count(*) AS n FROM (SELECT {_case('l_suppkey % 3', b.TOOLS)} AS tool, {_case('l_partkey % 6', _WORDS)} AS word, lower({_case('l_partkey % 6', _WORDS)}) AS w FROM lineitem) GROUP BY 1, 2, 3")
def severity_normalize(spark, d):
    l = b.table(spark, d, "lineitem")  # noqa: E741
    told = l.select(b._pick(b.TOOLS, F.col("l_suppkey") % 3).alias("tool"), b._pick(_WORDS, F.col("l_partkey") % 6).alias("word"))
    return told.groupBy("tool", "word", maps.tool_severity(F.col("tool"), F.col("word")).alias("severity")).agg(F.count("*").alias("n"))


_TEST = {x: label for label, ids in maps.TEST_TYPES.items() for x in ids.split()}


@query(f"SELECT t AS test_id, {_map('t', _TEST, repr('other'))} AS vulnerability_type, count(*) AS n FROM (SELECT concat('B', 100 + l_partkey % 605) AS t FROM lineitem) GROUP BY 1, 2")
def rule_type_lookup(spark, d):
    t = b.table(spark, d, "lineitem").select(F.concat(F.lit("B"), (100 + F.col("l_partkey") % 605).cast("string")).alias("test_id"))
    return t.groupBy("test_id", maps.test_type(F.col("test_id")).alias("vulnerability_type")).agg(F.count("*").alias("n"))


_IDS = ["python.lang.security.sqli", "js.xss.reflected", "go.cmd-injection", "generic.Hardcoded.Token", "ruby.yaml.load", "java.path-traversal", "owasp.md5", "misc.author-check", "plain.rule"]
_MSG = ["SQL injection", "shell inject", "injected template", "all fine"]


def _words_sql(column: str, rows) -> str:
    return " ".join("WHEN " + " OR ".join(f"contains({column}, '{w}')" for w in words) + f" THEN '{label}'" for label, words in rows)


_RULE_SQL = f"CASE {_words_sql('lower(rule_id)', maps.RULE_WORDS)} WHEN contains(lower(message), 'inject') THEN CASE WHEN contains(lower(message), 'sql') THEN 'sql_injection' WHEN contains(lower(message), 'command') OR contains(lower(message), 'shell') OR contains(lower(message), 'os') THEN 'command_injection' ELSE 'code_injection' END ELSE 'other' END"


@query(f"""SELECT rule_id, message, {_RULE_SQL} AS vulnerability_type, CASE told WHEN 'high' THEN 0.9::DOUBLE WHEN 'low' THEN 0.5::DOUBLE ELSE CASE WHEN contains(rule_id,'owasp') OR contains(rule_id,'cwe') OR contains(rule_id,'security') THEN 0.85::DOUBLE ELSE 0.75::DOUBLE END END AS confidence, count(*) AS n
 FROM (SELECT {_case('l_partkey % 9', _IDS)} AS rule_id, {_case('l_suppkey % 4', _MSG)} AS message, CASE l_linenumber % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'none' END AS told FROM lineitem) GROUP BY ALL""")
def rule_keyword_classify(spark, d):
    l = b.table(spark, d, "lineitem")  # noqa: E741
    told = l.select(b._pick(_IDS, F.col("l_partkey") % 9).alias("rule_id"), b._pick(_MSG, F.col("l_suppkey") % 4).alias("message"), b._pick(["high", "low", "none"], F.col("l_linenumber") % 3).alias("told"))
    return told.groupBy("rule_id", "message", maps.rule_type(F.col("rule_id"), F.col("message")).alias("vulnerability_type"), maps.rule_confidence(F.col("rule_id"), F.col("told")).alias("confidence")).agg(F.count("*").alias("n"))


_ADV = ["Remote code execution in parser", "arbitrary code run", "moderate leak", "minor issue", "something else", "SEVERE flaw"]


@query(f"""SELECT coalesce(sev, '-') AS stated, advisory, coalesce({_map("sev", maps.ADVISORY_SHIFT)}, CASE {_words_sql('lower(advisory)', maps.ADVISORY_WORDS)} ELSE 'high' END) AS severity, count(*) AS n
 FROM (SELECT CASE l_suppkey % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' END AS sev, {_case('l_partkey % 6', _ADV)} AS advisory FROM lineitem) GROUP BY ALL""")
def advisory_severity(spark, d):
    l = b.table(spark, d, "lineitem")  # noqa: E741
    stated = F.get(F.array(*[F.lit(x) for x in ("critical", "high", "medium", "low")]), (F.col("l_suppkey") % 5).cast("int"))
    told = l.select(stated.alias("sev"), b._pick(_ADV, F.col("l_partkey") % 6).alias("advisory"))
    return told.groupBy(F.coalesce("sev", F.lit("-")).alias("stated"), "advisory", maps.advisory_severity(F.col("sev"), F.col("advisory")).alias("severity")).agg(F.count("*").alias("n"))


@query(f"WITH {SYN} SELECT source_tool, severity, vulnerability_type, count(*) AS n, min(confidence) AS least FROM syn WHERE confidence >= 0.3 AND {ORDINAL} >= 2 AND vulnerability_type IN ('sql_injection','xss') GROUP BY ALL")
def threshold_filter(spark, d):
    kept = fd.included(_syn(spark, d), 0.3, "medium", ["sql_injection", "xss"])
    return kept.groupBy("source_tool", "severity", "vulnerability_type").agg(F.count("*").alias("n"), F.min("confidence").alias("least"))


@query(f"WITH {SYN} SELECT vulnerability_type, count(*) AS n FROM syn WHERE severity IN ('critical', 'high') GROUP BY 1")
def high_severity_findings(spark, d):
    return fd.high_severity(_syn(spark, d)).groupBy("vulnerability_type").agg(F.count("*").alias("n"))


@query(f"WITH {SYN} SELECT source_tool, count(*) AS n, count(DISTINCT file_path) AS files FROM syn GROUP BY 1")
def tool_union(spark, d):
    parts = [_syn(spark, d).where(F.col("source_tool") == x) for x in b.TOOLS]
    return fd.union_tools(*parts).groupBy("source_tool").agg(F.count("*").alias("n"), F.countDistinct("file_path").alias("files"))


_SIG = "md5(concat_ws('|', file_path, CAST(start_line AS VARCHAR), vulnerability_type, substring(lower(description), 1, 100)))"
_RANKED = f"""ranked AS (SELECT *, {_SIG} AS signature, row_number() OVER (PARTITION BY {_SIG} ORDER BY {_map('source_tool', maps.TOOL_PRIORITY)} DESC, confidence DESC, severity DESC, {ORDER}) AS rn, count(*) OVER (PARTITION BY {_SIG}) AS n FROM syn)"""
DEDUP = f"""{SYN}, {_RANKED}, best AS (SELECT signature, file_path, start_line, end_line, source_tool, severity, vulnerability_type, {LEVEL} AS confidence_level, least(1.0::DOUBLE, confidence + least(CAST(0.1 AS DOUBLE)*(n-1), 0.3::DOUBLE)) AS boosted, n FROM ranked WHERE rn = 1)"""


@query(f"WITH {DEDUP} SELECT signature, file_path, start_line, end_line, source_tool, severity, vulnerability_type FROM best")
def dedup_best(spark, d):
    return fd.deduplicated(_syn(spark, d), b.ORDER, columns=["file_path", "start_line", "end_line", "severity", "vulnerability_type"]).select("signature", "file_path", "start_line", "end_line", "source_tool", "severity", "vulnerability_type")


@query(f"""WITH {DEDUP} SELECT signature, n, confidence_level, round(boosted, 6) AS confidence, coalesce(tools, '') AS also_detected_by FROM best LEFT JOIN
 (SELECT signature AS s, string_agg(source_tool, ', ' ORDER BY rn) AS tools FROM ranked WHERE rn > 1 GROUP BY 1) ON s = signature""")
def dedup_merge(spark, d):
    return fd.deduplicated(_syn(spark, d), b.ORDER, columns=[]).select("signature", "n", "confidence_level", F.round("confidence", 6).alias("confidence"), "also_detected_by")


@query(f"""WITH {SYN} SELECT 'severity' AS dimension, severity AS value, count(*) AS n FROM syn GROUP BY 2 UNION ALL SELECT 'vulnerability_type', vulnerability_type, count(*) FROM syn GROUP BY 2 UNION ALL SELECT 'source_tool', source_tool, count(*) FROM syn GROUP BY 2""")
def counts_by_dimension(spark, d):
    return fd.counts_by_dimension(_syn(spark, d))


_DASH = "SELECT count(*) AS total, count(*) FILTER (severity='critical') AS critical, count(*) FILTER (severity='high') AS high, count(*) FILTER (severity='medium') AS medium, count(*) FILTER (severity='low') AS low FROM syn"


@query(f"WITH {SYN} {_DASH}")
def severity_dashboard(spark, d):
    return fd.severity_dashboard(_syn(spark, d))


@query(f"WITH {SYN} SELECT critical, high, CASE WHEN critical > 0 OR high > 10 THEN 'failure' WHEN high > 0 THEN 'success_review' ELSE 'success' END AS status, critical > 0 OR high > 5 AS alert FROM ({_DASH})")
def status_gate(spark, d):
    return fd.status_gate(fd.severity_dashboard(_syn(spark, d)))


@query(f"WITH {SYN} SELECT vulnerability_type, count(*) AS n FROM syn GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5")
def top_types(spark, d):
    return fd.top_types(_syn(spark, d))


@query(f"WITH {SYN} SELECT row_number() OVER (ORDER BY {ORDINAL} DESC, confidence, {ORDER}) AS position, file_path, start_line, severity, confidence FROM syn ORDER BY 1 LIMIT 50")
def report_order_topk(spark, d):
    top = fd.report_order(_syn(spark, d), b.ORDER, 50)
    from pyspark.sql import Window

    position = F.row_number().over(Window.orderBy(maps.severity_ordinal(F.col("severity")).desc(), "confidence", *b.ORDER))
    return top.select(position.cast("long").alias("position"), "file_path", "start_line", "severity", "confidence")


@query(f"""WITH {SYN} SELECT * FROM (SELECT row_number() OVER (ORDER BY CASE severity WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END DESC, confidence DESC, CASE WHEN vulnerability_type IN ('command_injection','sql_injection','unsafe_deserialization') THEN 1 ELSE 0 END DESC, {ORDER}) AS rank, file_path, start_line, severity, confidence FROM syn)
 WHERE rank <= (SELECT least(8, count(*)) FROM syn WHERE confidence >= 0.6)""")
def enrichment_candidates(spark, d):
    return fd.enrichment_candidates(_syn(spark, d), b.ORDER).select(F.col("rank").cast("long").alias("rank"), "file_path", "start_line", "severity", "confidence")


@query(f"""WITH {DOCS}, v AS (SELECT concat('doc_', doc_id) AS file_path, bool_or(quality = 1) AS valid FROM labels GROUP BY 1)
 SELECT file_path, start_line, rule_id, coalesce(valid, false) AS validated, round(CASE WHEN valid THEN least(1.0::DOUBLE, confidence + 0.1::DOUBLE) ELSE confidence END, 6) AS confidence FROM docs LEFT JOIN v USING (file_path)""")
def enrichment_merge(spark, d):
    v = b.table(spark, d, "labels").select(F.concat(F.lit("doc_"), "doc_id").alias("file_path"), (F.col("quality") == 1).alias("valid"))
    return fd.enriched(b.findings_docs(spark, d), v, "file_path").select("file_path", "start_line", "rule_id", "validated", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {SYN}, a AS (SELECT DISTINCT {_SIG} AS s FROM syn WHERE l_shipdate < TIMESTAMP '1997-01-01'), z AS (SELECT DISTINCT {_SIG} AS s FROM syn WHERE l_shipdate >= TIMESTAMP '1996-01-01')
 SELECT CASE WHEN a.s IS NULL THEN 'new' WHEN z.s IS NULL THEN 'resolved' ELSE 'persisting' END AS status, count(*) AS n FROM a FULL JOIN z ON a.s = z.s GROUP BY 1""")
def scan_trend(spark, d):
    f = _syn(spark, d)
    return fd.trend(f.where("l_shipdate < timestamp_ntz'1997-01-01'"), f.where("l_shipdate >= timestamp_ntz'1996-01-01'"))


_PREFIXED = ["BANDIT:  Use of   exec ", "[semgrep]\tWeak hash", "safety: [safety] old", "plain Text  here", "semgrep:bandit: x"]


@query(f"SELECT description, regexp_replace(trim(CASE l_partkey WHEN -1 THEN '' ELSE norm END), ' +', ' ', 'g') AS normalized, count(*) AS n FROM (SELECT l_partkey, {_case('l_partkey % 5', _PREFIXED)} AS description, CASE l_partkey % 5 WHEN 0 THEN 'use of exec' WHEN 1 THEN 'weak hash' WHEN 2 THEN 'old' WHEN 3 THEN 'plain text here' WHEN 4 THEN 'bandit: x' END AS norm FROM lineitem) GROUP BY 1, 2")
def description_signature(spark, d):
    t = b.table(spark, d, "lineitem").select(b._pick(_PREFIXED, F.col("l_partkey") % 5).alias("description"))
    return t.groupBy("description", fd.normalized_description(F.col("description")).alias("normalized")).agg(F.count("*").alias("n"))


# lines and tokens


@query(f"WITH {LINES} SELECT file_path, count(*) AS n_lines, sum(CASE WHEN regexp_matches(line, '^\\s*$') THEN 1 ELSE 0 END)::BIGINT AS blank, max(length(line))::BIGINT AS longest FROM doc_lines GROUP BY 1")
def file_line_stats(spark, d):
    return b.source_lines(spark, d).groupBy("file_path").agg(F.count("*").alias("n_lines"), F.count_if(F.col("line").rlike(r"^\s*$")).alias("blank"), F.max(F.length("line")).cast("long").alias("longest"))


@query("""SELECT lang AS language, CASE WHEN strlen(text)/1000.0 < 0.1 THEN 'tiny' WHEN strlen(text)/1000.0 < 1 THEN 'small' WHEN strlen(text)/1000.0 < 10 THEN 'medium' WHEN strlen(text)/1000.0 < 50 THEN 'large' ELSE 'huge' END AS size_class, count(*) AS n, sum(length(text) // 4)::BIGINT AS tokens FROM documents GROUP BY 1, 2""")
def language_mix(spark, d):
    f = b.source_files(spark, d)
    return f.groupBy("language", tx.size_class(F.octet_length("content") / 1000).alias("size_class")).agg(F.count("*").alias("n"), F.sum(tx.tokens(F.col("content"))).alias("tokens"))


@query("SELECT concat('doc_', doc_id) AS file_path, length(text) // 4 AS tokens, length(text) AS chars, strlen(text) AS bytes FROM documents")
def token_counts(spark, d):
    return b.source_files(spark, d).select("file_path", tx.tokens(F.col("content")).alias("tokens"), F.length("content").cast("long").alias("chars"), F.octet_length("content").cast("long").alias("bytes"))


@query("SELECT conv_id, count(*) AS messages, (sum(length(role)//4 + length(text)//4 + 4) + 2)::BIGINT AS tokens, sum(length(role)//4 + length(text)//4 + 4) + 2 <= 8192 AS fits FROM conversations GROUP BY 1")
def message_tokens(spark, d):
    c = b.table(spark, d, "conversations")
    total = F.sum(budget.message_tokens(F.col("role"), F.col("text"))) + budget.PER_CONVERSATION
    return c.groupBy("conv_id").agg(F.count("*").alias("messages"), total.alias("tokens"), (total <= budget.REQUEST_LIMIT).alias("fits"))


@query("SELECT concat('doc_', doc_id) AS file_path, greatest(0, 8192 - (length(text)//4 + 700)) AS available, round((length(text)//4 + 700) / 8192.0::DOUBLE, 6) AS used_share FROM documents")
def token_budget(spark, d):
    a = budget.allocation(8192, F.lit(200), tx.tokens(F.col("content")), 500)
    return b.source_files(spark, d).select("file_path", a["available"].alias("available"), F.round(a["used_share"], 6).alias("used_share"))


@query(f"SELECT file_path, CASE WHEN t <= 500 THEN t WHEN len(g) > 0 THEN t // g[1] ELSE 500 END AS size, CASE WHEN t <= 500 THEN 1 WHEN len(g) > 0 THEN g[1] ELSE 10 END AS count FROM (SELECT concat('doc_', doc_id) AS file_path, length(text)//4 AS t, list_filter(range(1, 10), lambda k: (length(text)//4) // k <= 500) AS g FROM documents)")
def optimal_chunk_size(spark, d):
    return b.source_files(spark, d).select("file_path", budget.chunk_plan(tx.tokens(F.col("content")), 500).alias("p")).select("file_path", "p.*")


@query("SELECT concat('doc_', doc_id) AS file_path, md5(substring(text, 1, 403)) AS digest, length(substring(text, 1, 403)) AS chars FROM documents")
def truncate_chars(spark, d):
    t = budget.truncated(F.col("content"), 100)
    return b.source_files(spark, d).select("file_path", F.md5(t).alias("digest"), F.length(t).cast("long").alias("chars"))


@query("""WITH s AS (SELECT doc_id, i, p[i] AS x FROM (SELECT doc_id, string_split(text, '. ') AS p FROM documents), unnest(range(1, len(p)+1)) AS t(i)),
 r AS (SELECT doc_id, i, x, sum(length(x) + 2) OVER (PARTITION BY doc_id ORDER BY i) // 4 <= 100 AS good FROM s)
 SELECT concat('doc_', d.doc_id) AS file_path, md5(rtrim(coalesce(t, ''))) AS digest FROM documents d LEFT JOIN (SELECT doc_id, string_agg(x || '. ', '' ORDER BY i) AS t FROM r WHERE good GROUP BY 1) USING (doc_id)""")
def truncate_sentences(spark, d):
    return b.source_files(spark, d).select("file_path", F.md5(budget.truncated_sentences(F.col("content"), 100)).alias("digest"))


@query("""SELECT file_path, k + 1 AS part, k * 400 AS start_char, least(n, k * 400 + 480) AS end_char FROM (SELECT concat('doc_', doc_id) AS file_path, length(text) AS n FROM documents), unnest(range(0, CASE WHEN n = 0 THEN 0 WHEN n <= 480 THEN 1 ELSE CAST(ceil((n - 480) / 400.0) AS BIGINT) + 1 END)) AS t(k)""")
def token_windows(spark, d):
    return budget.windows(b.source_files(spark, d), 120, 20)


# focus pipeline


@query(f"WITH {DOCS} SELECT * FROM docs")
def docs_findings(spark, d):
    return b.findings_docs(spark, d)


_ISL = f"""{DOCS}, marked AS (SELECT *, CASE WHEN start_line - lag(end_line) OVER w > 20 THEN 1 ELSE 0 END AS apart FROM docs WINDOW w AS (PARTITION BY file_path ORDER BY start_line, rule_id)),
 isl AS (SELECT *, sum(apart) OVER (PARTITION BY file_path ORDER BY start_line, rule_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM marked)"""
_ZONES = f"""{_ISL}, {COUNTS}, zones AS (SELECT file_path, island, greatest(1, min(start_line) - 10)::INTEGER AS start_line, least(max(end_line) + 10, any_value(n_lines))::INTEGER AS end_line, count(*) AS n_findings, least(avg({WEIGHT} * confidence), 1.0::DOUBLE) AS priority FROM isl JOIN counts USING (file_path) GROUP BY 1, 2)"""


def _islands(spark, d):
    return fo.islands(b.findings_docs(spark, d), 20, ["rule_id"])


def _zones(spark, d):
    return fo.zones(_islands(spark, d), fo.line_counts(b.source_files(spark, d)))


@query(f"WITH {_ISL} SELECT file_path, start_line, rule_id, island FROM isl")
def finding_islands(spark, d):
    return _islands(spark, d).select("file_path", "start_line", "rule_id", "island")


@query(f"WITH {_ZONES} SELECT file_path, island, start_line, end_line, n_findings, round(priority, 6) AS priority FROM zones")
def focus_zones(spark, d):
    return _zones(spark, d).withColumn("priority", F.round("priority", 6))


@query(f"""WITH {_ZONES}, g AS (SELECT file_path, coalesce(max(end_line) OVER (PARTITION BY file_path ORDER BY start_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS a, start_line - 1 AS b FROM zones
 UNION ALL SELECT file_path, max(end_line) + 1, any_value(n_lines) FROM zones JOIN counts USING (file_path) GROUP BY 1) SELECT file_path, a::INTEGER AS start_line, b::INTEGER AS end_line FROM g WHERE b - a + 1 >= 2""")
def context_gaps(spark, d):
    return fo.gaps(_zones(spark, d), fo.line_counts(b.source_files(spark, d)))


_PAIRS = f"""{_ZONES}, pairs AS (SELECT z.file_path, z.start_line AS c_start, z.end_line AS c_end, f.start_line, f.rule_id, f.severity, f.confidence FROM zones z JOIN docs f ON z.file_path = f.file_path AND f.start_line BETWEEN z.start_line AND z.end_line)"""


@query(f"WITH {_PAIRS} SELECT file_path, c_start, c_end, start_line, rule_id FROM pairs")
def chunk_finding_join(spark, d):
    z = _zones(spark, d).withColumn("chunk_id", fo.chunk_id("file_path", "start_line", "end_line"))
    return fo.associated(z, b.findings_docs(spark, d)).select("file_path", "c_start", "c_end", "start_line", "rule_id")


@query(f"""WITH {_PAIRS}, scores AS (SELECT file_path, c_start, c_end, count(*) AS finding_count, max({WEIGHT})::DOUBLE AS severity_score, least(sum({WEIGHT} * confidence), 1.0::DOUBLE) AS focus_score, bool_or(severity = 'critical') AS has_critical FROM pairs GROUP BY 1, 2, 3),
 content AS (SELECT z.file_path, z.start_line, z.end_line, array_to_string(list_slice(string_split(text, chr(10)), z.start_line, z.end_line), chr(10)) AS c FROM zones z JOIN documents ON z.file_path = concat('doc_', doc_id))
 SELECT file_path, start_line, end_line, md5(c) AS digest, length(c) // 4 AS token_count, finding_count, severity_score, round(focus_score, 6) AS focus_score, has_critical FROM content JOIN scores USING (file_path) WHERE c_start = start_line AND c_end = end_line""")
def focus_chunks(spark, d):
    c = fo.focus_chunks(b.source_files(spark, d), b.findings_docs(spark, d), order=["rule_id"])
    return c.select("file_path", "start_line", "end_line", F.md5("content").alias("digest"), "token_count", "finding_count", "severity_score", F.round("focus_score", 6).alias("focus_score"), "has_critical")


# folds


@query(f"""WITH RECURSIVE {LINES}, f AS (SELECT file_path, line_no, 1 AS part, length(line)//4 AS t FROM doc_lines WHERE line_no = 1
 UNION ALL SELECT l.file_path, l.line_no, CASE WHEN f.t + length(l.line)//4 <= 50 THEN part ELSE part + 1 END, CASE WHEN f.t + length(l.line)//4 <= 50 THEN f.t + length(l.line)//4 ELSE length(l.line)//4 END FROM f JOIN doc_lines l ON l.file_path = f.file_path AND l.line_no = f.line_no + 1)
 SELECT file_path, part, min(line_no)::INTEGER AS start_line, max(line_no)::INTEGER AS end_line, max(t) AS tokens FROM f GROUP BY 1, 2""")
def pack_lines(spark, d):
    return folds.packed_lines(b.source_files(spark, d), 50)


# usage


@query("""SELECT event_id, key, count(*) OVER w AS requests, (sum(tokens) OVER w)::BIGINT AS used_tokens FROM (SELECT event_id, user_id AS key, ts, floor(value)::BIGINT AS tokens FROM events) WINDOW w AS (PARTITION BY key ORDER BY ts RANGE BETWEEN INTERVAL 86399999999 MICROSECONDS PRECEDING AND CURRENT ROW)""")
def usage_rate_window(spark, d):
    return usage.trailing_rate(b.usage_events(spark, d), 86400).select("event_id", "key", "requests", "used_tokens")


@query("SELECT event_type AS kind, count(*) FILTER (event_type <> 'error') AS hits, count(*) FILTER (event_type = 'error') AS misses, round(count(*) FILTER (event_type <> 'error') / count(*)::DOUBLE, 6) AS hit_rate FROM events GROUP BY 1")
def cache_hit_rate(spark, d):
    return usage.hit_rate(b.usage_events(spark, d)).withColumn("hit_rate", F.round("hit_rate", 6))


_BOUNDS = [5.0, 10.0, 25.0, 50.0, 100.0, 250.0]


@query(" UNION ALL ".join(f"SELECT event_type AS kind, '{x}' AS le, count(*) FILTER (value <= {x}) AS n FROM events GROUP BY 1" for x in _BOUNDS) + " UNION ALL SELECT event_type, '+Inf', count(value) FROM events GROUP BY 1")
def latency_histogram(spark, d):
    return usage.histogram(b.usage_events(spark, d), "value", "kind", _BOUNDS)


@query("SELECT user_id AS key, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY 1")
def gauge_last(spark, d):
    return usage.last_value(b.usage_events(spark, d), "key")


@query("SELECT event_type AS kind, count(*) AS runs, round(avg(value), 6) AS avg_value, min(value) AS min_value, max(value) AS max_value, sum(floor(value)::BIGINT)::BIGINT AS total_tokens FROM events GROUP BY 1")
def operation_profile(spark, d):
    return usage.profile(b.usage_events(spark, d), "kind").withColumn("avg_value", F.round("avg_value", 6))


@query("""SELECT user_id AS key, count(*) FILTER (newest - ts < INTERVAL 3600 SECONDS) AS recent_requests, coalesce(sum(floor(value)::BIGINT) FILTER (newest - ts < INTERVAL 3600 SECONDS), 0)::BIGINT AS recent_tokens, count(*) AS requests, sum(floor(value)::BIGINT)::BIGINT AS total_tokens FROM events JOIN (SELECT user_id, max(ts) AS newest FROM events GROUP BY 1) USING (user_id) GROUP BY 1""")
def usage_stats(spark, d):
    return usage.usage_stats(b.usage_events(spark, d), 3600)


# graph


_EDGES = "edges AS (SELECT concat('o', o_orderkey) AS from_id, concat('c', o_custkey) AS to_id FROM orders UNION SELECT concat('c', c_custkey), concat('n', c_nationkey) FROM customer UNION SELECT concat('n', n_nationkey), concat('r', n_regionkey) FROM nation)"


def _edges(spark, d):
    pair = lambda t, a, x, c, y: b.table(spark, d, t).select(F.concat(F.lit(a), x).alias("from_id"), F.concat(F.lit(c), y).alias("to_id"))
    return pair("orders", "o", "o_orderkey", "c", "o_custkey").union(pair("customer", "c", "c_custkey", "n", "c_nationkey")).union(pair("nation", "n", "n_nationkey", "r", "n_regionkey"))


@query(f"WITH RECURSIVE {_EDGES}, r AS (SELECT from_id AS node_id, 0 AS depth FROM edges WHERE from_id LIKE 'o%7' UNION SELECT to_id, depth + 1 FROM r JOIN edges ON from_id = node_id WHERE depth < 3) SELECT node_id, min(depth)::INTEGER AS depth FROM r GROUP BY 1 HAVING min(depth) > 0")
def graph_dependencies(spark, d):
    e = _edges(spark, d)
    return graph.dependencies(e, e.where("from_id like 'o%7'").select(F.col("from_id").alias("node_id")), 3)


@query(f"WITH RECURSIVE {_EDGES}, r AS (SELECT 'r1' AS node_id, 0 AS depth UNION SELECT from_id, depth + 1 FROM r JOIN edges ON to_id = node_id WHERE depth < 2) SELECT node_id, min(depth)::INTEGER AS depth FROM r GROUP BY 1 HAVING min(depth) > 0")
def graph_dependents(spark, d):
    return graph.dependencies(_edges(spark, d), spark.sql("SELECT 'r1' AS node_id"), 2, reverse=True)


@query("""SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, lower(regexp_extract(url, '[^/](\\.[^./]+)$', 1)) AS suffix, count(*) AS n FROM pages GROUP BY 1, 2""")
def url_suffixes(spark, d):
    p = b.table(spark, d, "pages")
    return p.groupBy(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), tx.suffix(F.col("url")).alias("suffix")).agg(F.count("*").alias("n"))
