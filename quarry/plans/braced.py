"""Units of brace languages: every document written as JavaScript by rule, with the braces in strings and comments that a
count of characters would fall for."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import braces
from quarry.plans.queries import query
from quarry.sources import bindings as b

_HEAD = "import io from 'io';\n\nclass Main extends Base {\n  run(a, b) {\n    const s = '"
_STEPS = [
    ("\\", "/"), ("'", "\\'"), ("\n", "';\n    s = '"),
    (". ", "';\n  }\n  // no } here, it's text {\n\n  async part(x) {\n    return '"),
    (", ", "';\n    if (x) { /* } */ log(\"} {\"); } else {\n      t = `{\n`;\n    }\n    s = '"),
    (" and ", "';\n    for (let i = 0; i < 3; i++) {\n      each(s, (k) => { k(); });\n    }\n    s = '"),
]
_TAIL = "';\n  }\n}\n"


def _lit(text: str) -> str:
    return "concat(" + ", chr(10), ".join("'" + x.replace("'", "''") + "'" for x in text.split("\n")) + ", '')"


def _code_sql() -> str:
    out = "text"
    for old, new in _STEPS:
        out = f"replace({out}, {_lit(old)}, {_lit(new)})"
    return f"js AS (SELECT concat('src/doc_', doc_id, '.js') AS file_path, concat({_lit(_HEAD)}, {out}, {_lit(_TAIL)}) AS content FROM documents WHERE text IS NOT NULL)"


def javascript(spark, d):
    text = F.col("text")
    for old, new in _STEPS:
        text = F.replace(text, F.lit(old), F.lit(new))
    docs = b.table(spark, d, "documents").where("text is not null")
    return docs.select(F.concat(F.lit("src/doc_"), "doc_id", F.lit(".js")).alias("file_path"), F.concat(F.lit(_HEAD), text, F.lit(_TAIL)).alias("content"))


_RE2 = braces.TOKEN.replace("*+", "*").replace("]++", "]+").replace("'", "''")
_CASES = " ".join(f"WHEN regexp_matches(h, '{p}') THEN '{k}'" for k, p in braces.HEADS)
_NAMES = " ".join(f"WHEN regexp_matches(h, '{p}') THEN regexp_extract(h, '{p}', 1)" for _, p in braces.HEADS)

#: A block ends at the first later brace behind which the depth is what it was before the block.
UNITS = rf"""{_code_sql()}, tok AS (SELECT file_path, i, t[i] AS t FROM (SELECT file_path, regexp_extract_all(content, '{_RE2}') AS t FROM js), unnest(range(1, len(t) + 1)) AS u(i)),
 bare AS (SELECT file_path, string_agg(CASE WHEN t[1] = '/' AND length(t) > 1 THEN regexp_replace(t, '[^\n]+', '', 'g') WHEN t[1] IN ('"', '''', '`') THEN '""' || regexp_replace(t, '[^\n]+', '', 'g') ELSE t END, '' ORDER BY i) AS t FROM tok GROUP BY 1),
 c AS (SELECT file_path, i, regexp_extract(p[i], '[{{}};\n]$') AS sep, p[i] AS raw, regexp_replace(p[i], '^\s+|\s*[{{}};]?\s*$', '', 'g') AS x FROM (SELECT file_path, regexp_extract_all(t, '[^{{}};\n]*[{{}};\n]|[^{{}};\n]+') AS p FROM bare), unnest(range(1, len(p) + 1)) AS u(i)),
 n AS (SELECT *, len(string_split(raw, '(')) - len(string_split(raw, ')')) AS o, 1 + sum((sep = chr(10))::INTEGER) OVER w - (sep = chr(10))::INTEGER AS line, sum(CASE sep WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER w AS depth, sum((sep IN ('{{', '}}'))::INTEGER) OVER w - (sep IN ('{{', '}}'))::INTEGER AS stretch,
  lead(CASE WHEN x <> '' OR sep <> chr(10) THEN {{'x': x, 'sep': sep}} END IGNORE NULLS) OVER w AS nx FROM c WINDOW w AS (PARTITION BY file_path ORDER BY i)),
 par AS (SELECT *, sum(o) OVER (PARTITION BY file_path, stretch ORDER BY i) AS open FROM n),
 low AS (SELECT *, open <= least(0, min(open) OVER (PARTITION BY file_path, stretch ORDER BY i)) AS closed, bool_or(regexp_matches(x, '{braces.OPEN_HEAD}')) OVER (PARTITION BY file_path, stretch, line ORDER BY i) AS headed FROM par),
 sta AS (SELECT *, coalesce(sum((closed AND (sep = ';' AND NOT headed OR sep = chr(10) AND x <> '' AND NOT regexp_matches(x, '{braces.MORE}') AND NOT coalesce(regexp_matches(nx.x, '{braces.GOES_ON}') AND nx.sep IN ('{{', chr(10)) OR nx.x = '' AND nx.sep = '{{', false)))::INTEGER) OVER (PARTITION BY file_path, stretch ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS statement FROM low),
 head AS (SELECT file_path, stretch, statement, max(i) AS i, arg_max(sep, i) AS last, arg_max(depth, i) - 1 AS depth, coalesce(min(line) FILTER (x <> ''), max(line)) AS start_line, coalesce(string_agg(x, ' ' ORDER BY i) FILTER (x <> ''), '') AS h FROM sta GROUP BY 1, 2, 3),
 fin AS (SELECT file_path, len(string_split(content, chr(10))) - ends_with(content, chr(10))::INTEGER AS tail FROM js),
 kin AS (SELECT h, CASE {_CASES} ELSE 'block' END AS kind, nullif(CASE {_NAMES} END, '') AS name FROM (SELECT DISTINCT h FROM head WHERE last = '{{')),
 units AS (SELECT b.file_path, kind, name, start_line::INTEGER AS start_line, coalesce(z.line, tail)::INTEGER AS end_line, b.depth::INTEGER AS depth FROM head b JOIN fin USING (file_path) JOIN kin USING (h) ASOF LEFT JOIN (SELECT file_path, depth, i, line FROM n WHERE sep = '}}') z ON z.file_path = b.file_path AND z.depth = b.depth AND z.i > b.i WHERE last = '{{')"""


@query(f"WITH {UNITS} SELECT * FROM units")
def brace_units(spark, d):
    """Blocks of all documents written as JavaScript, by bracket depth."""
    return braces.units(javascript(spark, d))


@query(f"""WITH {UNITS}, k AS (SELECT u.*, array_to_string(list_slice(string_split(content, chr(10)), start_line, end_line), chr(10)) AS t FROM units u JOIN js USING (file_path) WHERE kind = 'function'),
 o AS (SELECT *, max(end_line) OVER (PARTITION BY file_path ORDER BY start_line, end_line DESC, depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k)
 SELECT file_path, kind, name, start_line, end_line, length(t) // 4 AS token_count, CASE WHEN regexp_matches(lower(t), '{"|".join(x.replace(".", chr(92) + ".") for x in braces.SECURITY_WORDS)}') THEN 0.95::DOUBLE ELSE 0.9::DOUBLE END AS weight FROM o WHERE before IS NULL OR start_line > before""")
def brace_unit_chunks(spark, d):
    """Functions that lie in no other as chunks with their weight."""
    from quarry.operators import focus

    files = javascript(spark, d)
    top = braces.outermost(braces.units(files), ["function"])
    told = focus.sliced(top, files)
    return told.select("file_path", "kind", "name", "start_line", "end_line", "token_count", braces.weight(F.col("kind"), F.col("content")).alias("weight"))
