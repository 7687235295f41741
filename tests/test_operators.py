"""Small cases: quirks kept or mended, nulls, empty tables, invariants."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import budget, maps
from quarry.functions import text as tx
from quarry.operators import findings as fd
from quarry.operators import focus, folds, graph, render, strategies, units, usage, workflow
from quarry.sources import code, files, tools

SCHEMA = "file_path string, start_line int, end_line int, source_tool string, severity string, vulnerability_type string, confidence double, description string, seq int"


def rows(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("value, level", [(1.0, "very_high"), (0.9, "very_high"), (0.7, "high"), (0.5, "medium"), (0.3, "low"), (0.29, "very_low"), (None, None)])
def test_confidence_levels(spark, value, level):
    assert one(spark, maps.confidence_level(F.lit(value).cast("double"))) == level


def test_dedup_keeps_the_trusted_tool_and_boosts(spark):
    data = rows(
        spark, ("a.py", 3, 3, "bandit", "high", "xss", 0.9, "Bandit: found  it", 0), ("a.py", 3, 3, "semgrep", "low", "xss", 0.5, "found it", 1),
        ("a.py", 3, 3, "bandit", "high", "xss", 0.9, "FOUND it", 2), ("a.py", 4, 4, "bandit", "high", "xss", 0.9, "found it", 3))
    out = {r["start_line"]: r for r in fd.deduplicated(data, ["seq"]).collect()}
    assert len(out) == 2 and out[3]["n"] == 3
    assert out[3]["source_tool"] == "semgrep" and out[3]["also_detected_by"] == "bandit, bandit"
    assert out[3]["confidence"] == pytest.approx(0.7) and out[3]["confidence_level"] == "medium"  # the level isn't raised
    again = fd.deduplicated(fd.deduplicated(data, ["seq"]).select(*[c for c in data.columns if c != "seq"]).withColumn("seq", F.lit(0)), ["seq"])
    assert again.count() == 2


def test_dedup_severity_as_word_or_by_weight(spark):
    data = rows(spark, ("a", 1, 1, "bandit", "critical", "xss", 0.5, "d", 0), ("a", 1, 1, "bandit", "medium", "xss", 0.5, "d", 1))
    assert fd.deduplicated(data, ["seq"]).first()["severity"] == "medium"
    assert fd.deduplicated(data, ["seq"], "ordinal").first()["severity"] == "critical"


def test_empty_tables(spark):
    none = rows(spark).limit(0)
    assert fd.deduplicated(none, ["seq"]).count() == 0 and fd.top_types(none).count() == 0
    assert fd.severity_dashboard(none).first()["total"] == 0
    assert fd.enrichment_candidates(none, ["seq"]).count() == 0


def test_report_order_lists_lower_confidence_first(spark):
    data = rows(spark, ("a", 1, 1, "bandit", "high", "xss", 0.9, "d", 0), ("a", 2, 2, "bandit", "high", "xss", 0.4, "d", 1), ("a", 3, 3, "bandit", "critical", "xss", 0.5, "d", 2))
    assert [r["start_line"] for r in fd.report_order(data, ["seq"]).collect()] == [3, 2, 1]


def test_enriched_modes(spark):
    data = rows(spark, ("a", 1, 1, "bandit", "high", "xss", 0.95, "d", 0), ("b", 1, 1, "bandit", "high", "xss", 0.5, "d", 1))
    verdicts = spark.createDataFrame([("a", True)], "file_path string, valid boolean")
    assert sorted(r["confidence"] for r in fd.enriched(data, verdicts, "file_path").collect()) == [0.5, 1.0]
    assert fd.enriched(data, verdicts, "file_path", "append").count() == 3


def test_spans_and_nulls(spark):
    data = rows(spark, ("a", 5, 3, "bandit", "high", "xss", 0.9, "d", 0), ("a", 5, None, "bandit", None, "xss", None, None, 1))
    assert fd.valid_spans(data).count() == 1
    assert fd.included(data, 0.0, "info").count() == 1


@pytest.mark.parametrize("text, n", [("", 0), (None, 0), ("a", 1), ("a\n", 1), ("a\n\nb", 3), ("\n", 1)])
def test_lines(spark, text, n):
    df = spark.createDataFrame([("f", text)], "file_path string, content string")
    assert tx.lines(df).count() == n


def test_packed_lines_cover_every_line_once(spark):
    text = "\n".join("x" * (k % 37) for k in range(200))
    df = spark.createDataFrame([("f", text)], "file_path string, content string")
    parts = folds.packed_lines(df, 20).orderBy("part").collect()
    assert [n for p in parts for n in range(p["start_line"], p["end_line"] + 1)] == list(range(1, 201))
    assert all(p["tokens"] <= 20 or p["start_line"] == p["end_line"] for p in parts)


def test_zones_cover_findings_and_chunks_hold_them(spark):
    df = spark.createDataFrame([("f", "\n".join(map(str, range(100))))], "file_path string, content string")
    found = rows(spark, ("f", 5, 5, "bandit", "high", "xss", 0.9, "d", 0), ("f", 25, 25, "bandit", "critical", "xss", 1.0, "d", 1), ("f", 90, 90, "bandit", "low", "xss", 0.5, "d", 2))
    chunks = focus.focus_chunks(df, found).orderBy("start_line").collect()
    assert [(c["start_line"], c["end_line"], c["finding_count"]) for c in chunks] == [(1, 35, 2), (80, 100, 1)]
    assert chunks[0]["focus_score"] == 1.0 and chunks[0]["has_critical"]
    spans = spark.createDataFrame([("f", 1, 35), ("f", 80, 100)], "file_path string, start_line int, end_line int")
    assert [(r[1], r[2]) for r in focus.gaps(spans, focus.line_counts(df)).collect()] == [(36, 79)]


def test_windows_end_and_overlap(spark):
    df = spark.createDataFrame([("f", "x" * 1000), ("g", ""), ("h", None)], "file_path string, content string")
    out = budget.windows(df, 100, 25).orderBy("part").collect()
    assert [(r["start_char"], r["end_char"]) for r in out] == [(0, 400), (300, 700), (600, 1000)]
    with pytest.raises(ValueError):
        budget.windows(df, 10, 10)


def test_graph_stops_at_its_depth_and_on_rings(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "from_id string, to_id string")
    start = spark.createDataFrame([("a",)], "node_id string")
    assert {(r[0], r[1]) for r in graph.dependencies(edges, start, 2).collect()} == {("b", 1), ("c", 2)}
    assert {r[0] for r in graph.dependencies(edges, start, 9).collect()} == {"b", "c", "d"}
    assert {r[0] for r in graph.dependencies(edges, start, 1, reverse=True).collect()} == {"c"}


def test_python_units_by_parsing_and_by_indentation_agree(spark):
    c = code.corpus(spark).where("file_path like 'app/%'")
    parsed = {(r["file_path"], r["name"], r["end_line"]) for r in units.python_units(c).where("kind <> 'import'").collect()}
    guessed = {(r["file_path"], r["name"]) for r in units.heuristic_units(tx.lines(c)).collect()}
    assert {x[:2] for x in parsed} == guessed
    assert units.python_units(code.corpus(spark).where("file_path = 'broken.py'")).count() == 0


def test_valid_python(spark):
    assert one(spark, units.valid_python(F.lit("    def f():\n        pass")))
    assert not one(spark, units.valid_python(F.lit("def f(:")))


def test_languages(spark):
    got = {r[0]: (r[1], r[2]) for r in code.corpus(spark).select("file_path", files.language_by_suffix(F.col("file_path")), files.language_by_content(F.col("content"))).collect()}
    assert got["app/store.py"] == ("python", "python") and got["srv/main.go"][0] == "go" and got["notes.txt"] == (None, None)
    assert one(spark, files.is_requirements(F.lit("a/b.txt"), F.lit("x==1\n"))) and not one(spark, files.is_requirements(F.lit("a/b.txt"), F.lit("words")))


def test_reads_files(spark, tmp_path):
    (tmp_path / "a.py").write_bytes(b"x = 1\xff\n")
    (tmp_path / "__pycache__").mkdir()
    (tmp_path / "__pycache__" / "b.py").write_text("y")
    (tmp_path / "c.txt").write_text("z")
    got = files.read(spark, str(tmp_path), [".py"], ["__pycache__"]).collect()
    assert [r["content"] for r in got] == ["x = 1\n"]


def test_reads_reports(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"results": [\n {"test_id": "B105", "issue_severity": "odd"}]}')
    row = tools.read_reports(spark, "bandit", str(tmp_path)).first()
    assert (row["vulnerability_type"], row["severity"], row["start_line"]) == ("hardcoded_secrets", "medium", 1)
    wrapped = spark.createDataFrame([('{"vulnerabilities": [{"package": "p", "vulnerability_id": "9"}]}',)], "json string")
    assert tools.safety(wrapped).count() == 1 and tools.safety(wrapped, ignored=["9"]).count() == 0


@pytest.mark.parametrize("form", ["table", "json", "sarif", "html", "markdown", "csv"])
def test_documents(spark, form):
    data = rows(spark, ("a<b>.py", 1, None, "bandit", "high", "xss", 0.9, "d<script>", 0))
    text = render.document(data, form, ["seq"])
    assert "xss" in text or "script" in text
    assert form != "html" or "<script>" not in text


def test_strategies(spark):
    none = rows(spark).limit(0)
    picked = {r["file_path"]: r["strategy"] for r in strategies.selected(strategies.priorities(code.corpus(spark), none)).collect()}
    assert picked["app/store.py"] in ("function", "semantic") and "notes.txt" not in picked


def test_usage_window_leaves_the_minute_before_out(spark):
    data = spark.sql("SELECT * FROM VALUES (1, timestamp_ntz'2024-01-01 00:00:00', 'k', 5L), (2, timestamp_ntz'2024-01-01 00:00:59', 'k', 6L), (3, timestamp_ntz'2024-01-01 00:01:00', 'k', 7L) AS t(event_id, ts, key, tokens)")
    got = {r["event_id"]: (r["requests"], r["used_tokens"]) for r in usage.trailing_rate(data).collect()}
    assert got == {1: (1, 5), 2: (2, 11), 3: (2, 13)}
    assert usage.limited(data, most_requests=1).where("over").count() == 2


def test_model_reply(spark):
    reply = F.lit('```json\n{"valid": true}\n```')
    assert one(spark, workflow.model_reply(reply, "valid boolean"))["valid"] is True


def test_settings(tmp_path):
    from quarry.config import Settings, TokenSettings

    assert Settings.production().tokens.max_tokens == 6000 and Settings.development().tokens.overlap_tokens == 150
    with pytest.raises(ValueError):
        TokenSettings(max_tokens=1000, overlap_tokens=500)
    with pytest.raises(ValueError):
        Settings.from_dict({"scan": {"severity_threshold": "awful"}})
    own = Settings().merged(confidence_threshold=0.6, severity_threshold=None)
    own.save(tmp_path / "quarry.json")
    (tmp_path / "a").mkdir()
    assert Settings.find(tmp_path / "a") == own and own.scan.severity_threshold == "low"
    (tmp_path / "a" / "pyproject.toml").write_text("[tool.quarry.scan]\nconfidence_threshold = 0.5\n")
    assert Settings.find(tmp_path / "a").scan.confidence_threshold == 0.5


def test_semantic_chunks_take_each_line_once(spark):
    from quarry.operators import chunks

    got = [(r["chunk_type"], r["start_line"], r["end_line"]) for r in chunks.semantic_chunks(code.corpus(spark).where("file_path = 'app/store.py'")).collect()]
    covered = [n for _, a, b in got for n in range(a, b + 1)]
    assert len(covered) == len(set(covered)) and {"import", "class", "function", "global"} <= {x[0] for x in got}


def test_shortening_keeps_the_first_line(spark):
    from quarry.operators import chunks

    text = "\n".join(["def f():" + "x" * 80] + ["    y = 1"] * 50)
    out = one(spark, chunks.shortened_function(F.lit(text), 20))
    assert out.split("\n")[0] == text.split("\n")[0] and out.endswith(chunks.CUT_FUNCTION)
    assert one(spark, chunks.shortened_unit(F.lit("a\nb\nc\nd\ne\nf"))) == "a\nb\nc\n    # ... content truncated ...\ne\nf"


def test_reports_hold_every_finding(spark, tmp_path):
    from quarry.operators import render

    n = 1300
    rows = [(k, f"f{k % 7}.py", k, k, "bandit", ["low", "critical", "high"][k % 3], "xss", 0.5, "d") for k in range(n)]
    data = spark.createDataFrame(rows, "seq int, file_path string, start_line int, end_line int, source_tool string, severity string, vulnerability_type string, confidence double, description string")
    assert render.document(data, "markdown", ["seq"]).count("**") == 2 * n
    assert render.document(data, "markdown", ["seq"], most=10).count("**") == 20
    for form in ("json", "sarif", "csv", "table"):
        render.files(data, form, ["seq"], str(tmp_path / form))
        got = spark.read.option("header", form == "csv").format("csv" if form == "csv" else "text").load(str(tmp_path / form))
        assert got.count() == n
    assert "critical" in spark.read.text(str(tmp_path / "table")).first()[0]


def test_chunk_pairs_against_all_pairs(spark):
    import random

    from quarry.operators import focus

    r = random.Random(5)
    rows = [(f"f{k % 3}", 3 * k, 3 * k + r.randint(0, 6), r.choices("abcdef", k=r.randint(0, 3)), r.choices("xy", k=r.randint(0, 2))) for k in range(40)] + [("g", 1, 2, None, None)]
    want = set()
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] < b[1]:
                f, i, seq = len(set(a[3] or []) & set(b[3] or [])), len(set(a[4] or []) & set(b[4] or [])), abs(a[2] - b[1]) <= 5
                strength = min(1.0, 0.5 * f + 0.3 * i + 0.4 * seq)
                if strength >= 0.1:
                    want.add((a[0], a[1], b[1], round(strength, 6), "sequential" if seq else "functional" if f else "related"))
    data = spark.createDataFrame(rows, "file_path string, start_line int, end_line int, functions array<string>, imports array<string>")
    got = focus.relationships(data).collect()
    assert {(*x[:3], round(x[3], 6), x[4]) for x in got} == want and len(got) == len(want)
