"""Folds, bounds of units, mentions, merged metadata and line ends against plain Python."""

import base64
import json
import random

from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import chunks, correlate, focus, folds, structure, usage, workflow
from quarry.operators import findings as fd

SOFT = ["@d", "  # c", '"""doc', "", "x = 1", "def f():"]
FINDING = "file_path string, start_line int, end_line int, source_tool string, severity string, vulnerability_type string, confidence double, description string, metadata map<string,string>, seq int"


def _files(seed, n=30, longest=14):
    pick = random.Random(seed)
    return {f"f{k}": [pick.choice(SOFT) for _ in range(pick.randrange(1, longest))] for k in range(n)}


def _frames(spark, files):
    rows = [(f, i + 1, x) for f, lines in files.items() for i, x in enumerate(lines)]
    return spark.createDataFrame(rows, "file_path string, line_no int, line string")


def test_packed_lines_in_many_runs(spark, monkeypatch):
    monkeypatch.setattr(folds, "RUN", 3)
    pick = random.Random(5)
    files = {f"f{k}": [pick.randrange(0, 9) for _ in range(pick.randrange(0, 40))] for k in range(12)}
    df = spark.createDataFrame([(f, "\n".join("x" * 4 * n for n in lines) + "\n" if lines else "") for f, lines in files.items()] + [("null", None)], "file_path string, content string")
    want = set()
    for f, sizes in files.items():
        part = []
        for i, n in enumerate(sizes):
            if part and part[-1][2] + n <= 10:
                part[-1] = (part[-1][0], i + 1, part[-1][2] + n)
            else:
                part.append((i + 1, i + 1, n))
        want |= {(f, k + 1, *p) for k, p in enumerate(part)}
    assert {tuple(r) for r in folds.packed_lines(df, 10).collect()} == want


def test_logical_blocks_end_at_soft_lines(spark):
    lines = ["x"] * 5 + [""] + ["x"] * 30
    df = spark.createDataFrame([("a", "\n".join(lines)), ("b", ""), ("c", None), ("d", "x")], "file_path string, content string")
    out = sorted(tuple(r) for r in folds.logical_blocks(df, most=5, reach=3).collect())
    assert [x for x in out if x[0] == "d"] == [("d", 1, 1)]
    spans = [x[1:] for x in out if x[0] == "a"]
    assert spans[0] == (1, 6) and spans[1] == (7, 14) and spans[-1][1] == 36
    assert all(b[0] == a[1] + 1 for a, b in zip(spans, spans[1:], strict=False))


def test_decorator_start_by_brute_force(spark):
    files = _files(1)
    units = [(f, s, len(lines)) for f, lines in files.items() for s in range(1, len(lines) + 2)] + [("none", 4, 5)]
    want = set()
    for f, s, e in units:
        best = s
        for i in range(s - 1, 0, -1):
            line = files.get(f, [])[i - 1].strip() if f in files else "x"
            if line.startswith("@"):
                best = i
            elif line and not line.startswith("#"):
                break
        want.add((f, best, e, s))
    df = spark.createDataFrame([(*u, u[1]) for u in units], "file_path string, start_line int, end_line int, was int")
    out = chunks.decorator_start(df, _frames(spark, files)).select("file_path", "start_line", "end_line", "was")
    assert {tuple(r) for r in out.collect()} == want


def test_logical_bounds_by_brute_force(spark):
    files = _files(2)
    units = [(f, s, e) for f, lines in files.items() for s in range(1, len(lines) + 1) for e in range(s, len(lines) + 1)]
    want = set()
    for f, s, e in units:
        lines, start, end = files[f], s, e
        i = s - 2
        while i >= 1 and (not lines[i - 1].strip() or lines[i - 1].strip()[:1] in "@#" or lines[i - 1].strip().startswith('"""')):
            start, i = i, i - 1
        i = e
        while i < min(len(lines), e + 3) and (not lines[i - 1].strip() or lines[i - 1].strip().startswith("#")):
            end, i = i, i + 1
        want.add((f, s, e, start, end))
    out = chunks.logical_bounds(spark.createDataFrame(units, "file_path string, start_line int, end_line int"), _frames(spark, files))
    assert {tuple(r) for r in out.select("file_path", "start_line", "end_line", "logical_start", "logical_end").collect()} == want


def test_names_are_found_within_words(spark):
    names = spark.createDataFrame([("load",), ("get",), ("zz",), ("",), (None,), ("naïve",)], "name string")
    texts = spark.createDataFrame([("see reload_all()",), (None,), ("",), ("x.get; naïvely",)], "description string")
    assert {r[0] for r in structure.mentioned(names, texts).collect()} == {"load", "get", "naïve"}
    assert structure.mentioned(names, texts.limit(0)).count() == 0 and structure.mentioned(names.limit(0), texts).count() == 0


def test_metadata_of_merged_findings(spark):
    one = lambda tool, sure, data, seq: ("a.py", 3, 3, tool, "high", "xss", sure, "found it", data, seq)
    df = spark.createDataFrame([one("bandit", 0.9, {"id": "B"}, 0), one("semgrep", 0.8, {"id": "S1"}, 1), one("semgrep", 0.7, None, 2), one("bandit", 0.4, {"id": "B2", "n": None}, 3), ("b.py", 1, 1, "safety", "low", "xss", 0.5, "alone", None, 4)], FINDING)
    out = {r["file_path"]: r["metadata"] for r in fd.deduplicated(df, ["seq"]).collect()}
    assert out["b.py"] == {}
    assert out["a.py"].pop("id") == "S1"
    assert {k: json.loads(v) for k, v in out["a.py"].items()} == {"bandit_metadata": {"id": "B2", "n": None}, "semgrep_metadata": {}}


def test_line_ends(spark):
    text = "a\r\nb\rc\x0bd\x0ce\x1cf\x85g h\n"
    df = spark.createDataFrame([("a", text), ("b", ""), ("c", None)], "file_path string, content string")
    every = [r["line"] for r in tx.lines(df, every_end=True).orderBy("file_path", "line_no").collect()]
    assert every == text.splitlines()
    plain = [(r["file_path"], r["line"]) for r in tx.lines(df, last=True).orderBy("file_path", "line_no").collect()]
    assert plain == [("a", x) for x in text.split("\n")] + [("b", ""), ("c", "")]


def test_cache_state_and_recent_errors(spark):
    rows = [("a", 100, True), ("a", 900, False), ("b", 950, True), ("c", 990, False), ("d", 1000, True), ("e", 1000, True), ("f", 940, True)]
    df = spark.createDataFrame(rows, "key string, s long, stored boolean").select("key", F.timestamp_seconds("s").alias("ts"), "stored")
    assert [tuple(r) for r in usage.cache_state(df, 3, 500).orderBy("rank").collect()] == [("d", 1, "second"), ("e", 2, "second"), ("b", 3, "second")]
    assert [tuple(r) for r in usage.cache_state(df, 4, 500).orderBy("rank").collect()][0] == ("d", 1, "first")
    assert usage.cache_state(df.limit(0), 4, 500).count() == 0
    errors = spark.createDataFrame([("k", i) for i in range(30)], "key string, seq int")
    out = usage.recent_errors(errors, "key", ["seq"], 20, 2).collect()
    assert {r["seq"] for r in out} == set(range(10, 30)) and {r["seq"] for r in out if r["shown"]} == {28, 29}


def test_encoded_diff_and_file_count(spark):
    assert spark.range(1).select(workflow.encoded(F.lit("ä" * 100)).alias("x")).first()["x"] == base64.b64encode(("ä" * 100).encode()).decode()
    df = spark.createDataFrame([("a", "x", 1, "low", 0.5), ("b", "x", 2, "high", 0.5), ("b", "x", 3, "low", 0.5)], "file_path string, vulnerability_type string, start_line int, severity string, confidence double")
    row = correlate.clusters(df, ["vulnerability_type"], ["file_path"]).first()
    assert (row["n"], row["n_files"], row["severity"]) == (3, 2, "high")


def test_focus_chunks_agree_with_their_parts(spark):
    pick = random.Random(9)
    files = spark.createDataFrame([(f"f{k}", "\n".join(f"line {i}" for i in range(pick.randrange(1, 200)))) for k in range(6)] + [("none", None)], "file_path string, content string")
    found = [(f"f{pick.randrange(7)}", a := pick.randrange(1, 200), pick.choice([None, a, a + pick.randrange(60)]), pick.choice(["low", "high", "critical"]), pick.choice([0.2, 0.5, 0.9]), i) for i in range(60)] + [("none", 1, 1, "low", 0.5, 99)]
    findings = spark.createDataFrame(found, "file_path string, start_line int, end_line int, severity string, confidence double, seq int")
    out = focus.focus_chunks(files, findings, 5, ["seq"])
    counts = focus.line_counts(files)
    zone = focus.zones(focus.islands(findings, 10, ["seq"]), counts, 5).withColumn("chunk_id", focus.chunk_id("file_path", "start_line", "end_line"))
    want = focus.sliced(zone, files).join(focus.chunk_scores(focus.associated(zone.dropDuplicates(["chunk_id"]), findings)), "chunk_id", "left")
    columns = ["file_path", "island", "start_line", "end_line", "n_findings", "content", "token_count", "character_count", "line_count", "finding_count", "severity_score", "has_critical"]
    key = lambda df: sorted((repr(tuple(r[c] for c in columns)), round(r["priority"], 6), r["focus_score"] is None or round(r["focus_score"], 6)) for r in df.collect())
    assert key(out) == key(want)
    assert focus.focus_chunks(files, findings.limit(0)).count() == 0 and focus.focus_chunks(files.limit(0), findings).count() == 0
