"""What plans shuffle and sort, so that they grow no faster than their input, with results as before."""

import re

from pyspark.sql import functions as F

from quarry.operators import braces, chunks, correlate, findings, focus, strategies, units


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_brace_units_move_one_row_for_each_brace(spark):
    code = "function f(a) {\n  g(1); h(2);\n  for (let i = 0; i < 3; i++) {\n    x();\n  }\n}\n"
    files = spark.createDataFrame([("a.js", code)], "file_path string, content string")
    assert braces.stretches(files).count() == 4
    plan = planned(braces.units(files))
    assert len(re.findall(r"\bSort \[", plan)) <= 2 and len(re.findall(r"\bExchange ", plan)) == 1
    got = sorted((r["kind"], r["name"], r["start_line"], r["end_line"], r["depth"]) for r in braces.units(files).collect())
    assert got == [("control", None, 3, 5, 1), ("function", "f", 1, 6, 0)]


def test_plain_heads_are_as_folded_ones(spark):
    heads = ["a(); b(x) {", "a();\nfor (i; j;) {", "f(g(h(x)));\n if (x)\n{", "x = (1;\n y {", ");\n(; z() {", "for i := 0; i < n; {", "\n\n  run(a,\n b) {", "a;\n\n {", "{", "b;{", "foo\n.bar(); baz() {", "f((1)); \t g() {", "if x; y() {"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(heads)], "k int, content string").withColumn("file_path", F.col("k").cast("string"))
    folded = df.withColumn("p", braces._head(F.col("content"))).withColumn("l", braces._last(F.col("p")))
    head = F.array_join(F.transform(F.slice("p", F.col("l.begin") + 1, F.size("p")), lambda x: x["text"]), " ")
    slow = {r["file_path"]: (r["at"], r["r"]) for r in folded.select("file_path", "l.at", braces._rule(head).alias("r")).collect()}
    kinds = [k for k, _ in braces.HEADS] + ["block"]
    fast = {r["file_path"]: (r["at"], r["kind"]) for r in braces.stretches(df).collect()}
    assert {k: (a, kinds[r]) for k, (a, r) in slow.items()} == fast


def test_slices_split_a_file_once(spark):
    files = spark.createDataFrame([("a", "1\n2\n3\n4\n"), ("b", None), ("c", "x")], "file_path string, content string")
    spans = spark.createDataFrame([("a", 1, 2), ("a", 1, 2), ("a", 3, 9), ("a", 4, 3), ("b", 1, 1), ("d", 1, 1), ("c", 1, 1)], "file_path string, start_line int, end_line int")
    out = focus.sliced(spans, files)
    assert out.columns == ["file_path", "start_line", "end_line", "content", "token_count", "character_count", "line_count"]
    got = sorted((r["file_path"], r["start_line"], r["end_line"], r["content"]) for r in out.collect())
    assert got == [("a", 1, 2, "1\n2"), ("a", 1, 2, "1\n2"), ("a", 3, 9, "3\n4"), ("a", 4, 3, ""), ("b", 1, 1, ""), ("c", 1, 1, "x")]
    below = planned(out).split("Join", 1)
    assert "split(" not in below[0] and "split(" in below[1]  # lines are split before files meet their spans


def test_dedup_shuffles_what_is_asked_for(spark):
    rows = [("a", 1, 2, "bandit", "low", "xss", 0.5, "Text", 1), ("a", 1, 3, "semgrep", "high", "xss", 0.5, "text", 2), (None, 1, 3, "semgrep", "high", "xss", None, "text", 3)]
    df = spark.createDataFrame(rows, "file_path string, start_line int, end_line int, source_tool string, severity string, vulnerability_type string, confidence double, description string, k int")
    whole, few = findings.deduplicated(df, ["k"]), findings.deduplicated(df, ["k"], columns=["severity"])
    assert few.columns == ["signature", "source_tool", "severity", "confidence", "n", "also_detected_by", "confidence_level"]
    assert sorted(map(tuple, whole.select(*few.columns).collect())) == sorted(map(tuple, few.collect()))
    assert {r[0] for r in whole.select("signature").collect()} == {r[0] for r in df.select(findings.signature()).collect()}
    assert "md5(" not in planned(whole).split("Exchange", 1)[1] and "end_line" in planned(whole).split("Exchange", 1)[1]
    assert "end_line" not in planned(few).split("Exchange", 1)[1].split("LocalTableScan")[0].split("Scan ")[0]


def test_clusters_count_files_apart(spark):
    rows = [("a", 1, "low", "xss", 0.5), ("a", 2, "high", "xss", 0.25), ("b", 3, "high", "xss", 0.5), (None, 4, "low", None, 0.5), ("a", 5, "low", "sql", 1.0)]
    df = spark.createDataFrame(rows, "file_path string, start_line int, severity string, vulnerability_type string, confidence double")
    out = correlate.clusters(df, ["vulnerability_type"], ["start_line"])
    got = {r["vulnerability_type"]: (r["n"], r["n_types"], r["n_files"], r["severity"], r["primary_line"]) for r in out.collect()}
    assert got == {"xss": (3, 1, 2, "high", 1), "sql": (1, 1, 1, "low", 5), None: (1, 0, 0, "low", 4)}
    assert "SortAggregate" not in planned(out)


def test_indented_units_move_no_texts(spark):
    text = "def a():\n  x\n\n  def b():\n    y\n# c\nz\nclass C:\n  w\n\n"
    lines = spark.createDataFrame([("f", k + 1, x) for k, x in enumerate(text.split("\n")[:-1])] + [(None, 1, "def a():")], "file_path string, line_no int, line string")
    out = units.heuristic_units(lines)
    got = sorted((r["kind"], r["name"], r["start_line"], r["end_line"]) for r in out.collect())
    assert got == [("class", "C", 8, 10), ("function", "a", 1, 6), ("function", "b", 4, 6)]
    assert len(re.findall(r"\bExchange ", planned(out))) <= 2 and "Join" not in planned(out)


def test_structure_is_told_in_one_scan(spark):
    text = ["", "\n", "def f\n def \n\tDEF g", "class \nclass A\n  If x:\ntry:\nexcept: x\nxclass B\n for\n for ", "a function b function c\nfunction \nfunc  x\nfunc\t\n def  \r\n while  é", "if a\n" * 8, None]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(text)], "k int, t string")

    def plain(x):
        lines = x.split("\n")
        strip = lambda y: y.strip(" \t\n\x0b\f\r")
        total = 0.0
        for y in lines:
            total += sum(w for k, w in strategies.STRUCTURE.items() if strip(y).lower().startswith(k))
        return min(1.0, total / max(len(lines) / 50, 1.0)), sum(strip(y).startswith(("def ", "func ")) or "function " in y for y in lines)

    out = df.select("k", strategies.structure_score(F.col("t")).alias("s"), strategies.function_count(F.col("t")).alias("n"))
    got = {r["k"]: (r["s"], r["n"]) for r in out.collect()}
    assert {k: got[k] for k in range(6)} == {k: plain(x) for k, x in enumerate(text[:6])} and got[6] == (1.0, None)
    assert "filter(split" not in planned(out)


def test_semantic_chunks_cut_lines_once_for_all_steps(spark):
    text = "import a\nimport b\n\nclass C:\n  x = 1\n\ndef f():\n  return 1\n\nA = 1\nB = 2\n\nwith a:\n  b()\n  c()\n"
    out = chunks.semantic_chunks(spark.createDataFrame([("a.py", text)], "file_path string, content string"))
    assert planned(out).count("Generate posexplode") == 1
    got = sorted((r["start_line"], r["end_line"], r["chunk_type"]) for r in out.collect())
    assert got == [(1, 2, "import"), (4, 6, "class"), (7, 9, "function"), (10, 11, "global"), (13, 15, "block")]


def test_chunk_pairs_are_never_shuffled_or_sorted(spark):
    rows = [("a", 1, 2, ["f"], ["x"]), ("a", 9, 9, ["f"], ["x"]), ("a", 20, None, ["x"], None), ("a", 21, 21, ["x", None], ["f"]), ("b", 1, 1, ["f"], None), (None, 1, 1, ["f"], None), (None, 2, 2, ["f"], None), ("a", None, 1, ["f"], None)]
    long = "n" * 64  # told apart behind what a short name may have
    rows += [("c", 100 * k, 100 * k, [x], []) for k, x in enumerate([long, long + "1", long + "2", long + "1"])]
    df = spark.createDataFrame(rows, "file_path string, start_line int, end_line int, functions array<string>, imports array<string>")
    out = focus.relationships(df)
    plan = planned(out)
    assert sorted(map(tuple, out.collect())) == [("a", 1, 9, 0.8, "functional"), ("a", 20, 21, 0.5, "functional"), ("c", 100, 300, 0.5, "functional")]
    assert len(re.findall(r"\bExchange ", plan)) == 1 and len(re.findall(r"\bSort \[", plan)) == 1 and "Join" not in plan and "Aggregate" not in plan


def test_chunk_pairs_of_files_over_many_batches(monkeypatch):
    import random

    import pyarrow as pa

    from quarry.operators import pairs

    r = random.Random(7)
    monkeypatch.setattr(pairs, "SLAB", 16)
    # b has chunks of one start, c and d lie in one batch, e goes on to the end; a long common name meets all of it
    sizes = {"a": 1, "b": 9, "c": 1, "d": 1, "e": 30}
    rows = [(p, k // 2 * 2 if p == "b" else 2 * k - 5, r.choice([None, 2 * k + r.randint(-9, 9)]), r.choice([None, ["all", *r.sample("uvw", r.randint(0, 3))]]), r.choice([[], ["all"], [None, "u"]])) for p, n in sizes.items() for k in range(n)]
    schema = pa.schema([("file_path", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("functions", pa.list_(pa.string())), ("imports", pa.list_(pa.string()))])
    whole = pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in rows], schema)
    both = lambda x, y: len((set(x or []) & set(y or [])) - {None})
    met = [(a[0], a[1], b[1], both(a[3], b[3]), both(a[4], b[4]), a[2] is not None and abs(a[2] - b[1]) <= 5) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1]]
    want = sorted(x for x in met if any(x[3:]))
    for size in (1, 2, 5, 11, len(rows)):
        got = list(pairs.told(whole.slice(k, size) for k in range(0, len(rows), size)))
        assert sorted(tuple(x.values()) for batch in got for x in batch.to_pylist()) == want
        # pairs are put out as they are met: SLAB and one chunk's at most
        assert max(len(x) for x in got) <= 16 + 3 * 30 and len(got) > 10
