"""Band joins against all pairs, a file of a million lines, names against plain search, chunk calls, folds, SARIF logs."""

import json
import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from quarry.operators import bands, chunks, focus, folds, structure, units
from quarry.sources import sarif

SPAN = "file_path string, start_line int, end_line int"


def spans_of(rng, n, wide):
    out = [(rng.choice("ab"), s, s + rng.choice([0, 1, 5, wide])) for s in (rng.randint(1, 1000) for _ in range(n))]
    return [*out, ("a", 500, 499), ("c", 99, 100), ("c", 100, 199), ("a", None, 5), (None, 1, 2)]


@pytest.mark.parametrize("seed", [1, 2])
def test_joins_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    a, b = spans_of(rng, 60, 350), spans_of(rng, 60, 120)
    points = [(rng.choice("abc"), rng.randint(1, 1200)) for _ in range(200)] + [("c", 100), ("c", 199), ("a", None), (None, 1)]
    df = spark.createDataFrame(a, SPAN)
    ours = bands.lines_within(df, spark.createDataFrame(points, "file_path string, at int"), "at").select(*SPAN.replace(" string", "").replace(" int", "").split(", "), "at")
    plain = [(*s, p[1]) for s in a for p in points if None not in (*s, *p) and s[0] == p[0] and s[1] <= p[1] <= s[2]]
    assert sorted(map(tuple, ours.collect())) == sorted(plain)
    other = spark.createDataFrame(b, "file_path string, b_start int, b_end int")
    ours = bands.overlapping(df, other).select("file_path", "start_line", "end_line", "b_start", "b_end")
    plain = [(*s, t[1], t[2]) for s in a for t in b if None not in (*s, *t) and s[0] == t[0] and max(s[1], t[1]) <= min(s[2], t[2]) and s[1] <= s[2] and t[1] <= t[2]]
    assert sorted(map(tuple, ours.collect())) == sorted(plain)


def test_a_file_of_a_million_lines(spark):
    n = 1_000_000
    files = spark.range(1).select(F.lit("big").alias("file_path"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.concat(F.lit("line "), k.cast("string"))), "\n").alias("content"))
    at = [*range(1000, 400_000, 40), *range(500_000, 600_000, 7)]
    found = spark.createDataFrame([("big", k, k, "high", 0.5) for k in at], SPAN + ", severity string, confidence double")
    ours = bands.focus_chunks(files.unionByName(spark.createDataFrame([("none", None)], "file_path string, content string")), found).orderBy("start_line").collect()
    plain, group = [], [at[0]]
    for k in [*at[1:], 10**9]:
        if k - group[-1] > 20:
            plain.append((max(1, group[0] - 10), group[-1] + 10, len(group)))
            group = []
        group.append(k)
    assert [(r.start_line, r.end_line, r.finding_count) for r in ours] == plain
    assert all(r.content == "\n".join(f"line {k}" for k in range(r.start_line, r.end_line + 1)) for r in ours)


def test_both_ways_to_focus_chunks_agree(spark):
    rng = random.Random(4)
    files = [(f"f{k}", "\n".join(f"x{j}" for j in range(rng.randint(0, 400)))) for k in range(12)]
    found = [(f"f{rng.randint(0, 13)}", s, s + rng.randint(0, 3), rng.choice(["low", "critical"]), 0.25) for s in (rng.randint(1, 300) for _ in range(150))]
    f, g = spark.createDataFrame(files, "file_path string, content string"), spark.createDataFrame(found, SPAN + ", severity string, confidence double")
    pick = ["file_path", "start_line", "end_line", "content", "token_count", "line_count", "n_findings", "finding_count", "has_critical"]
    one, two = (sorted(map(tuple, x.select(*pick).collect()), key=repr) for x in (focus.focus_chunks(f, g), bands.focus_chunks(f, g)))
    assert one == two and one


def test_names(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcd_") for _ in range(n))
    names = [word(rng.randint(1, 7)) for _ in range(150)] + ["", None, "a b", "é", "%", "longer_than_any_run_of_the_texts"]
    texts = [" ".join(word(rng.randint(1, 9)) for _ in range(12)) for _ in range(15)] + [None, "", "café a%b", "a" * 30_000]
    ours = structure.mentioned(spark.createDataFrame([(x, 1) for x in names], "name string, n int"), spark.createDataFrame([(x,) for x in texts], "description string"))
    runs = {w for t in texts if t for w in t.split()}
    plain = [x for x in names if x and " " not in x and any(x in w for w in runs)]
    assert sorted(r.name for r in ours.collect()) == sorted(plain) and plain


def test_first_chunks_of_calls(spark):
    c = spark.createDataFrame([("f", "c2", 2, ["a", "b"]), ("f", "c1", 1, ["b", None]), ("f", "c3", 3, ["a", "d"]), ("g", "g1", 1, ["a"])], "file_path string, chunk_id string, place int, names array<string>")
    calls = spark.createDataFrame([("f", "a", "b"), ("f", "a", "b"), ("f", "d", "a"), ("f", "a", "z"), ("g", "a", "b"), (None, "a", "b")], "file_path string, caller string, callee string")
    assert sorted(map(tuple, units.chunk_calls(c, calls).collect())) == [("f", "c2", "c1", "b"), ("f", "c3", "c2", "a")]


def test_dropped_chunks_are_counted(spark):
    df = spark.createDataFrame([("x" * 400,), ("y" * 10,), (None,), ("z" * 100,)], "content string")
    seen = Observation()
    kept = chunks.fitted_counted(df, 25, 50, seen).collect()
    assert len(kept) == 2 and seen.get == {"chunks": 4, "dropped": 2, "tokens_dropped": 2}


def test_related_chunks(spark):
    rows = [("f", 1, 5, ["a", "b"]), ("f", 8, 9, ["c"]), ("f", 30, 31, ["x"]), ("f", 50, 60, ["b", "c", None]), ("f", 70, 71, None), ("f", 90, 91, ["x", "y"]), ("f", 99, 99, ["y", "x"])]
    ours = folds.merged_related(spark.createDataFrame(rows, SPAN + ", deps array<string>"))
    # the first group takes what shares two names with all it holds by then
    assert sorted(tuple(r)[1:4] for r in ours.collect()) == [(1, 60, 3), (30, 31, 1), (70, 71, 1), (90, 99, 2)]
    assert folds.merged_related(spark.createDataFrame([], SPAN + ", deps array<string>")).count() == 0


def test_sarif_log(spark, tmp_path):
    rows = [(f"f{k % 7}", k, None if k % 3 else k + 1, ["critical", "low", "info"][k % 3], f"t{k % 5}" if k else None, 'a "quoted"\nline, {[' if k % 2 else None) for k in range(300)]
    found = spark.createDataFrame(rows, "file_path string, start_line int, end_line int, severity string, vulnerability_type string, description string").repartition(5)
    sarif.write(found, f"{tmp_path}/log")
    root = json.loads((tmp_path / "log" / sarif.ROOT).read_text())
    parts = root["runs"][0]["externalPropertyFileReferences"]["results"]
    whole = []
    for p in parts:
        part = json.loads((tmp_path / "log" / p["location"]["uri"]).read_text())
        assert len(part["results"]) == p["itemCount"] and part["runGuid"] == root["runs"][0]["automationDetails"]["guid"]
        whole += part["results"]
    assert len(parts) > 1 and len(whole) == 300 and {r["id"] for r in root["runs"][0]["tool"]["driver"]["rules"]} == {f"t{k}" for k in range(5)}
    back = sarif.read(spark, f"{tmp_path}/log").collect()
    assert sorted((r.uri, r.start_line, r.end_line, r.rule_id or "", r.message or "") for r in back) == sorted((a, b, c or b, t or "", m or "") for a, b, c, _, t, m in rows)
    with open(tmp_path / "log" / parts[0]["location"]["uri"], "w") as f:
        f.write("{}")
    with pytest.raises(ValueError):
        sarif.read(spark, f"{tmp_path}/log")
    sarif.write(found.limit(0), f"{tmp_path}/none")
    assert sarif.read(spark, f"{tmp_path}/none").count() == 0
