"""Invariants on generated findings and texts."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import budget
from quarry.functions import text as tx
from quarry.operators import findings as fd
from quarry.operators import focus

FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
FINDINGS = st.lists(st.tuples(st.sampled_from("ab"), st.integers(1, 60), st.sampled_from(["bandit", "semgrep", "safety", "x"]), st.sampled_from(["low", "high", "critical"]), st.integers(0, 10)), min_size=1, max_size=25)


def table(spark, data):
    rows = [(f, s, s + n % 3, t, v, "xss", n / 10, "d", k) for k, (f, s, t, v, n) in enumerate(data)]
    return spark.createDataFrame(rows, "file_path string, start_line int, end_line int, source_tool string, severity string, vulnerability_type string, confidence double, description string, seq int")


@FEW
@given(FINDINGS)
def test_dedup_keeps_one_of_each_signature(spark, data):
    df = table(spark, data)
    out = fd.deduplicated(df, ["seq"]).collect()
    assert len(out) == len({(x[0], x[1]) for x in data}) and sum(r["n"] for r in out) == len(data)
    assert all(0 <= r["confidence"] <= 1 and len([x for x in r["also_detected_by"].split(", ") if x]) <= r["n"] - 1 for r in out)


@FEW
@given(FINDINGS)
def test_zones_cover_every_finding(spark, data):
    df = table(spark, data)
    files = spark.createDataFrame([(f, "\n".join("x" * 70)) for f in "ab"], "file_path string, content string")
    zones = focus.zones(focus.islands(df, order=["seq"]), focus.line_counts(files)).collect()
    assert sum(z["n_findings"] for z in zones) == len(data)
    assert all(any(z["file_path"] == f and z["start_line"] <= s <= z["end_line"] for z in zones) for f, s, *_ in data)


@FEW
@given(st.lists(st.text(alphabet="ab.\n é", max_size=60), min_size=1, max_size=8), st.integers(1, 6))
def test_truncation_and_windows(spark, texts, most):
    df = spark.createDataFrame(list(enumerate(texts)), "file_path string, content string")
    for r in df.select("content", budget.truncated(F.col("content"), most).alias("t"), budget.truncated_sentences(F.col("content"), most).alias("s"), tx.line_array(F.col("content")).alias("l")).collect():
        assert r["content"].startswith(r["t"]) and len(r["t"]) // 4 <= most and r["content"].startswith(r["s"].rstrip(". "))
        assert r["l"] == [x for x in (r["content"][:-1] if r["content"].endswith("\n") else r["content"]).split("\n")] or r["content"] == ""
    spans = budget.windows(df, most, 0).collect()
    assert sum(s["end_char"] - s["start_char"] for s in spans) == sum(map(len, texts))
