"""Stateful streams over several batches, with restarts, rows out of order, late rows and nulls."""

import random
from datetime import datetime, timedelta

import pytest

from quarry.streaming import state, usage

START = datetime(2024, 1, 1)
EVENTS = "key long, event_id long, ts timestamp, tokens long"


def put(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def run(spark, folder, schema, how):
    stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
    with state.stateful(spark):
        return usage.drained(how(stream), f"{folder}/run").collect()


def test_changed_files(spark, tmp_path):
    schema = "file_path string, content string, order long, version string"  # a clashing name
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    put(spark, [("a", "1", 1, "x"), ("b", "1", 1, "x"), ("c", None, 1, "x"), (None, "1", 1, "x"), ("a", "1", 1, "x")], schema, tmp_path)
    first = [("a", 1, 1), ("b", 1, 1), ("c", 1, 1)]
    assert sorted(map(tuple, run(spark, tmp_path, schema, state.changed_files))) == first
    put(spark, [("a", "1", 2, "x"), ("b", "1", 3, "x"), ("b", "2", 2, "x"), ("c", "", 2, "x"), ("d", "y" * 500_000, 2, "x")], schema, tmp_path)
    told = sorted(map(tuple, run(spark, tmp_path, schema, state.changed_files)))
    assert told == sorted([*first, ("b", 2, 2), ("b", 3, 3), ("c", 2, 2), ("d", 2, 1)])
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def plain(rows, seconds, most, tokens):
    out = []
    for key, event_id, ts, _ in rows:
        near = [r[3] or 0 for r in rows if r[0] == key and ts - timedelta(seconds=seconds) < r[2] <= ts]
        out.append((key, event_id, ts, len(near), sum(near), len(near) > most or sum(near) > tokens))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_limiter_out_of_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 1, 2, 3]), k, START + timedelta(seconds=rng.choice([k, k, k // 2 * 2]), milliseconds=rng.choice([0, 0, 500])), rng.choice([None, 5, 100])) for k in range(150)]
    rows.append((2, None, rows[10][2], 7))  # a null id, at the time of another row
    shuffled = sorted(rows, key=lambda r: r[2].timestamp() + rng.uniform(0, 25))
    parts = [shuffled[:60], shuffled[60:110], shuffled[110:]]
    how = lambda s: state.limited(s, 20, 6, 300, "30 seconds")
    for k, part in enumerate(parts):
        put(spark, part + [(None, 900 + k, START, 1), (5, 950 + k, None, 1)], EVENTS, tmp_path)
        told = run(spark, tmp_path, EVENTS, how)
    assert 0 < len(told) < len(rows)
    put(spark, [(9, 999, START + timedelta(days=1), 0)], EVENTS, tmp_path)  # the watermark moves on
    told = [tuple(r) for r in run(spark, tmp_path, EVENTS, how) if r.key != 9]
    assert sorted(told, key=repr) == plain(rows, 20, 6, 300)


def test_limiter_late_rows_count_nowhere(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    how = lambda s: state.limited(s, 60, 6, 300, "10 seconds")
    put(spark, [(1, 1, at(100), 5), (1, 2, at(130), 5)], EVENTS, tmp_path)
    run(spark, tmp_path, EVENTS, how)
    put(spark, [(1, 3, at(110), 5), (1, 4, at(125), 5), (9, 9, at(9999), 0)], EVENTS, tmp_path)  # the watermark is 120
    told = sorted(tuple(r)[1:5] for r in run(spark, tmp_path, EVENTS, how) if r.key == 1)
    assert told == [(1, at(100), 1, 5), (2, at(130), 3, 15), (4, at(125), 2, 10)]


def test_verdicts_over_batches(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    f_schema, v_schema = "key long, finding_id long, found_at timestamp", "key long, verdict string, judged_at timestamp"

    def go():
        f = spark.readStream.schema(f_schema).parquet(f"{tmp_path}/f/in")
        v = spark.readStream.schema(v_schema).parquet(f"{tmp_path}/v/in")
        return usage.drained(state.judged(f, v, "1 MINUTES", "10 seconds"), f"{tmp_path}/run").collect()

    put(spark, [(1, 1, at(0)), (2, 2, at(0)), (None, 3, at(0)), (1, 4, at(50))], f_schema, f"{tmp_path}/f")
    put(spark, [(1, "no", at(61)), (7, "no", at(1))], v_schema, f"{tmp_path}/v")
    assert sorted(tuple(r)[1:4] for r in go()) == [(4, at(50), "no")]
    put(spark, [(1, "yes", at(60)), (1, "ok", at(110)), (8, "end", at(9999))], v_schema, f"{tmp_path}/v")
    put(spark, [(9, 9, at(9999))], f_schema, f"{tmp_path}/f")
    told = sorted(((r.finding_id, r.verdict) for r in go() if r.finding_id != 9), key=repr)
    assert told == sorted([(1, "yes"), (2, None), (3, None), (4, "no"), (4, "yes"), (4, "ok")], key=repr)
