"""The state of changed files is called by buckets of paths."""

from quarry.streaming import state, usage


def test_changed_files_over_runs(spark, tmp_path):
    n = 5000
    rounds = [
        [(f"f{k}", f"t{k}", 1) for k in range(n)] + [("nil", None, 1), (None, "x", 1), ("two", "b", 2), ("two", "a", 1), ("two", "b", 3)],
        [(f"f{k}", f"t{k}" if k % 3 else "new", 4) for k in range(n)] + [("nil", None, 4), ("late", "z", 4), ("two", "a", 5), ("two", "a", 4)],
    ]
    last, want = {}, []
    for rows in rounds:
        for path, text, order in sorted((r for r in rows if r[0]), key=lambda r: r[2]):
            if path not in last or last[path][0] != text:
                last[path] = (text, last.get(path, (None, 0))[1] + 1)
                want.append((path, order, last[path][1]))
        spark.createDataFrame(rows, "file_path string, content string, order int").write.mode("append").parquet(f"{tmp_path}/in")
        with state.stateful(spark):
            stream = state.changed_files(spark.readStream.schema("file_path string, content string, order int").parquet(f"{tmp_path}/in"))
            out = usage.drained(stream, f"{tmp_path}/run")
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert state.BUCKETS < n and len(last) > n  # fewer calls than paths
