"""Reports that begin like JSON."""

from quarry.operators import workflow


def test_only_whole_values_are_read(spark):
    cases = {
        '{"results": [1, 2]}': (2, "read"), ' {"vulnerabilities": [1]}\n': (1, "read"), "42": (0, "read"), "[]": (0, "read"), '"text"': (0, "read"), "null": (0, "read"), "": (0, "empty"), " \n": (0, "empty"),
        "4501042323994846 Anth heoron": (0, "error"), "42 43": (0, "error"), "1, 2": (0, "error"), '1, "b": 2': (0, "error"), "1] more": (0, "error"), "1} more": (0, "error"), '{"results": [1]} more': (0, "error"),
        '{"results": [1]} {"results": [2]}': (0, "error"), '"text" more': (0, "error"), "true story": (0, "error"), '{"results": [1]': (0, "error"), "words": (0, "error"),
    }
    told = workflow.report_counts(spark.createDataFrame([(x, x) for x in cases], "tool string, json string"))
    assert {r["tool"]: (r["n"], r["status"]) for r in told.collect()} == cases
