"""strategy_select against its SQL where the last bit of a sum, a line's ends or a letter decide."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quarry.operators import strategies
from quarry.plans import more  # noqa: F401
from quarry.plans import queries as q

FOUND = {"l": "under licence x", "e": "mail a.b@cd.org", "i": "host 10.0.0.1", "p": "call +1 (555) 123-4567", "s": 'token = "abc"'}


def both(spark, folder, docs):
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
    path = f"{folder}/documents.parquet"
    pq.write_table(pa.Table.from_pylist([{"doc_id": k, "text": x, "lang": "en", "source": "web", "n_chars": 0} for k, x in docs], schema), path)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{path}')")
    ours = sorted(map(tuple, q.QUERIES["strategy_select"](spark, str(folder)).select("file_path", "strategy", "priority").collect()), key=repr)
    theirs = sorted(con.sql(f"select file_path, strategy, priority from ({q.ORACLES['strategy_select']})").fetchall(), key=repr)
    return ours, theirs


def test_findings_are_summed_as_in_sql(spark, tmp_path):
    r = random.Random(3)
    docs = []
    for k in range(1500):
        found = ["eeeeeeeeeppp", "ssppppiiii", "sssliiiiieep"][k % 3]  # their means lie at a threshold
        lines = [FOUND[x] for x in found] + ["plain"] * r.choice([0, 60, 250])
        docs.append((k, "\n".join(r.sample(lines, len(lines)))))
    ours, theirs = both(spark, tmp_path, docs)
    assert len(ours) == 3006 and ours == theirs


ODD = [
    "class \nclass \nclass \nclass \nclass a\n  def \n  if \nimport x\n",
    "\tclass a\n\tdef b\n\tif c\n\tfor d\n",
    " class a\n　def b\n if c\n​for d\n\rwhile e\n\x0btry:\n",
    "İf a\nİmport b\nfunctİon c\n" * 3,
    "x. \ny. \nz. \nw. ",
    "a, \nb, \nc, ",
    "def a. def b\r\nfunction \n  func ",
    "\n" * 60,
    "",
    None,
]


@pytest.mark.parametrize("found", [True, False])
def test_odd_texts_are_told_as_in_sql(spark, tmp_path, found):
    docs = list(enumerate(ODD)) + [(None, "def a\nif b\nfor c\n"), (1, "class a\nclass b\nclass c\ndef d\nif e\nfor f\n")]
    docs += [(7, "\n".join(FOUND[k] for k in "peee")), (7, FOUND["i"]), (None, FOUND["s"])] if found else []
    ours, theirs = both(spark, tmp_path, docs)
    assert len(ours) == len(theirs) > 20 and ours == theirs


def test_priority_of_findings_does_not_depend_on_their_order(spark):
    rows = [("a", s, c) for s, c in [("medium", 0.8)] * 3 + [("high", 0.7)] * 5 + [("low", 0.6)] * 7 + [("info", None)]]
    files = spark.createDataFrame([("a", "x"), ("b", None), ("c", "x")], "file_path string, content string")
    told = set()
    for k in range(4):
        few = spark.createDataFrame(random.Random(k).sample(rows, len(rows)) + [("c", "high", None)], "file_path string, severity string, confidence double")
        told.add(tuple(sorted((r["file_path"], r["priority"]) for r in strategies.priorities(files, few.repartition(3)).where("strategy = 'focus'").collect())))
    assert len(told) == 1 and [(k, round(p, 9)) for k, p in told.pop()] == [("a", round((3 * 0.48 + 5 * 0.56 + 7 * 0.24) / 15, 9)), ("b", 0.1), ("c", 1.0)]
