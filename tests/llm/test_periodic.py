"""Periodic runs against a plain search of every start and period."""

import hashlib
import random
import re
from fractions import Fraction

import numpy as np
import pytest

from quarry.llm import periodic, queries


def plain_runs(words):
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(6, 4 * q):
                out.setdefault((s, i + q - s), q)  # the smallest period of a stretch comes first
    return sorted((s, n, q) for (s, n), q in out.items())


def plain_row(doc_id, text, rewrite=None):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    taken = rewrite(doc_id, len(words)) if rewrite else None
    if taken is not None:
        words = [words[k] for k in taken]
    found = plain_runs(words)
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    kept = " ".join(w for k, w in enumerate(words) if k not in gone)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(kept))


def told(words):
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    return [tuple(r[1:]) for r in periodic.runs(np.array([number[w] for w in words], dtype=np.int64), np.array([0, len(words)])).tolist()]


@pytest.mark.parametrize("seed", range(60))
def test_random_words(seed):
    rng = random.Random(seed)
    words = []
    while len(words) < rng.randint(1, 150):
        part = [rng.choice("ab" if rng.random() < 0.5 else "abcdefgh") for _ in range(rng.randint(1, 9))]
        words += part * rng.choice([1, 1, 2, 4, 5, 9]) + part[: rng.randint(0, len(part))]
    assert told(words) == plain_runs(words)


def test_edges():
    assert told([]) == told(["a"]) == told(["a"] * 5) == told(list("abcabcabc")) == []
    assert told(["a"] * 6) == [(0, 6, 1)]
    assert told(list("ababababab")) == [(0, 10, 2)]
    assert told(list("xababababx")) == [(1, 8, 2)]
    many = list("abc" * 5000)
    assert told(many) == [(0, 15000, 3)]
    nested = (list("aaaaaa") + ["b"]) * 5
    assert told(nested) == plain_runs(nested)


def test_documents_stay_apart():
    ids = np.array([1] * 5 + [1] * 6 + [2, 1], dtype=np.int64)
    assert periodic.runs(ids, np.array([0, 5, 5, 11, 13])).tolist() == [[2, 0, 6, 1]]


def odd_rows():
    rng = random.Random(5)
    rows = [(None, "x " * 9), (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "a b " * 7), (5, "one"), (5, "one"), (6, "A a " * 6)]
    rows += [(7, " ".join(rng.choice("abcd") * rng.randint(1, 3) for _ in range(30000)) + " stop it now" * 40)]  # very long
    rows += [(k, " ".join(rng.choice(["so", "it", "goes"]) for _ in range(rng.randint(0, 120)))) for k in range(10, 90)]
    return rows


def test_rows_on_spark(spark):
    rows = odd_rows()
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, n_runs int, start string")  # clashing names
    ours = sorted(map(tuple, periodic.digests(docs, queries._stuttered).collect()), key=repr)
    short = [r for r in rows if r[0] != 7]
    assert [r for r in ours if r[0] != 7] == sorted((plain_row(*r, queries._stuttered) for r in short), key=repr)
    long = [r for r in ours if r[0] == 7]
    assert len(long) == 1 and long[0][4] is not None
    spans = periodic.listed(docs).where("doc_id = 7 and period = 3").collect()
    assert any(r["length"] == 120 for r in spans)


def test_collapsed_and_empty(spark):
    docs = spark.createDataFrame([(1, "go " + "on and on and on and on and stop"), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, periodic.collapsed(docs).collect())) == [(1, "go on and stop"), (2, "")]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.digests(none).count() == periodic.listed(none).count() == 0


def test_query_on_small_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    small = [r for r in rows if len(r[1]) < 6000]
    ours = {r[0]: tuple(r) for r in queries.op13_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    assert len(ours) == len(rows)
    for r in small:
        assert ours[r[0]] == plain_row(*r, queries._stuttered)
