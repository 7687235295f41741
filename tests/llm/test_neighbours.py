"""Graphs against brute force on vectors without clusters, the exact way, and shards from the row count."""

import numpy as np
import pytest

from quarry.llm import ann


@pytest.mark.parametrize("n, size", [(2000, 48), (6000, 32)])
def test_recall_on_even_vectors(n, size):
    v = np.random.default_rng(n).normal(size=(n, size))
    graph = ann.Graph(np.arange(n), v)
    q = np.arange(0, n, n // 200)
    r, found, score = graph.search(v[q], q, 20)
    exact = v[q] @ v.T
    exact[np.arange(len(q)), q] = -np.inf
    least = np.sort(exact, axis=1)[:, -20]
    assert (score >= least[r] - 1e-9).sum() / (20 * len(q)) > 0.95 and not graph.scans


def test_walks_join_past_the_scanned(monkeypatch):
    monkeypatch.setattr(ann, "SCANNED", 500)
    r = np.random.default_rng(3)
    v = r.normal(size=(60, 16))[r.integers(0, 60, 4000)] + 0.4 * r.normal(size=(4000, 16))
    graph = ann.Graph(np.arange(4000), v)
    q = np.arange(0, 4000, 20)
    row, found, score = graph.search(v[q], q, 20)
    exact = v[q] @ v.T
    exact[np.arange(len(q)), q] = -np.inf
    assert (score >= np.sort(exact, axis=1)[:, -20][row] - 1e-9).mean() > 0.95


@pytest.mark.parametrize("rows", [400, 100])
def test_exact_way_and_shards(spark, monkeypatch, rows):
    monkeypatch.setattr(ann, "SHARD_ROWS", rows)
    v = np.random.default_rng(4).normal(size=(900, 8))
    v[30:60] = 10 * v[30]
    df = spark.createDataFrame([(k, x.tolist(), "clash", 1.0) for k, x in enumerate(v)], "vec_id bigint, embedding array<double>, rank string, score double")
    out = ann.neighbours(df, exact=True).collect()
    got = {(x["query_id"], x["rank"]): (x["vec_id"], x["score"]) for x in out}
    for q in range(0, 900, 20):
        exact = v @ v[q]
        want = sorted((k for k in range(900) if k != q), key=lambda k: (-exact[k], k))[:20]
        assert np.allclose([got[q, k + 1][1] for k in range(20)], exact[want])
    assert [got[40, k + 1][0] for k in range(20)] == [x for x in range(30, 60) if x != 40][:20] and len(got) == 900


@pytest.mark.parametrize("n", [1, 2, 3, 19, 47, 90, 383, 500])
def test_small_shards_are_walked_too(n, monkeypatch):
    v = np.random.default_rng(n).normal(size=(n, 12))
    graph = ann.Graph(np.arange(n), v)
    graph._scan = None  # a search that scans would fail
    row, found, score = graph.search(v, np.arange(n), 20)
    exact = v @ v.T
    np.fill_diagonal(exact, -np.inf)
    want = np.sort(exact, axis=1)[:, ::-1][:, : min(20, n - 1)]
    assert len(row) == want.size
    assert (score >= want[row, np.arange(len(row)) - np.searchsorted(row, row)] - 1e-9).mean() > 0.97 if n > 1 else not len(row)
