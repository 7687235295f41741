"""The quality model comes from every labelled row: against brute force over all rows and all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import quality, ranking

LABELS = "doc_id bigint, quality int, toxic int"


def _learnable(n):
    """The first n doc_ids whose crc32 mod 4 isn't 2."""
    import zlib

    return [k for k in range(2 * n) if zlib.crc32(str(k).encode()) % 4 != 2][:n]


def _corpus(n):
    r = random.Random(7)
    texts, y = [], []
    for k in range(n):
        bad = k % 5 == 0
        words = ["".join(r.choices("abcdefgh", k=r.randint(1, 9))) for _ in range(r.randint(2, 14))]
        texts.append(" ".join(w + "!" * (bad and r.random() < 0.4) for w in words) + ("." if r.random() < 0.8 - 0.5 * bad else ""))
        y.append(int(not bad))
    return texts, y


def _middle(values, weights, goal):
    order = np.argsort(values, kind="stable")
    reach = np.cumsum(weights[order])
    value = values[order][np.flatnonzero(reach >= goal * (1 - 1e-9))[0]]
    more = values[values > value]
    return (value + more.min()) / 2 if len(more) else None


def test_cuts_threshold_and_share_are_those_of_all_rows(spark):
    texts, y = _corpus(9000)
    ids = _learnable(len(texts))
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id bigint, text string").repartition(5)
    marks = spark.createDataFrame([(i, k, 0) for i, k in zip(ids, y, strict=True)], LABELS)
    model = quality.learned(docs, marks)
    x, y = quality.measures(pa.array(texts)), np.array(y)
    alike = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    for k, cuts in enumerate(model.cuts):
        want = {m for q in range(1, 10) if (m := _middle(x[:, k], alike, q / 10)) is not None}
        np.testing.assert_array_equal(cuts, sorted(want))
    worth = model.worth(x)
    assert model.threshold == _middle(worth, np.ones(len(y)), (y == 0).sum())
    assert model.scale == pytest.approx(np.std(worth) / 3) and model.share == 0.8


def test_long_null_and_repeated_texts_teach(spark):
    ids = _learnable(60)
    long = "spam spam " * 3000
    texts = [long if k < 20 else None if k < 40 else f"A plain sentence, number {k}." for k in range(60)]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)) + [(ids[59], texts[59])] * 20, "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, int(k >= 40), 0) for k, i in enumerate(ids)], LABELS)
    out = quality.predicted(docs, marks).collect()
    assert len(out) == 80 and all(r["predicted"] == int(r["doc_id"] in ids[40:]) for r in out)
    only = marks.where("quality = 0").collect()
    assert {r["score"] for r in quality.predicted(docs, spark.createDataFrame(only[:20], LABELS)).collect()} == {0.0}
    assert quality.learned(docs, marks).share == 0.5


def _rows(spark, tmp_path, x, y):
    data = [(bytearray(row.tobytes()), int(k)) for row, k in zip(x, y, strict=True)]
    path = str(tmp_path / "rows")
    spark.createDataFrame(data, "x binary, y int").repartition(6).write.parquet(path)
    return spark.read.parquet(path)


def test_weights_are_least_over_all_pairs(spark, tmp_path, monkeypatch):
    r = np.random.default_rng(4)
    y = (r.random(700) < 0.7).astype(np.int64)
    x = np.minimum(r.integers(0, 5, (700, 6)) + (r.random((700, 6)) < 0.3) * y[:, None], 4).astype(np.uint8)
    n = np.bincount(y).astype(float)
    w = ranking.ranked(ranking.here(x, y), 6, 5, n)
    hot = np.zeros((700, 30))
    hot[np.arange(700)[:, None], x + np.arange(6) * 5] = 1
    away = (hot[y == 1][:, None] - hot[y == 0][None]).reshape(-1, 30)
    gradient = -(away / (1 + np.exp(away @ w))[:, None]).mean(axis=0) + ranking.RIDGE * w
    assert np.abs(gradient).max() < 1e-5 < 0.05 < np.abs(away.mean(axis=0)).max()
    monkeypatch.setattr(ranking, "FAN", 2)
    monkeypatch.setattr(ranking, "BLOCK", 50)
    table = _rows(spark, tmp_path, x, y)
    assert table.rdd.getNumPartitions() > 2
    np.testing.assert_allclose(ranking.ranked(ranking.over(table, "uint8"), 6, 5, n), w, atol=1e-6)


def test_quantiles_of_any_doubles(spark, tmp_path):
    r = np.random.default_rng(1)
    x = np.column_stack([r.normal(size=500) * 10.0 ** r.integers(-300, 300, 500), r.integers(-2, 2, 500) * 0.5, np.where(r.random(500) < 0.5, -0.0, 0.0)])
    y = r.integers(0, 2, 500)
    column, goal, weight = np.repeat([0, 1, 2], 5), np.tile([1.0, 100, 400.5, 700, 1e9], 3), np.array([1.0, 2.0])
    for rows in (ranking.here(x, y), ranking.over(_rows(spark, tmp_path, x, y), "float64")):
        value, after = ranking.quantiles(rows, lambda x: x, column, goal, weight)
        for c, g, v, a in zip(column, goal, value, after, strict=True):
            order = np.argsort(x[:, c], kind="stable")
            reach = np.cumsum(weight[y[order]])
            assert v == x[order, c][min(np.searchsorted(reach, g), 499)]
            assert a == np.min(x[:, c], initial=np.inf, where=x[:, c] > v)
        tmp_path = tmp_path / "again"
