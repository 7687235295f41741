"""Toxicity scores against a plain program of what the operator's docstring says."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import toxicity as tx


def units(text):
    """(sentence, unit) of a text's words, and its number of words."""
    raw, found, number = (text or "").encode(), [], 0
    kept = []
    for k, c in enumerate(raw):
        space = c == 0x20 or 9 <= c <= 13
        if space or chr(c).isalnum() and c < 128 or c >= 128:
            kept.append((bytes([c]).lower(), number, space))
        last = k + 1 == len(raw) or raw[k + 1] == 0x20 or 9 <= raw[k + 1] <= 13
        number += c == 10 or c in b".!?;:" and last
    word = []
    for c, n, space in [*kept, (b"", 0, True)]:
        if space and word:
            found.append((word[0][1], b"".join(x for x, _ in word)))
        word = [] if space else [*word, (c, n)]
    words, extra = len(found), []
    for single, run in itertools.groupby(found, key=lambda x: len(x[1].decode(errors="replace")) == 1):
        run = list(run)
        if single and len(run) >= 3:
            extra.append((run[0][0], b"".join(x for _, x in run)))
    return [(n, b"\x02" + w + b"\x03") for n, w in found + extra], words


def raw_kernel(s, t):
    total = 0.0
    for i in itertools.combinations(range(len(s)), 3):
        for j in itertools.combinations(range(len(t)), 3):
            if all(s[a] == t[b] for a, b in zip(i, j, strict=True)):
                total += 0.7 ** (i[2] - i[0] + 1 + j[2] - j[0] + 1)
    return total


def kernel(unit, mark):
    own = {(mark[k], mark[k + 1]) for k in range(len(mark) - 1)}
    have = {(unit[a], unit[b]) for a in range(len(unit)) for b in range(a + 1, min(len(unit), a + 4))}
    if len(own & have) < max(1, math.ceil(0.6 * len(own) - 1e-9)):
        return 0.0
    scale = math.sqrt(raw_kernel(unit, unit) * raw_kernel(mark, mark))
    return (raw_kernel(unit, mark) / scale) ** 3 if scale else 0.0


def score(model, text):
    found, words = units(text)
    told = [math.tanh(model.weights[-1])]
    for n in {n for n, _ in found}:
        x = np.array([max(kernel(u, m) for s, u in found if s == n) for m in model.landmarks])
        if x.any():
            told.append(math.tanh(x @ model.root @ model.weights[:-1] + model.weights[-1]))
    features = max(told), min(1.0, sum(max(0.0, x) for x in told[1:]) / (1 + words / 50))
    return 1 / (1 + math.exp(-(features[0] * model.scale[0] + features[1] * model.scale[1] + model.scale[2])))


def corpus(seed):
    r = random.Random(seed)
    words = ["".join(r.choices("abdeimnorst", k=r.randint(2, 6))) for _ in range(60)]
    texts, labels = [], []
    for k in range(160):
        text = r.choices(words, k=r.randint(3, 25))
        if k % 2:
            for _ in range(r.randint(1, 3)):
                text.insert(r.randrange(len(text) + 1), r.choice(["moron", "idiot", "bastard", "oaf"]))
        texts.append(" ".join(x + r.choice([".", "", "", "! ", "\n"]) for x in text))
        labels.append(k % 2)
    return texts, labels


@pytest.mark.parametrize("seed", [1, 2])
def test_scores_against_brute_force(seed):
    texts, labels = corpus(seed)
    model = tx.fit(texts, labels, {0: 80, 1: 80})
    assert any(b"idiot" in x for x in model.landmarks) and any(b"oaf" in x for x in model.landmarks)
    odd = ["", None, "I.D.I.O.T", "i d i o t you", "mo-ron!", "mxoron", "IDI0T", "é" * 5, "a b", "\n\n.!?", "idiot " * 30, "x" * 30, "moron. nothing here. idiot"]
    asked = odd + texts[:12]
    got = model.score(pa.array(asked, pa.string()))
    assert np.allclose(got, [score(model, x) for x in asked], atol=1e-4)


def test_landmark_matrix_is_of_the_features_kernel():
    texts, labels = corpus(3)
    model = tx.fit(texts, labels, {0: 80, 1: 80})
    own = np.array([[kernel(a, b) for b in model.landmarks] for a in model.landmarks])
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    assert np.allclose(model.root, (vectors / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T, atol=1e-2)


def test_held_out_accuracy_and_false_alarms(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = tx.predicted(docs, labels).where("held_out").join(labels.where("toxic in (0, 1)"), "doc_id").collect()
    clean = [x for x in rows if x["toxic"] == 0]
    assert sum(x["predicted"] for x in clean) <= 0.02 * len(clean) and sum(x["predicted"] == x["toxic"] for x in rows) > 0.95 * len(rows)
