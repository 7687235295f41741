"""Scorers and classifiers: brute force, held-out accuracy, odd rows."""

import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import langid, lm, quality, toxicity

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def crc(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def some(spark, texts, lang="en"):
    return spark.createDataFrame([(k, t, lang, "s", None) for k, t in enumerate(texts)], SCHEMA)


def test_lm_against_brute_force(spark, monkeypatch):
    r = random.Random(2)
    words = ["The", "cat", "sat", "on", "mat", "dög", "ran"]
    texts = [" ".join(r.choices(words, k=r.randint(0, 12))) for _ in range(60)] + [None, "unseen  words\thère", "   "]
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(texts)] + [(5, texts[5], "en", "s", 0), (None, "the cat", "en", "s", 0)]
    w = (0.5, 0.3, 0.2)
    monkeypatch.setattr(lm, "_weights", lambda seen: np.tile(w, (lm.CONTEXTS, 1)))
    monkeypatch.setattr(lm, "BLOCK_BYTES", 400)
    monkeypatch.setattr(lm, "BUCKET_TOKENS", 20)
    out = lm.scored(spark.createDataFrame(rows, SCHEMA)).collect()
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    cut = lambda t: re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + ["</s>"]
    one, two, context = Counter(), Counter(), Counter()
    for doc_id, t, *_ in rows:
        if crc(doc_id, 10):
            x = cut(t)
            one.update(x)
            two.update(zip(["<s>", *x], x, strict=False))
            context.update(["<s>", *x][: len(x)])
    total, distinct = sum(one.values()), len(one)
    want = Counter()
    for doc_id, t, *_ in rows:
        x = cut(t)
        base = sum(math.log10((one[k] + 0.1) / (total + 0.1 * (distinct + 1))) for k in x)
        score = sum(math.log10(w[0] * (two[a, k] / context[a] if context[a] else 0) + w[1] * one[k] / total + w[2] / (distinct + 1)) for a, k in zip(["<s>", *x], x, strict=False))
        want[doc_id, crc(doc_id, 10) == 0, len(x), sum(one[k] > 0 for k in x), total, round(base, 8), round(score, 8)] += 1
    got = Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 8), round(r["score"], 8)) for r in out)
    assert got == want


def test_lm_beats_its_base_on_held_out_text(spark):
    out = lm.scored(spark.read.parquet(f"{DATA}/documents.parquet")).where("held_out").toPandas()
    assert out["score"].sum() > out["base_score"].sum() and (out["n_known"] <= out["n_tokens"]).all()


def test_lm_of_nothing(spark):
    assert lm.scored(some(spark, [])).count() == 0
    assert lm.scored(spark.createDataFrame([(0, "held out only", "en", "s", 0)], SCHEMA)).count() == 1


def test_em_finds_the_better_part():
    w = lm._weights([(3, 40, 0, 900), (3, None, 0, 100), (5, None, 8, 500)])
    assert w[3][0] > 0.6 and w[5][1] > w[5][2] and np.allclose(w.sum(axis=1), 1)


def test_language_accuracy_and_odd_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = langid.predicted(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (out["lang"] == out["lang_pred"]).mean() > 0.97 and out["score"].between(0, 1).all()
    model = langid.learned(docs)
    odd = some(spark, [None, "", " 123 !?", "é", "the and of that with"])
    got = [r["lang_pred"] for r in langid.identify(odd.drop("source"), model).orderBy("doc_id").collect()]
    assert got[:3] == ["und"] * 3 and "und" not in got[3:]
    assert {r["lang_pred"] for r in langid.identify(odd, None).collect()} == {"und"}
    assert langid.accepted(docs.limit(0)).columns == docs.columns


def test_families_hold_their_languages():
    texts = ["der die das und " * 3, "the and of with " * 3, "le la les des est " * 3, "el los las y que " * 3] * 6
    model = langid.fit(texts, ["de", "en", "fr", "es"] * 6)
    assert sorted(map(len, model.families)) == [2, 2] and len(model.pairs) == 2


def brute_kernel(s, t, length=toxicity.LENGTH, decay=toxicity.DECAY):
    total = 0.0
    for a in combinations(range(len(s)), length):
        for b in combinations(range(len(t)), length):
            if all(s[i] == t[j] for i, j in zip(a, b, strict=True)):
                total += decay ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return total


@pytest.mark.parametrize("s, t", [(b"idiot", b"idxiot"), (b"aaaa", b"aa"), (b"banana", b"ananas"), (b"abc", b"abc"), (b"", b"abc")])
def test_kernel_counts_gapped_subsequences(s, t):
    a, b = toxicity._grid([s], 8), toxicity._grid([t], 8)
    assert toxicity._raw_kernel(a, b)[0] == pytest.approx(brute_kernel(s, t), rel=1e-4, abs=1e-6)


def _toxic_texts():
    r = random.Random(3)
    plain = ["".join(r.choices(["an", "er", "th", "in", "on", "re", "st"], k=r.randint(1, 4))) for _ in range(400)]
    texts, labels = [], []
    for k in range(500):
        words = r.choices(plain, k=r.randint(8, 40))
        if k % 4 == 0:
            words.insert(r.randrange(len(words)), r.choice(["blockhead", "numbskull", "dimwit"]))
        texts.append(" ".join(words) + ".")
        labels.append(int(k % 4 == 0))
    return texts, labels


def test_toxicity_finds_hidden_insults(spark):
    texts, labels = _toxic_texts()
    docs = some(spark, texts)
    marks = spark.createDataFrame([(k, 1, y) for k, y in enumerate(labels)] + [(None, 1, 1)], "doc_id bigint, quality int, toxic int")
    out = {r["doc_id"]: r for r in toxicity.predicted(docs, marks).collect()}
    held = [k for k in out if crc(k, 5) == 0]
    assert all(out[k]["held_out"] == (crc(k, 5) == 0) for k in out)
    assert np.mean([out[k]["predicted"] == labels[k] for k in held]) > 0.97
    model = toxicity.learned(docs, marks)
    hidden = ["an er block-head on", "in b l o c k h e a d re", "th blocxkhead st", "er num.b.skull on", "on dimwiit an"]
    assert (model.score(pa.array(hidden)) >= 0.5).all()
    assert (model.score(pa.array(["ander thin reston", None, "", "x" * 5000, "a b c d e f"])) < 0.5).all()
    assert toxicity.accepted(docs, marks).columns == docs.columns
    assert toxicity.predicted(docs, marks.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.predicted(docs.limit(0), marks).count() == 0


def test_quality_ranks_and_thresholds(spark):
    r = random.Random(5)
    good = [" ".join("".join(r.choices("abcdefg", k=5)) for _ in range(40)) + "." for _ in range(300)]
    bad = [("SHOUT!! " * 30) if k % 2 else ("same " * 40) for k in range(100)]
    texts = good + bad
    labels = [1] * 300 + [0] * 100
    docs = some(spark, [*texts, None, ""])
    marks = spark.createDataFrame([(k, y, 0) for k, y in enumerate(labels)], "doc_id bigint, quality int, toxic int")
    out = {x["doc_id"]: x for x in quality.predicted(docs, marks).collect()}
    assert np.mean([out[k]["predicted"] == labels[k] for k in range(400) if crc(k, 4) == 2]) > 0.97
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.7) for x in out.values())
    assert {x["score"] for x in quality.predicted(docs, marks.limit(0)).collect()} == {1.0}
    assert quality.predicted(docs.limit(0), marks).count() == 0


def test_quality_measures_are_finite():
    x = quality.measures(pa.array([None, "", " ", "a", "a a\n a", "é" * 3000]))
    assert np.isfinite(x).all()
