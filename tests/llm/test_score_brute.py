"""Language and quality scores against plain Python, text by text; clashing columns, repeated rows, very long texts."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarry.llm import langid, quality

DOCS = "/root/testdata/sf0.001/documents.parquet"
LONG = "the long text goes on and on, " * 20_000
ODD = [None, "", "12 34", "Der Hund läuft über die Straße.", "the the the", "¿Dónde está?\n\nAquí | no", LONG, "the the the"]


def _grams(text):
    """Counts of hashed byte n-grams, one text at a time."""
    data = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in (b + 32 if 0x41 <= b <= 0x5A else b for b in (text or "").encode()))
    out = Counter()
    for k in range(2, 5):
        for i in range(len(data) - k + 1):
            code = int.from_bytes(data[i : i + k], "big") % 2**32
            out[((code + k - 1) % 2**32 * 2654435761 % 2**32) >> 20] += 1
    return out


def _logistic(x):
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _language(model, text):
    if not any(x.isalpha() for x in text or ""):
        return "und", 1.0
    grams = _grams(text)
    size = math.sqrt(sum(grams.values())) or 1
    margin = lambda w: sum(math.sqrt(n) / size * float(w[k]) for k, n in grams.items()) + float(w[-1])
    tops = [_logistic(margin(model.family_weights[:, f]) * a + b) for f, (a, b) in enumerate(model.family_scales)] if len(model.families) > 1 else [1.0]
    best = max(range(len(tops)), key=lambda f: tops[f])
    members, score = model.families[best], tops[best] / sum(tops)
    votes = dict.fromkeys(members, 0.0)
    for k, (a, b) in enumerate(model.pairs):
        if a in votes:
            p = _logistic(margin(model.pair_weights[:, k]) * model.pair_scales[k][0] + model.pair_scales[k][1])
            votes[a] += p
            votes[b] += 1 - p
    won = max(members, key=lambda x: votes[x])
    return model.languages[won], score * (votes[won] / sum(votes.values()) if len(members) > 1 else 1.0)


def test_language_by_brute_force(spark):
    docs = spark.read.parquet(DOCS)
    model = langid.learned(docs)
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(60).collect()] + ODD
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("score", F.lit("mine")).withColumn("lang_pred", F.lit(3)).withColumn("run", F.lit(None).cast("int"))
    out = langid.identify(df, model).collect()
    assert len(out) == len(texts) and set(out[0].asDict()) == {"doc_id", "text", "run", "lang_pred", "score"}
    for r in out:
        lang, score = _language(model, texts[r["doc_id"]])
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-4, texts[r["doc_id"]]


def test_language_stage_keeps_clashing_columns_and_repeats(spark):
    docs = spark.read.parquet(DOCS).withColumn("score", F.lit("mine")).withColumn("lang_pred", F.lit(3))
    twice = docs.union(docs)
    kept = langid.accepted(twice)
    assert kept.columns == docs.columns and kept.count() == 2 * langid.accepted(docs).count() > 0
    assert {r["score"] for r in kept.select("score").distinct().collect()} == {"mine"}


def _measures(text):
    text = text or ""
    data = text.encode()
    size = max(1, len(data))
    words, word = [], bytearray()
    for b in data + b" ":
        if b == 0x20 or 9 <= b <= 13:
            if word:
                words.append(bytes(word).lower())
            word = bytearray()
        else:
            word.append(b)
    count = max(1, len(words))
    mean = sum(map(len, words)) / count
    seconds = list(zip(words, words[1:], strict=False))
    lines = data.count(b"\n") + 1
    return [
        math.log1p(len(data)), *[sum(b in kind for b in data) / size for kind in quality._KINDS],
        math.log1p(len(words)), mean, math.sqrt(max(0, sum(len(w) ** 2 for w in words) / count - mean**2)),
        sum(a == b for a, b in seconds) / count, len(set(words)) / count, max(Counter(words).values(), default=0) / count, len(set(seconds)) / len(seconds) if seconds else 1.0,
        math.log1p(len(words) / lines), math.log1p(len(data) / lines),
    ]


def test_quality_measures_by_brute_force(spark):
    texts = [r["text"] for r in spark.read.parquet(DOCS).orderBy("doc_id").limit(80).collect()] + ODD
    np.testing.assert_allclose(quality.measures(pa.array(texts)), [_measures(x) for x in texts], rtol=1e-9, atol=1e-7)


def test_quality_scores_by_brute_force(spark):
    pick = random.Random(3)
    words = [f"word{k}" for k in range(50)]
    texts = [" ".join(pick.choice(words) for _ in range(pick.randrange(3, 60))) + ("." if k % 2 else " !!! BUY") for k in range(200)]
    y = [k % 2 for k in range(200)]
    model = quality.fit(texts, y, {0: 300.0, 1: 100.0})
    x = quality.measures(pa.array(texts))

    def worth(row):
        return sum(float(model.weights[k * quality.BINS + sum(c <= v for c in cut)]) for k, (v, cut) in enumerate(zip(row, model.cuts, strict=True)))

    plain = [worth(row) for row in x]
    np.testing.assert_allclose(model.worth(x), plain, atol=1e-9)
    # a label-1 text stands above each label-0 text, and the threshold cuts off three quarters of the labelled rows
    assert min(w for w, good in zip(plain, y, strict=True) if good) > max(w for w, good in zip(plain, y, strict=True) if not good)
    assert all((w > model.threshold) == bool(good) for w, good in zip(plain, y, strict=True))
    df = spark.createDataFrame(list(enumerate([*texts, *ODD])), "doc_id bigint, text string").withColumn("score", F.lit("mine")).withColumn("predicted", F.lit("x"))
    out = {r["doc_id"]: r for r in quality.judged(df, model).collect()}
    assert len(out) == len(texts) + len(ODD)
    for k, text in enumerate([*texts, *ODD]):
        want = _logistic((worth(_measures(text)) - model.threshold) / model.scale + math.log(0.7 / 0.3))
        assert abs(out[k]["score"] - want) < 1e-6 and out[k]["predicted"] == int(out[k]["score"] >= 0.7), text
