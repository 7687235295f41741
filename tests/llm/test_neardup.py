"""The pipeline's near-duplicate stage against brute-force Jaccard groups."""

import random

import corpus_pipeline
import pytest

from quarry.llm import neardup

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], DOCS)


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())


def brute(rows):
    """For each row the number of the first one in its component."""
    sets, label = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if (x == y or 5 * len(x & y) >= 4 * len(x | y)) and label[i] != label[j]:
                a, b = max(label[i], label[j]), min(label[i], label[j])
                label = [b if v == a else v for v in label]
    return label


def copies(seed):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(400)]
    line = r.choices(words, k=20)
    out = []
    for group in range(20):
        base = r.choices(words, k=r.randint(20, 300)) + line * (group % 2)
        for _ in range(30 if group == 3 else r.randint(1, 6)):
            copy = list(base)
            for _ in range(r.randint(0, 1 + len(base) // 35)):
                copy[r.randrange(len(copy))] = r.choice(words)
            out.append(" ".join(copy).upper() if r.random() < 0.2 else "  ".join(copy))
    return out + ["", None, " \t", "one", "ONE", "one two", "a b c d e", "a b c d e f", "a b c d e a b c d e"]


@pytest.mark.parametrize("sample, cell", [(20_000, 20_000), (0, 5)])
def test_near_dedup_against_brute_force(spark, sample, cell, monkeypatch):
    monkeypatch.setattr(neardup, "SAMPLE", sample)
    monkeypatch.setattr(neardup, "CELL", cell)
    rows = list(enumerate(copies(5), 10))
    label = brute(rows)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs(spark, rows), "")
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(rows[k][0] for k in set(label))
    assert kept.columns == docs(spark, []).columns and len(set(label)) < len(rows) - 40
    assert corpus_pipeline.drop_near_duplicates(spark, docs(spark, []), "").count() == 0


def test_near_dedup_chooses_rows_not_ids(spark):
    r = random.Random(3)
    a, b, c, d = (" ".join(r.choices("abcdefghijklmnopqrstuvw", k=40)) for _ in range(4))
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (3, c), (None, c), (None, d), (None, d + " x"), (None, None), (None, "")]
    kept = corpus_pipeline.drop_near_duplicates(spark, docs(spark, rows), "")
    got = [(x["doc_id"], x["text"]) for x in kept.collect()]
    assert len(got) == 5 and {x for x in got if x[0] is not None} == {(1, a), (2, b), (3, c)}
    assert sum(shingles(t) == set() for _, t in got) == 1 and sum((t or "").startswith(d) for _, t in got) == 1
