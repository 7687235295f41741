"""Scores don't depend on how many times keys are dealt."""

import numpy as np
import pytest

from quarry.llm import lm


@pytest.mark.parametrize("split, together, most", [(2, 2, 6000), (1, 1, 20_000)])
def test_levels_give_the_same_scores(spark, monkeypatch, split, together, most):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    monkeypatch.setattr(lm, "BLOCK_BYTES", 100_000)
    order = ["doc_id", "score"]
    want = lm.scored(docs).toPandas().sort_values(order).reset_index(drop=True)
    monkeypatch.setattr(lm, "SPLIT", split)
    monkeypatch.setattr(lm, "TOGETHER", together)
    monkeypatch.setattr(lm, "BUCKET_TOKENS", most)
    got = lm.scored(docs).toPandas().sort_values(order).reset_index(drop=True)
    assert np.allclose(got["score"], want["score"]) and np.allclose(got["base_score"], want["base_score"])
    assert (got[["doc_id", "n_tokens", "n_known", "train_tokens"]] == want[["doc_id", "n_tokens", "n_known", "train_tokens"]]).all(axis=None)
