"""Encoding, decoding and token-id files against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import bpe, token_files

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LETTERS = [chr(c) for c in [*range(0, 0x250), *range(0x1680, 0x1690), *range(0x2000, 0x2070), 0x3000, 0xFEFF, 0x1F600, 0x4E2D, 0x301, 0x661, 0x2167, 0x130]]
HARD = ["", " ", "a<|endoftext|>b  <|endoftext|>", "\0<|endoftext|>", "=" * 300, "aaaa aaa", "don't'll X's \t y", "\n\n x", "tail.  ", "<|ENDOFTEXT|>. <|startoftext|>"]


def texts():
    r = random.Random(4)
    return HARD + ["".join(r.choices(LETTERS, k=40)) for _ in range(400)] + ["".join(r.choices("abr eo's.,T", k=60)) for _ in range(400)]


@pytest.fixture(scope="module")
def machine():
    return bpe.automaton(bpe.specification(BYTE))


def test_automaton_encodes_as_the_library(machine):
    library = Tokenizer.from_file(BYTE)
    ids, at = machine.encode_batch(texts())
    for k, (text, want) in enumerate(zip(texts(), library.encode_batch(texts(), add_special_tokens=False), strict=True)):
        assert ids[at[k] : at[k + 1]].tolist() == want.ids, text
    data, ends = machine.decode_batch(ids, at)
    assert [data[a:b].tobytes().decode() for a, b in zip(ends, ends[1:], strict=False)] == texts()


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab ing'tsre\n", max_size=60))
def test_automaton_merges_like_the_ranks(text):
    m = bpe.automaton(bpe.specification(BYTE))
    ids, _ = m.encode_batch([text])
    assert ids.tolist() == Tokenizer.from_file(BYTE).encode(text, add_special_tokens=False).ids


def test_round_trip_query(spark):
    rows = [(k, t) for k, t in enumerate(texts()[:60])] + [(100, None), (3, texts()[3]), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"ids": F.lit(1), "decoded": F.lit("clash")})
    out = bpe.round_trip(df, BYTE).collect()
    assert len(out) == len(rows)
    library, whole = Tokenizer.from_file(BYTE), dict(rows)
    for r in out:
        ids = library.encode(whole[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((whole[r["doc_id"]] or "").encode()).hexdigest()
    assert bpe.round_trip(df.limit(0), BYTE).count() == 0


def test_decoding_alone(spark):
    df = spark.createDataFrame([([15496, 995],), (None,), ([99999999, 0],), ([254 - 188],)], "ids array<int>")
    assert [r["decoded"] for r in bpe.decode(df, BYTE).collect()][:3] == ["Hello world", "", "!"]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.sampled_from([4, 32]), st.integers(1, 70), st.integers(0, 310), st.integers(0, 310))
def test_files_give_back_any_span(ids, planes, block, a, b):
    data = token_files.pack(np.array(ids, dtype=np.uint32), block, planes)
    assert token_files.unpack(data).tolist() == ids
    assert token_files.unpack(data, a, b).tolist() == (ids[a:b] if a <= b else [])


def test_files_refuse_other_data():
    with pytest.raises(ValueError):
        token_files.unpack(b"x" * 64)
    with pytest.raises(ValueError):
        token_files.pack(np.zeros(1, np.uint32), planes=8)


def test_stored_documents(spark):
    rows = [(k * 7 % 61, t) for k, t in enumerate(texts()[:61])] + [(500, None), (7, "again"), (None, "no id")]
    out = token_files.stored(spark.createDataFrame(rows, "doc_id bigint, text string"), WORD).collect()
    library, start = Tokenizer.from_file(WORD), 0
    ordered = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    for r, (doc_id, text) in zip(sorted(out, key=lambda r: r["start"]), ordered, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (doc_id, start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)
    assert token_files.stored(spark.createDataFrame([], "doc_id bigint, text string"), WORD).count() == 0
