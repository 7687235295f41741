"""Shards against the laws they keep, and the least capacity against a plain search over all partitions."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import queries, sharding

SCHEMA = "doc_id long, text string"


def plain_least(sizes, shards):
    """The least capacity by dynamic programming over all contiguous partitions."""
    sums = np.concatenate([[0], np.cumsum(sizes)])
    best = sums.astype(float)  # one shard
    for _ in range(shards - 1):
        best = np.array([min(max(best[j], sums[i] - sums[j]) for j in range(i + 1)) for i in range(len(sums))])
    return int(best[-1])


@pytest.mark.parametrize("seed", range(40))
def test_least_capacity_and_cuts(seed):
    rng = random.Random(seed)
    sizes = np.array([rng.choice([1, 2, 9, rng.randint(1, 300)]) for _ in range(rng.randint(1, 60))])
    shards = rng.randint(2, 9)
    one = np.ones(len(sizes), bool)
    ranges = sharding.Ranges(np.arange(len(sizes)), np.full(len(sizes), 64), sizes, one)
    least = sharding.least_capacity(ranges.edge, one, shards, False)
    assert least == plain_least(sizes, shards)
    ends = [0, *sharding.cuts(ranges, shards, least), int(sizes.sum())]
    assert max(np.diff(ends)) == least and min(np.diff(ends)) >= 0 and set(ends) <= set(ranges.edge.tolist())


def plain_groups(rows):
    out = {}
    for r in rows:
        out[r[1] or ""] = out.get(r[1] or "", 0) + len((r[1] or "").encode()) + 8
    return out


def checked(spark, rows, shards, docs=None):
    docs = spark.createDataFrame(rows, SCHEMA) if docs is None else docs
    ours = sharding.assigned(docs, shards).collect()
    assert sorted((repr(r[0]), r[1], r[2]) for r in ours) == sorted((repr(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in (x[:2] for x in rows))
    slots, sizes, homes = {}, [0] * shards, {}
    for r in ours:
        slots.setdefault(r.shard, []).append(r.slot)
        sizes[r.shard] += r["size"]
        homes.setdefault((r["size"], r.text_crc32), set()).add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(x) == 1 for x in homes.values())
    return sizes


def expected(spark, rows, shards):
    """Groups alone in a shard, and the least capacity of the rest in the order of the hashes."""
    groups = plain_groups(rows)
    hashes = {r[0]: r[1] for r in spark.createDataFrame([(t,) for t in groups], "t string").select("t", F.xxhash64("t")).collect()}
    total, alone = sum(groups.values()), []
    for t in sorted(groups, key=lambda t: (-groups[t], hashes[t])):
        if len(alone) == shards - 1 or groups[t] * (shards - len(alone)) < total:
            break
        alone.append(t)
        total -= groups[t]
    rest = [groups[t] for t in sorted(groups, key=hashes.get) if t not in alone]
    return sorted(groups[t] for t in alone), plain_least(rest, shards - len(alone)) if rest else 0


@pytest.mark.parametrize("seed,n,hot", [(1, 300, 0), (2, 300, 150), (3, 40, 10), (4, 10, 3), (5, 1, 0)])
def test_shards(spark, seed, n, hot, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST_BITS", 3)
    monkeypatch.setattr(sharding, "MORE_BITS", 2)
    monkeypatch.setattr(sharding, "ROWS", 50)
    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(n)]), rng.choice([None, "", "ä" * rng.randint(0, 40), "x" * rng.randint(0, 400)])) for _ in range(n)]
    rows += [(k, "copy " * 30) for k in range(hot)] + [(7, "same row")] * (hot // 3)
    sizes = checked(spark, rows, 7)
    alone, least = expected(spark, rows, 7)
    assert sorted(sizes[: len(alone)]) == alone
    assert max(sizes[len(alone) :]) == least


def test_many_small_groups_are_nearly_equal(spark):
    rows = [(k, "word " * (k % 37) + str(k)) for k in range(5000)]
    sizes = checked(spark, rows, 24)
    assert max(sizes) - min(sizes) < 600


def test_clashing_columns_long_text_and_empty(spark, tmp_path):
    rows = [(1, "x" * 3_000_000), (2, "b"), (3, None), (None, "b")]
    docs = spark.createDataFrame([(*r, 5, "z", 3) for r in rows], SCHEMA + ", shard int, law string, h int")
    assert sorted(checked(spark, rows, 2, docs)) == [26, 3_000_008]
    sharding.stored(docs, f"{tmp_path}/out", 2)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(docs.columns) == sorted(set(back.columns) - {"_shard"}) and back.count() == 4
    assert back.where("text = 'b'").select("_shard").distinct().count() == 1
    assert sharding.assigned(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark):
    ours = queries.op11_shards(spark, "/root/testdata/sf0.001")
    assert ours.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert [x for _, x in ours.dtypes] == ["bigint", "bigint", "bigint", "string", "int", "bigint", "int"]
    assert ours.select("shard").distinct().count() == 24
