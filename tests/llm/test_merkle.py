"""The manifest against a plain tree on the driver, and against SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def plain_leaf(r, more=0):
    doc_id, text, lang, source, n = r[:5]
    return sha("".join(map(field, (doc_id, source, lang, n if n is None else n + more, text))))


def plain_tree(leaves, fanout):
    """Levels, and each leaf's sibling runs and places on the way up."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
    ways = []
    for i in range(len(leaves)):
        way = []
        for level in levels[:-1]:
            first = i - i % fanout
            way.append((level[first:i], level[i + 1 : first + fanout]))
            i //= fanout
        ways.append(way)
    return levels, ways


def plain(rows, fanout=2):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    subroots, found = [], []
    for lang in order:
        own = sorted(groups[lang], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        levels, ways = plain_tree([plain_leaf(r) for r in own], fanout)
        subroots.append(levels[-1][0])
        found.append((own, ways))
    levels, tops = plain_tree(subroots, fanout)
    root = levels[-1][0]
    out = []
    for k, (own, ways) in enumerate(found):
        for r, way in zip(own, ways, strict=True):
            hit = zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 7 == 0
            d, proof = plain_leaf(r, int(hit)), ""
            for before, after in way + tops[k]:
                d = sha("".join([*before, d, *after]))
                proof += "".join(before + after)
            out.append((r[0], plain_leaf(r), subroots[k], root, sha(proof), d, d == root))
    return sorted(out, key=repr)


def rows_of(seed, n, langs):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        text = rng.choice([None, "", "naïve – text\n", "x" * 40000, "word " * rng.randint(1, 30)])
        rows.append((rng.choice([None, *range(4 * n)]), text, rng.choice(langs), rng.choice([None, "src0", "ß"]), rng.choice([None, 0, len(text or ""), 2**63 - 1])))
    return rows + rows[: n // 5]  # repeated rows


def tampered():
    more = F.col("n_chars").cast("decimal(21,0)") + 1
    return F.when((F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull(), merkle.leaf(more))


@pytest.mark.parametrize("seed,n,langs,fanout,stretch,block", [
    (1, 150, ["en", "en", "en", None, "", "é", "fr"], 2, 13, 8), (2, 64, ["en"], 2, 7, 4), (3, 90, [None, "a", "b"], 3, 11, 9), (4, 1, ["en"], 2, 1 << 16, 1 << 20), (5, 70, [str(k) for k in range(40)], 2, 5, 1 << 20),
])
def test_manifest(spark, seed, n, langs, fanout, stretch, block):
    rows = rows_of(seed, n, langs)
    docs = spark.createDataFrame([(*r, "e", 1) for r in rows], SCHEMA + ", root string, at int").repartition(3)  # clashing names
    ours = sorted(map(tuple, merkle.manifest(docs, tampered(), fanout, stretch, block).collect()), key=repr)
    assert ours == plain(rows, fanout)


def test_nodes(spark):
    rows = rows_of(9, 80, ["en", "en", None])
    told = {}
    for r in merkle.nodes(spark.createDataFrame(rows, SCHEMA), 2, 13, 8).collect():
        assert told.setdefault((r[0], r[1], r[2]), r[3]) == r[3]
    for lang in ("en", None):
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        levels, _ = plain_tree([plain_leaf(r) for r in own], 2)
        assert {k[1:]: v for k, v in told.items() if k[0] == lang} == {(a, b): d for a, level in enumerate(levels) for b, d in enumerate(level)}


def test_empty(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stack_of_a_range_that_is_not_aligned():
    r = merkle.Range(5, 2, 10)
    for d in "abcdefg":  # leaves 5 to 11
        r.push(d)
    assert [x[:2] for x in r.stack] == [(0, 5), (1, 3), (2, 2)]


def test_sql(spark):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{data}/documents.parquet')")
    ours = sorted(map(tuple, queries.op12_merkle_manifest(spark, data).collect()))
    told = con.sql(queries.OP12_SQL)
    assert told.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert ours == sorted(told.fetchall())
    assert {r[6] for r in ours} == {True, False}
