"""Queries of this subpackage's operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import bpe

    return bpe.round_trip(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import token_files

    return token_files.stored(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import lm

    return lm.scored(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import langid

    return langid.predicted(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import toxicity

    return toxicity.predicted(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import ann

    return ann.neighbours(_table(spark, sf_dir, "embeddings"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import html_text

    return html_text.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import decontam

    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("text_hash")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import quality

    return quality.predicted(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import simhash

    return simhash.grouped(_table(spark, sf_dir, "documents"))


def op11_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import sharding

    return sharding.assigned(_table(spark, sf_dir, "documents"), 24)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from quarry.llm import merkle
    from quarry.llm._shared import remainder

    more = F.col("n_chars").cast("decimal(21,0)") + 1  # tampering never overflows
    tampered = F.when((remainder(F.col("doc_id"), 7) == 0) & F.col("n_chars").isNotNull(), merkle.leaf(more))
    return merkle.manifest(_table(spark, sf_dir, "documents"), tampered)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import periodic

    return periodic.digests(_table(spark, sf_dir, "documents"), _stuttered)


def _stuttered(doc_id: int | None, n: int):
    """Where crc32(doc_id) is divisible by 10, the words from a on read the p words from a again and again."""
    import zlib

    import numpy as np

    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe_round_trip, op2_token_files, op3_lm_scores, op4_language_id, op5_toxicity, op6_nearest_neighbours, op7_html_text, op8_decontamination, op9_quality, op10_simhash_groups, op11_shards, op12_merkle_manifest, op13_periodic_runs)}


_CUT = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"

#: Every pair of equal words of a document and an item votes for the place at which the item lies along the document.
OP8_SQL = f"""WITH d AS (SELECT doc_id, {_CUT} AS w FROM documents), i AS (SELECT DISTINCT item_id, {_CUT} AS w FROM benchmark),
 dw AS (SELECT doc_id, p, w[p] AS x FROM d, unnest(range(1, len(w) + 1)) AS t(p)), iw AS (SELECT item_id, k, w[k] AS x, len(w) AS n FROM i, unnest(range(1, len(w) + 1)) AS t(k)),
 m AS (SELECT doc_id, item_id, p - k AS place, k, n FROM dw JOIN iw USING (x)), good AS (SELECT doc_id, item_id, place, count(*) AS total FROM m GROUP BY 1, 2, 3 HAVING count(*) >= ceil(0.8 * least(any_value(n), 13))),
 near AS (SELECT m.*, total, count(*) OVER (PARTITION BY doc_id, item_id, place ORDER BY k RANGE BETWEEN CURRENT ROW AND (least(n, 13) - 1) FOLLOWING) AS c FROM m JOIN good USING (doc_id, item_id, place))
 SELECT doc_id, item_id, max(total) AS n_equal, max(n) AS n_words FROM near WHERE c >= ceil(0.8 * least(n, 13)) GROUP BY 1, 2"""


#: crc32 bit by bit; levels of all trees, then of the tree over them; each leaf's way up by one join a level.
OP12_SQL = """WITH RECURSIVE f AS (SELECT row_number() OVER () AS row, *, coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS a, coalesce(octet_length(encode(text)) || ':' || text, '-') AS z FROM documents),
 c AS (SELECT *, 4294967295 - list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, x: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda r, i: xor(r >> 1, 3988292384 * (r & 1)), xor(c, x)), 4294967295::BIGINT) AS crc FROM f),
 l AS (SELECT row, doc_id, coalesce('1' || lang, '0') AS k, sha256(a || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') || z) AS leaf,
  CASE WHEN coalesce(crc, 0) % 7 = 0 AND n_chars IS NOT NULL THEN sha256(a || length((n_chars::HUGEINT + 1)::VARCHAR) || ':' || (n_chars::HUGEINT + 1) || z) END AS now FROM c),
 p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l),
 t AS (SELECT k, 0 AS level, i, leaf AS d, count(*) OVER (PARTITION BY k) AS n FROM p
  UNION ALL SELECT k, level + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), any_value(n + 1) // 2 FROM t WHERE n > 1 GROUP BY k, level, i // 2),
 s AS (SELECT k, d AS subroot, row_number() OVER (ORDER BY k) - 1 AS i FROM t WHERE n = 1),
 u AS (SELECT 0 AS level, i, subroot AS d, count(*) OVER () AS n FROM s
  UNION ALL SELECT level + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), any_value(n + 1) // 2 FROM u WHERE n > 1 GROUP BY level, i // 2),
 v AS (SELECT row, k, 0 AS level, i, (SELECT max(level) FROM t WHERE t.k = p.k) AS h, coalesce(now, leaf) AS d, '' AS proof FROM p
  UNION ALL SELECT row, v.k, v.level + 1, v.i // 2, h, CASE WHEN v.i % 2 = 0 THEN sha256(v.d || coalesce(o.d, '')) ELSE sha256(o.d || v.d) END, proof || coalesce(o.d, '') FROM v LEFT JOIN t o ON o.k = v.k AND o.level = v.level AND o.i = xor(v.i, 1) WHERE v.level < h),
 w AS (SELECT row, 0 AS level, s.i, (SELECT max(level) FROM u) AS h, v.d, proof FROM v JOIN s USING (k) WHERE v.level = v.h
  UNION ALL SELECT row, w.level + 1, w.i // 2, h, CASE WHEN w.i % 2 = 0 THEN sha256(w.d || coalesce(o.d, '')) ELSE sha256(o.d || w.d) END, proof || coalesce(o.d, '') FROM w LEFT JOIN u o ON o.level = w.level AND o.i = xor(w.i, 1) WHERE w.level < h)
 SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, w.d AS folded_root, w.d = root AS verified FROM w JOIN p USING (row) JOIN s ON s.k = p.k, (SELECT d AS root FROM u WHERE n = 1) r WHERE w.level = w.h"""


def oracle_sql() -> dict[str, str]:
    """The operators that are SQL; tests hold the others against brute force, exact round trips or held-out accuracy."""
    return {"op8_decontamination": OP8_SQL, "op12_merkle_manifest": OP12_SQL}
