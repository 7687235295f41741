"""The pipeline's stages against plain checks of what each keeps."""

import corpus_pipeline

from quarry.llm import decontam, langid, toxicity
from test_neardup import brute

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        ids, kept = {x[0] for x in docs.select("doc_id").collect()}, {x[0] for x in out.select("doc_id").collect()}
        assert kept <= ids and out.count() == len(kept)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        if name == "toxicity":
            scored = toxicity.scored(docs, toxicity.learned(docs, labels))
            assert kept == {x[0] for x in scored.where("predicted = 0").select("doc_id").collect()}
        elif name == "language_id":
            told = langid.identify(docs, langid.learned(docs))
            assert kept == {x["doc_id"] for x in told.collect() if x["lang_pred"] != "und" and x["score"] >= langid.DOUBT}
        elif name == "simhash_near_dedup":
            rows = sorted((x["doc_id"], x["text"]) for x in docs.select("doc_id", "text").collect())
            assert kept == {rows[k][0] for k in set(brute(rows))}
        elif name == "benchmark_decontamination":
            bad = decontam.contaminated(docs, spark.read.parquet(f"{DATA}/benchmark.parquet"))
            assert kept == ids - {x["doc_id"] for x in bad.collect()}
        else:
            assert kept == ids and out.where("not round_trip").count() == 0
        docs = out


def test_run_is_its_stages(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    """Nulls in any column, repeated rows, empty and very long texts, and columns that operators also make."""
    own = spark.read.parquet(f"{DATA}/documents.parquet")
    kinds = dict(own.dtypes)
    rows = spark.createDataFrame([(None, None, None, None, None), (7001, "", "en", None, 0), (7002, "the word and " * 60_000, "en", "s", 1), (7003, None, "de", "s", 0)], own.schema)
    docs = own.unionByName(own.limit(5)).unionByName(rows).selectExpr("*", "1 AS score", "'x' AS predicted", "2 AS fingerprint", "'y' AS root", "3 AS ids", "'z' AS lang_pred", "4 AS h")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "bpe_encoding":
            assert docs.columns == columns and {c: k for c, k in docs.dtypes if c in kinds} == kinds
        if name in ("simhash_near_dedup", "benchmark_decontamination"):
            assert docs.count() == docs.select("text").distinct().count()
    got = {x["doc_id"]: x for x in docs.collect()}
    assert 7002 in got and got[7002]["n_tokens"] >= 120_000 and all(x["round_trip"] for x in got.values())


def test_empty_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.count() == 0
