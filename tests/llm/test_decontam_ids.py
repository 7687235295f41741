"""Benchmark items with a null id, and items of few words."""

from quarry.llm import decontam


def test_items_without_an_id_are_found(spark):
    long, short = " ".join(f"w{k}" for k in range(20)), "a b c d e f"
    bench = spark.createDataFrame([(None, long), (None, short), (1, "one two"), (2, ""), (3, None)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, f"x {long} y"), (2, f"{short} z"), (3, "one two three")], "doc_id bigint, text string")
    for few in (decontam.BROADCAST, 0):
        got = decontam.contaminated(docs, bench, few).collect()
        assert sorted((x["doc_id"], x["item_id"], x["n_words"]) for x in got) == [(1, None, 20), (2, None, 6), (3, 1, 2)]
    assert decontam.clean(docs, bench).count() == 0
    assert [x["doc_id"] for x in decontam.clean(docs, bench.where("item_id is null")).collect()] == [3]


def test_short_items_must_be_whole(spark):
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(["lone", "two words", "three words here", "now four words here", "a b c d e"])], "item_id bigint, text string")
    texts = ["a lone word", "two other words", "Two, words!", "three words there", "so: three words here.", "now four words there", "now four words here", "a b x d e", "a x c x e"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for few in (decontam.BROADCAST, 0):
        got = {(x["doc_id"], x["item_id"]) for x in decontam.contaminated(docs, bench, few).collect()}
        assert got == {(0, 0), (2, 1), (4, 2), (6, 3), (7, 4)}
