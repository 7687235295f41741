"""Near-duplicate removal at a similarity: the trie self-join of SimHash fingerprints, verified by Jaccard.

Words as in ``simhash``; a text's set holds the 64-bit hashes of its shingles of ``WIDTH`` = 5 words (one to four words:
the whole sequence; no word or null: the empty set). Texts link whose sets are equal or have a Jaccard similarity of
4/5 at least; of each component of linked texts one row stays, the least by doc_id (null last), then by text hash.

A set's fingerprint is the majority of its shingles' bits. Sets as similar as that differ in 10 of 64 bits on average
and in 12 at the worst size (4 and 5 shingles), so the budget of ``BUDGET`` = 22 bits loses about one such pair in
10^5 (in 2,000 at the worst size), and of more similar ones fewer; of unlike pairs one in a hundred is within it.

A budget so wide leaves no block of the fingerprints exact, so tries are made below shingles instead: shingles have one
order, common ones (counted in a sample; that bears on speed alone) last. Two sets as similar as that share a shingle
within the first ``n - ceil(4n/5) + 1`` of each, and at the first one that they share what follows must suffice for the
overlap. Each shingle's fingerprints are first compared with its hub, the set in which it comes earliest; then the
shingle's trie is joined with itself, for pairs that this left in different components. Every pair found is verified on
the whole sets; neither equal sets nor balls of near copies become all their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import simhash
from quarry.llm._shared import lean, mixed, removed, slices, split_words, task, text_bytes, written
from quarry.llm.components import components, one_of_each

WIDTH, SEED, BUDGET = 5, 42, 22
#: Texts that common shingles are counted in, in how many of them one is common, and how many are broadcast at most.
SAMPLE, COMMON, KNOWN = 20_000, 5, 200_000
#: Posts of one shingle that are joined in one trie at most.
CELL = 20_000


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles."""
    words, at = split_words(*text_bytes(texts))
    known = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in words.dictionary.to_pylist()), np.uint64, len(words.dictionary))
    w = known[words.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)
    h = mixed(w)
    for k in range(1, WIDTH):
        h = mixed(h[: max(0, len(w) - k)] + w[k:])
    out = []
    for low, high in zip(at[:-1], at[1:], strict=True):
        if high - low >= WIDTH:
            out.append(np.unique(h[low : high - WIDTH + 1]))
        else:
            out.append(np.array([xxhash.xxh64_intdigest(w[low:high].tobytes(), SEED)] if high > low else [], dtype=np.uint64))
    return out


def _sampled(documents: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles of a sample of the texts, sorted, and their counts."""
    share = min(1.0, SAMPLE / max(1, documents.count()))
    rows = documents.select("text", F.xxhash64("text", F.lit(SEED)).alias("th")).where(F.pmod("th", F.lit(1 << 20)) < int(share * (1 << 20)))

    @task("neardup")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = shingle_sets(batch.column("text"))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64))], names=["key"])

    counted = lean(rows.dropDuplicates(["th"]).select("text")).mapInArrow(run, "key bigint").groupBy("key").count()
    top = counted.where(F.col("count") >= COMMON).orderBy(F.desc("count"), "key").limit(KNOWN).toPandas()
    keys, counts = top["key"].to_numpy(np.int64).view(np.uint64), top["count"].to_numpy(np.int64)
    order = np.argsort(keys)
    return keys[order], counts[order]


def _prefixes(documents: DataFrame) -> DataFrame:
    """doc_id, th (the text's hash), digest (the set's), fp (its fingerprint), n (its size) and its first shingles, of each row."""
    told = documents.sparkSession.sparkContext.broadcast(_sampled(documents))

    @task("neardup")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = told.value
        for whole in batches:
            for batch in slices(whole, "text"):
                digests, sizes, prints, firsts = [], [], [], []
                for u in shingle_sets(batch.column("text")):
                    digests.append(xxhash.xxh64_intdigest(u.tobytes(), SEED))
                    sizes.append(len(u))
                    prints.append(simhash.fingerprint(u))
                    seen = np.zeros(len(u), np.int64)
                    if len(keys) and len(u):
                        place = np.minimum(np.searchsorted(keys, u), len(keys) - 1)
                        seen = np.where(keys[place] == u, counts[place], 0)
                    firsts.append(u[np.lexsort((u, seen))][: len(u) // 5 + 1].view(np.int64))  # n - ceil(4n/5) + 1
                at = np.concatenate([[0], np.cumsum([len(x) for x in firsts])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*firsts, np.zeros(0, np.int64)])))
                fixed = [*(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (digests, prints)), pa.array(sizes, pa.int32()), lists]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), *fixed], names=["doc_id", "th", "digest", "fp", "n", "firsts"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = lean(documents.select("doc_id", F.xxhash64("text").alias("th"), "text"))
    return rows.mapInArrow(run, f"doc_id {kind}, th bigint, digest bigint, fp bigint, n int, firsts array<bigint>")


def _may(n: Column, i: Column, m: Column, j: Column) -> Column:
    """Whether sets of ``n`` and ``m`` shingles whose first common ones are at ``i`` and ``j`` can be similar enough."""
    return 9 * F.least(n - i, m - j) >= 4 * (n + m)


def _verified(pairs: DataFrame, named: DataFrame, documents: DataFrame) -> DataFrame:
    """The pairs (a, b) of digests whose sets have a Jaccard similarity of 4/5 at least."""
    pairs = written(pairs.distinct())
    wanted = named.join(pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct(), "digest")
    texts = documents.select(F.xxhash64("text").alias("th"), "text").join(wanted, "th").dropDuplicates(["digest"])
    texts = written(texts.select("digest", "text"))
    left, right = texts.toDF("a", "left"), texts.toDF("b", "right")

    @task("neardup")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "left"):
                both = zip(shingle_sets(batch.column("left")), shingle_sets(batch.column("right")), strict=True)
                common = [(len(np.intersect1d(x, y, assume_unique=True)), len(x) + len(y)) for x, y in both]
                yield batch.select(["a", "b"]).filter(pa.array([9 * c >= 4 * s for c, s in common], pa.bool_()))

    out = written(lean(pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right"), 200).mapInArrow(run, "a bigint, b bigint"))
    removed(pairs)
    removed(texts)
    return out


def _crossed(posts: DataFrame) -> DataFrame:
    """a bigint, b bigint: pairs of different root that a trie self-join finds among the posts of each shingle.

    A shingle's posts are one trie of fingerprints. A crowd of them is dealt into ``crowd`` parts of ``CELL`` posts, and
    a trie is made for each two parts, so no task holds a crowd; a pair is told where its two parts meet. Sets that also
    met at the shingle ``before`` this one, the same for both, were told there: a run of common shingles tells a pair once.
    """
    crowd = F.ceil(F.col("held") / CELL).cast("int")
    part = F.pmod(F.xxhash64("digest", "key"), crowd).cast("int")
    cells = F.transform(F.sequence(F.lit(0), crowd - 1), lambda x: F.struct(F.least(x, part).alias("x"), F.greatest(x, part).alias("y")))
    few = posts.where(F.col("held") <= CELL).withColumns({"part": F.lit(0), "cell": F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"))})
    many = posts.where(F.col("held") > CELL).select("*", part.alias("part"), F.explode(cells).alias("cell"))
    dealt = few.unionByName(many).select("key", F.col("cell.x").alias("x"), F.col("cell.y").alias("y"), "part", "fp", "digest", "n", "pos", "root", "before")
    tasks = int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(tasks, "key", "x", "y").sortWithinPartitions("key", "x", "y")

    @task("neardup")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in simhash.in_groups(batches, ["key", "x", "y"], CELL):
            key, x, y, part, fp, digest, n, pos, root, before = (c.to_numpy() for c in batch.columns)
            order = np.lexsort((fp.view(np.uint64), y, x, key))
            key, x, y, part, fp, digest, n, pos, root, before = (c[order] for c in (key, x, y, part, fp, digest, n, pos, root, before))
            new = (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            starts = np.flatnonzero(np.concatenate([[True], new]))
            labels = np.unique(root, return_inverse=True)[1]
            for i, j in simhash.pairs_within(fp.view(np.uint64), starts, 0, BUDGET, labels):
                may = 9 * np.minimum(n[i] - pos[i], n[j] - pos[j]) >= 4 * (n[i] + n[j])
                i, j = i[may], j[may]
                met = ((x[i] == y[i]) | (part[i] != part[j])) & (before[i] != before[j])
                i, j = digest[i[met]], digest[j[met]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j))], names=["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint")


def grouped(documents: DataFrame) -> DataFrame:
    """doc_id, th and root (one value for each component) of each row of ``documents``."""
    rows = written(_prefixes(documents))
    sets = rows.groupBy("digest").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("firsts").alias("firsts"))
    named = rows.groupBy("digest").agg(F.min("th").alias("th"))
    posts = sets.select("digest", "n", "fp", F.posexplode("firsts").alias("pos", "key")).repartition("key")
    hubs = posts.groupBy("key").agg(F.min(F.struct("pos", "digest", "n", "fp")).alias("hub"), F.count("*").alias("held")).where("held > 1")
    shared = written(posts.join(hubs, "key").select("key", "digest", "n", "fp", "pos", "hub", "held"))
    near = _may(F.col("n"), F.col("pos"), F.col("hub.n"), F.col("hub.pos")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("hub.fp"))) <= BUDGET)
    stars = shared.where((F.col("digest") != F.col("hub.digest")) & near)
    links = _verified(stars.select(F.least("digest", "hub.digest").alias("a"), F.greatest("digest", "hub.digest").alias("b")), named, documents)
    labels = components(links).withColumnRenamed("node", "digest")
    before = F.lag("key").over(Window.partitionBy("digest").orderBy("pos"))
    told = shared.drop("hub").withColumn("before", F.coalesce(before, "digest")).join(labels, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    more = _verified(_crossed(told), named, documents)
    whole = components(links.union(more)).withColumnRenamed("node", "digest")
    return rows.select("doc_id", "th", "digest").join(whole, "digest", "left").select("doc_id", "th", F.coalesce("root", "digest").alias("root"))


def deduplicated(documents: DataFrame) -> DataFrame:
    """``documents`` with one row of each component, the least. Equal ids with different texts are different rows; of
    rows that agree in id and text any one stays."""
    return one_of_each(documents, grouped(documents))
