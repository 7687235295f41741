"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints: words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, their 3-word shingles with repeats, the
XXH64 (seed 42) of each; a bit is 1 if it is set in more than half. One or two words: the whole sequence is the
shingle. No word: fingerprint zero. A null text is empty.

Join: fingerprints within 3 bits agree on one of four 16-bit blocks. Each distinct fingerprint goes to four tries, in
each with another block first; below a trie's node for a value of that block, pairs of nodes are walked together, the
differing bits of their paths add up, and a pair is dropped once they exceed the budget. Copies of a fingerprint meet
before that in one row, and within a task links are merged at once into components, so neither ever become pairs.

Fingerprints that differ link documents into components; component_id is the least doc_id of all that are reachable
(null if all their ids are null). Repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm._shared import lean, slices, task, written
from quarry.llm.components import components, one_of_each

BITS, BUDGET, BLOCK, WIDTH, SEED = 64, 3, 16, 3, 42
#: Pairs of nodes that are walked at a time, and the largest product of sizes at which two nodes are compared outright.
FRONT, OUTRIGHT = 200_000, 16
#: Codes of whole tries that a task takes at a time, about.
TOGETHER = 100_000


def _hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode().lower().split()
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) < WIDTH:
        return np.array([digest(join(words), SEED)] if words else [], dtype=np.uint64)
    shingles = map(join, zip(words, words[1:], words[2:], strict=False))
    return np.fromiter((digest(x, SEED) for x in shingles), np.uint64, len(words) - WIDTH + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """The majority bits of 64-bit hashes, unsigned; a tie gives 0."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, dtype=np.int64)
    for low in range(0, len(hashes), 1 << 15):
        part = np.ascontiguousarray(hashes[low : low + (1 << 15)], dtype=">u8")
        ones += np.unpackbits(part.view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """``df`` with the column ``into`` bigint, the fingerprint's bits as a signed number. A clashing column is replaced."""
    df = lean(df.drop(into))

    @task("simhash")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                prints = np.array([fingerprint(_hashes(x)) for x in batch.column(text).to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints.view(np.int64))], names=[*batch.schema.names, into])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(into, T.LongType())]))


def _merged(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the least member known of its component) after linking ``a`` with ``b``."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        a, b = a[apart], b[apart]
        low, high = np.minimum(x[apart], y[apart]), np.maximum(x[apart], y[apart])
        np.minimum.at(labels, high, low)
        while not np.array_equal(up := labels[labels], labels):
            labels = up


def _split(codes: np.ndarray, low: np.ndarray, high: np.ndarray, step: np.uint64) -> np.ndarray:
    """Where in each node ``low`` to ``high`` the codes with bit ``step`` set begin."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        middle = (low + high) // 2
        one = open_ & ((codes[np.minimum(middle, len(codes) - 1)] >> step) & np.uint64(1)).astype(bool)
        low, high = np.where(open_ & ~one, middle + 1, low), np.where(one, middle, high)
    return low


def pairs_within(codes: np.ndarray, starts: np.ndarray, exact: int, budget: int, labels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (as two index arrays) of codes in one trie that differ in at most ``budget`` bits, but for those that
    ``labels``, which the caller may merge meanwhile, call one already.

    A trie's codes are a run of ``codes`` from one of ``starts`` on, sorted, alike in their first ``exact`` bits; nodes
    are runs of them. Pairs of nodes are walked together, and dropped once the differing bits of their paths are too
    many, or all their codes have one label.
    """
    n = len(codes)
    ends = np.append(starts[1:], n)
    many = ends - starts > 1
    begun = np.column_stack([starts[many], ends[many], starts[many], ends[many], np.zeros(many.sum(), np.int64)])
    stack = [(exact, begun[k : k + FRONT]) for k in range(0, len(begun), FRONT)]
    seams = np.zeros(n, dtype=np.int64)
    stale = True
    while stack:
        depth, pairs = stack.pop()
        if stale:
            seams = np.concatenate([[0], np.cumsum(labels[1:] != labels[:-1])])
            stale = False
        a, ae, b, be, errors = pairs.T
        joined = (seams[a] == seams[ae - 1]) & (seams[b] == seams[be - 1]) & (labels[a] == labels[b])
        pairs = pairs[~joined]
        a, ae, b, be, errors = pairs.T
        small = ((ae - a) * (be - b) <= OUTRIGHT) | (depth == BITS)
        if small.any():
            s, se, t, te = a[small], ae[small], b[small], be[small]
            sizes = (se - s) * (te - t)
            at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            across = np.repeat(te - t, sizes)
            left, right = np.repeat(s, sizes) + at // across, np.repeat(t, sizes) + at % across
            # of a node with itself each pair once
            near = np.where(np.repeat(s == t, sizes), left < right, left != right) & (labels[left] != labels[right])
            near &= np.bitwise_count(codes[left] ^ codes[right]) <= budget
            if near.any():
                yield left[near], right[near]
                stale = True
            pairs = pairs[~small]
            a, ae, b, be, errors = pairs.T
        if not len(pairs):
            continue
        step = np.uint64(BITS - 1 - depth)
        ac, bc = _split(codes, a, ae, step), _split(codes, b, be, step)
        self = a == b
        more = errors + 1
        found = np.concatenate([
            np.column_stack([a, ac, b, bc, errors]), np.column_stack([ac, ae, bc, be, errors]),
            np.column_stack([a, ac, bc, be, more]), np.column_stack([ac, ae, b, bc, more])[~self],
        ])
        found = found[(found[:, 0] < found[:, 1]) & (found[:, 2] < found[:, 3]) & (found[:, 4] <= budget)]
        found = found[~((found[:, 0] == found[:, 2]) & (found[:, 1] - found[:, 0] == 1))]
        stack += [(depth + 1, found[k : k + FRONT]) for k in range(0, len(found), FRONT)]


def walk(codes: np.ndarray, exact: int = BLOCK, budget: int = BUDGET) -> np.ndarray:
    """For sorted distinct 64-bit codes the least index of each one's component, where codes link that agree on the
    first ``exact`` bits and differ in at most ``budget`` others."""
    labels = np.arange(len(codes))
    if len(codes) > 1:
        top = codes >> np.uint64(BITS - exact) if exact else np.zeros(len(codes), np.uint64)
        starts = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]]))
        for left, right in pairs_within(codes, starts, exact, budget, labels):
            labels[:] = _merged(labels, left, right)
    return labels


def in_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``keys``, in batches of whole groups of about ``least`` rows (more, where a group is larger)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(x.num_rows for x in held) >= least:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            columns = [whole.column(k).to_numpy(zero_copy_only=False) for k in keys]
            same = np.logical_and.reduce([x == x[-1] for x in columns])
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield whole.slice(0, cut)
            held = [whole.slice(cut)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def links(prints: DataFrame) -> DataFrame:
    """a bigint, b bigint: links that connect the distinct fingerprints of ``prints`` into components (not every pair).

    A task sorts its tries' codes in Spark, which may spill, and holds those of some tries at a time.
    """
    turned = [F.expr(f"shiftleft(fingerprint, {BLOCK * k}) | shiftrightunsigned(fingerprint, {BITS - BLOCK * k})") if k else F.col("fingerprint") for k in range(BITS // BLOCK)]
    codes = prints.select(F.posexplode(F.array(*turned)).alias("turn", "code")).withColumn("block", F.shiftrightunsigned("code", BITS - BLOCK))
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    @task("simhash")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_groups(batches, ["turn", "block"], TOGETHER):
            turns = batch.column("turn").to_numpy()
            codes = batch.column("code").to_numpy().view(np.uint64)
            for turn in np.unique(turns):
                own = np.sort(codes[turns == turn])
                labels = walk(own)
                back = np.uint64(BLOCK * int(turn))
                plain = (own >> back) | (own << (np.uint64(BITS) - back)) if turn else own
                away = np.flatnonzero(labels != np.arange(len(own)))
                yield pa.RecordBatch.from_arrays([pa.array(plain[away].view(np.int64)), pa.array(plain[labels[away]].view(np.int64))], names=["a", "b"])

    dealt = codes.repartition(tasks, "turn", "block").sortWithinPartitions("turn", "block")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def _linked(documents: DataFrame) -> DataFrame:
    """doc_id, th (the text's hash), fingerprint, component_id and root (one fingerprint of the component) of each row."""
    rows = written(fingerprints(documents.select("doc_id", "text", F.xxhash64("text").alias("th"))).drop("text"))
    prints = written(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    near = components(links(prints.select("fingerprint")))
    member = near.union(near.select("root", "root").distinct())
    whole = prints.join(member.withColumnRenamed("node", "fingerprint"), "fingerprint")
    least = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = whole.join(least, "root").select("fingerprint", "component_id", "root")
    named = prints.join(moved, "fingerprint", "left").select("fingerprint", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("root", "fingerprint").alias("root"), "n")
    # a fingerprint of over a thousandth of all rows would crowd one task: these, a thousand at most, are broadcast
    hot = max(1000, (prints.agg(F.sum("n")).first()[0] or 0) // 1000)
    crowds = F.broadcast(named.where(F.col("n") > hot))
    return rows.join(crowds, "fingerprint").unionByName(rows.join(crowds, "fingerprint", "left_anti").join(named, "fingerprint"))


def grouped(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id of each row of ``documents``."""
    return _linked(documents).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(documents: DataFrame) -> DataFrame:
    """``documents`` with one row of each component, the least by doc_id (null last), then by text hash. Equal ids with
    different texts are different rows; of rows that agree in id and text any one stays."""
    return one_of_each(documents, _linked(documents).select("doc_id", "th", "root"))
