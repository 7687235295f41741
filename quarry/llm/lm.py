"""Language-model scoring by deleted interpolation of bigrams.

    P(w | h) = a(b) c(h, w) / c(h) + b(b) c(w) / N + g(b) / (V + 1),   b: the frequency bucket of the context h

Counts are over the learned documents. The weights of each bucket come from expectation-maximisation: a tenth of the
learned documents (remainder 1) is deleted from the counts, and the weights maximise the probability of its tokens
under the counts of the rest. After that all learned documents count.

How it runs: texts are cut into words once and written as blocks, a row of some MB each with its distinct words and
the words' indices. Each block sends its distinct n-grams' 64-bit keys and counts, sorted and squeezed, to the
bucket of keys that owns them; a bucket adds up and answers each block in the order in which it asked. So a key
passes once for each block that holds it, however often it occurs, and no task's memory grows with a key's frequency.
A block asks 2^``SPLIT`` buckets at most. Where that leaves buckets too large, their keys are combined over groups of
``TOGETHER`` askers, each group asks finer buckets in the blocks' stead, and the answers return the same way: rows stay
in proportion to the input, and a common key reaches its bucket once for each group.

A null text is empty: one end token. A null doc_id counts as the empty id. Repeated rows count and score each.
Keys are 64-bit hashes of words and word pairs; two that clash share a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._shared import lean, mixed, remainder, removed, split_words, spread, squeeze, task, text_bytes, written

#: Bytes of text of a block, but for one longer text, and tokens for each bucket of keys.
BLOCK_BYTES = 8 << 20
BUCKET_TOKENS = 2_000_000
#: Bits by which keys are dealt at a time, and askers that are combined where more bits are needed.
SPLIT, TOGETHER = 12, 1000
#: Most frequency buckets of contexts: floor(log2(count)) + 1, 0 for contexts never seen.
CONTEXTS = 40
#: Steps in an octave to which the ratios of two estimates are rounded when EM's tokens are gathered.
STEPS = 4
_END, _START = xxhash.xxh64_intdigest(b"end", 1), xxhash.xxh64_intdigest(b"start", 1)
_BLOCKS = "block string, deleted boolean, learned bigint, learned_docs bigint, tokens bigint, doc_ids binary, nulls binary, held binary, lengths binary, words binary, word_lengths binary, indices binary"
_KEYS = "level int, bucket int, block string, deleted boolean, keys binary, kept binary, gone binary"
_ANSWERS = "level int, bucket int, block string, kept binary, both binary, distinct bigint"
SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def blocks(documents: DataFrame, modulus: int = 10) -> DataFrame:
    """The texts as blocks of word indices (0: end), the deleted documents in blocks of their own; written."""
    rows = lean(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "text", remainder(F.col("doc_id"), modulus).alias("r"))

    def block(parts: list[tuple], deleted: bool) -> dict:
        raw = np.concatenate([x[0] for x in parts])
        sizes = np.concatenate([np.diff(x[1]) for x in parts])
        words, at = split_words(raw, np.concatenate([[0], np.cumsum(sizes)]))
        lengths = np.diff(at) + 1
        indices = np.insert(np.asarray(words.indices) + 1, at[1:], 0).astype(np.int32)
        ids = pa.concat_arrays([x[2] for x in parts])
        held = np.concatenate([x[3] for x in parts]) == 0
        data, word_at = text_bytes(words.dictionary)
        name = xxhash.xxh128_hexdigest(raw.tobytes() + np.asarray(ids.fill_null(-1)).tobytes() + lengths.tobytes())
        return {
            "block": name, "deleted": deleted, "learned": int(lengths[~held].sum()), "learned_docs": int((~held).sum()), "tokens": len(indices),
            "doc_ids": squeeze(np.asarray(ids.fill_null(0)).astype(np.int64)), "nulls": squeeze(np.asarray(ids.is_null()).astype(np.uint8)), "held": squeeze(held.astype(np.uint8)),
            "lengths": squeeze(lengths.astype(np.int64)), "words": squeeze(data), "word_lengths": squeeze(np.diff(word_at).astype(np.int64)), "indices": squeeze(indices),
        }

    @task("lm")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[tuple]] = {False: [], True: []}
        size = {False: 0, True: 0}
        schema = None

        def flush(kind: bool) -> pa.RecordBatch:
            row = block(held[kind], kind)
            held[kind], size[kind] = [], 0
            return pa.RecordBatch.from_pylist([row], schema)

        schema = pa.schema([(n, {"string": pa.string(), "boolean": pa.bool_(), "bigint": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in _BLOCKS.split(", "))])
        for batch in batches:
            left = np.asarray(batch.column("r"))
            for kind in (False, True):
                part = batch.filter(pa.array((left == 1) == kind))
                raw, at = text_bytes(part.column("text"))
                low = 0
                while low < part.num_rows:
                    room = BLOCK_BYTES - size[kind]
                    high = max(low + 1, int(np.searchsorted(at, at[low] + room, side="right")) - 1)
                    bit = part.slice(low, high - low)
                    held[kind].append((raw[at[low] : at[high]].copy(), at[low : high + 1] - at[low], bit.column("doc_id"), np.asarray(bit.column("r"))))
                    size[kind] += int(at[high] - at[low])
                    low = high
                    if low < part.num_rows or size[kind] >= BLOCK_BYTES:
                        yield flush(kind)
        for kind in (False, True):
            if held[kind]:
                yield flush(kind)

    return written(rows.mapInArrow(run, _BLOCKS))


class _Block:
    """The n-grams of a block: sorted keys of each level, and each token's place among them."""

    def __init__(self, row: dict):
        self.block, self.deleted = row["block"], bool(row["deleted"])
        self.lengths = spread(row["lengths"], np.int64)
        self.held = spread(row["held"]).astype(bool)
        self.row = row
        data, at = spread(row["words"]).tobytes(), np.concatenate([[0], np.cumsum(spread(row["word_lengths"], np.int64))]).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([_END, *(digest(data[a:b]) for a, b in zip(at, at[1:], strict=False)), _START], dtype=np.uint64)
        self.tokens = spread(row["indices"], np.int32)
        self.first = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.before = np.empty_like(self.tokens)
        self.before[1:] = self.tokens[:-1]
        self.before[self.first] = len(hashes) - 1
        ones = mixed(hashes[:-1])
        self.order = np.argsort(ones)
        self.place = np.empty(len(ones), np.int64)
        self.place[self.order] = np.arange(len(ones))
        code = self.before.astype(np.int64) * len(hashes) + self.tokens
        pairs, self.pair = np.unique(code, return_inverse=True)
        twos = mixed(mixed(hashes[pairs // len(hashes)]) + np.uint64(0x9E3779B97F4A7C15) * hashes[pairs % len(hashes)])
        self.pair_order = np.argsort(twos)
        self.pair_place = np.empty(len(twos), np.int64)
        self.pair_place[self.pair_order] = np.arange(len(twos))
        self.keys = {1: ones[self.order], 2: twos[self.pair_order]}

    def counts(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For each level's keys their counts in learned documents that are kept and in deleted ones."""
        use = np.repeat(~self.held, self.lengths)
        out = {}
        for level, at, order in ((1, self.tokens, self.order), (2, self.pair, self.pair_order)):
            n = np.bincount(at[use], minlength=len(order))[order]
            out[level] = (np.zeros_like(n), n) if self.deleted else (n, np.zeros_like(n))
        return out


def _bucket_edges(keys: np.ndarray, bits: int, of: int = 0, done: int = 0) -> np.ndarray:
    """Where sorted keys, alike in their first ``done`` bits (``of``), part by the next ``bits`` bits."""
    marks = (np.uint64(of << bits) + np.arange(1, 1 << bits, dtype=np.uint64)) << np.uint64(64 - done - bits) if bits else np.zeros(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, marks), [len(keys)]])


def asked(table: DataFrame, bits: int) -> DataFrame:
    """Each block's keys and counts, cut by their first ``bits`` bits into buckets."""

    @task("lm")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                block = _Block(row)
                for level, (kept, gone) in block.counts().items():
                    keys = block.keys[level]
                    edges = _bucket_edges(keys, bits)
                    out = []
                    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                        if a < b:
                            out.append((level, k, block.block, block.deleted, squeeze(np.diff(keys[a:b], prepend=np.uint64(0))), squeeze(kept[a:b].astype(np.int64)), squeeze(gone[a:b].astype(np.int64))))
                    yield pd.DataFrame(out, columns=[x.split()[0] for x in _KEYS.split(", ")])

    return table.mapInPandas(run, _KEYS)


def answered(keys: DataFrame) -> DataFrame:
    """For each block and bucket the counts over all blocks, in the order of the block's keys; written.

    A row without a block tells how many distinct keys of its bucket were learned.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        lists = [np.cumsum(spread(x, np.uint64)) for x in group["keys"]]
        distinct, place = np.unique(np.concatenate(lists), return_inverse=True)
        kept = np.bincount(place, np.concatenate([spread(x, np.int64) for x in group["kept"]]), len(distinct)).astype(np.int64)
        both = kept + np.bincount(place, np.concatenate([spread(x, np.int64) for x in group["gone"]]), len(distinct)).astype(np.int64)
        level, bucket, low, out = int(group["level"].iloc[0]), int(group["bucket"].iloc[0]), 0, []
        for name, deleted, one in zip(group["block"], group["deleted"], lists, strict=True):
            at = place[low : low + len(one)]
            low += len(one)
            out.append((level, bucket, name, squeeze(kept[at]) if deleted else None, squeeze(both[at]), None))
        out.append((level, bucket, None, None, None, int((both > 0).sum())))
        return pd.DataFrame(out, columns=[x.split()[0] for x in _ANSWERS.split(", ")])

    return written(keys.groupBy("level", "bucket").applyInPandas(run, _ANSWERS))


def settled(keys: DataFrame, askers: int, bits: int, done: int) -> DataFrame:
    """``answered``, by buckets of ``bits`` bits, for keys that are dealt by their first ``done`` bits."""
    if done >= bits:
        return answered(keys)
    more = min(SPLIT, bits - done)
    group = F.pmod(F.xxhash64("block"), F.lit(-(-askers // TOGETHER)))
    keys = keys.withColumn("asker", F.concat_ws(".", "level", "bucket", "deleted", group))
    names = [x.split()[0] for x in _KEYS.split(", ")]

    def combine(own: pd.DataFrame) -> pd.DataFrame:
        distinct, place = np.unique(np.concatenate([np.cumsum(spread(x, np.uint64)) for x in own["keys"]]), return_inverse=True)
        kept, gone = (np.bincount(place, np.concatenate([spread(x, np.int64) for x in own[c]]), len(distinct)).astype(np.int64) for c in ("kept", "gone"))
        level, bucket, deleted, asker = (own[c].iloc[0] for c in ("level", "bucket", "deleted", "asker"))
        edges, out = _bucket_edges(distinct, more, int(bucket), done), []
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            if a < b:
                out.append((level, (int(bucket) << more) + k, asker, deleted, squeeze(np.diff(distinct[a:b], prepend=np.uint64(0))), squeeze(kept[a:b]), squeeze(gone[a:b])))
        return pd.DataFrame(out, columns=names)

    def share(_: tuple, own: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        lists = [np.cumsum(spread(x, np.uint64)) for x in own["keys"]]
        place = np.unique(np.concatenate([*lists, np.zeros(0, np.uint64)]), return_inverse=True)[1]
        got = got.drop_duplicates("bucket").sort_values("bucket")
        kept, both = (np.concatenate([spread(x, np.int64) for x in got[c].dropna()] or [np.zeros(0, np.int64)]) for c in ("kept", "both"))
        low, out = 0, []
        for name, level, bucket, deleted, one in zip(own["block"], own["level"], own["bucket"], own["deleted"], lists, strict=True):
            at = place[low : low + len(one)]
            low += len(one)
            out.append((level, bucket, name, squeeze(kept[at]) if deleted else None, squeeze(both[at]), None))
        return pd.DataFrame(out, columns=[x.split()[0] for x in _ANSWERS.split(", ")])

    keys = written(keys)
    finer = keys.groupBy("asker").applyInPandas(combine, _KEYS)
    got = settled(finer, -(-askers // TOGETHER), bits, done + more)
    back = keys.groupBy("asker").cogroup(got.where("block is not null").withColumnRenamed("block", "asker").groupBy("asker")).applyInPandas(share, _ANSWERS)
    out = written(back.unionByName(got.where("block is null")))
    removed(keys)
    removed(got)
    return out


def _gathered(answers: pd.DataFrame, block: _Block, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the block's words (by index) and of its word pairs (by number)."""
    out = {}
    for level in (1, 2):
        mine = answers[answers["level"] == level].sort_values("bucket")
        out[level] = np.concatenate([spread(x, np.int64) for x in mine[column]]) if len(mine) else np.zeros(0, np.int64)
        if len(out[level]) != len(block.keys[level]):
            raise RuntimeError("a block lacks answers")
    return out[1][block.place], out[2][block.pair_place]


def _estimates(block: _Block, ones: np.ndarray, twos: np.ndarray, starts: int, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token its context's bucket and its two maximum-likelihood estimates."""
    context = np.append(ones, starts)[block.before]
    two = np.divide(twos[block.pair], context, out=np.zeros(len(context)), where=context > 0)
    bucket = np.where(context > 0, np.minimum(np.frexp(np.maximum(context, 1).astype(float))[1], CONTEXTS - 1), 0)
    return bucket, two, ones[block.tokens] / max(1, total)


def _weights(seen: list[tuple[int, int | None, int | None, int]], rounds: int = 100) -> np.ndarray:
    """Expectation-maximisation for each bucket, started and steadied by the weights of all buckets together."""
    data = np.array([(b, -1e9 if x is None else x / STEPS, -1e9 if y is None else y / STEPS, n) for b, x, y, n in seen], dtype=float).reshape(-1, 4)

    def fit(rows: np.ndarray, prior: np.ndarray, weight: float) -> np.ndarray:
        ratio = np.column_stack([np.exp2(rows[:, 1]), np.exp2(rows[:, 2]), np.ones(len(rows))])
        w = prior
        for _ in range(rounds):
            part = ratio * w
            part *= (rows[:, 3] / part.sum(axis=1))[:, None]
            w = part.sum(axis=0) + weight * prior
            w = np.maximum(w / w.sum(), 1e-6)
            w /= w.sum()
        return w

    whole = fit(data, np.full(3, 1 / 3), 1.0)
    return np.array([fit(data[data[:, 0] == b], whole, 20.0) for b in range(CONTEXTS)])


def scored(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of ``documents``."""
    table = blocks(documents)
    told = table.groupBy("deleted").agg(F.sum("learned"), F.sum("learned_docs"), F.sum("tokens"), F.count("*")).collect()
    learned, starts, tokens, n_blocks = {}, {}, 0, 0
    for deleted, a, b, c, d in told:
        learned[deleted], starts[deleted], tokens, n_blocks = a, b, tokens + c, n_blocks + d
    kept_total, kept_starts, total, all_starts = learned.get(False, 0), starts.get(False, 0), sum(learned.values()), sum(starts.values())
    bits = max(3, int(np.ceil(np.log2(max(1, tokens) / BUCKET_TOKENS))))
    answers = settled(asked(table, min(bits, SPLIT)), n_blocks, bits, min(bits, SPLIT))
    distinct = answers.where("block is null and level = 1").agg(F.sum("distinct")).first()[0] or 0

    def events(_: tuple, own: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        columns = ["bucket", "two", "one", "n"]
        if own.empty:
            return pd.DataFrame(columns=columns)
        frames = []
        for row in own.iloc[:1].to_dict("records"):
            block = _Block(row)
            ones, twos = _gathered(got.drop_duplicates(["level", "bucket"]), block, "kept")
            use = np.repeat(~block.held, block.lengths)
            bucket, two, one = (x[use] for x in _estimates(block, ones, twos, kept_starts, kept_total))
            step = lambda p: np.where(p > 0, np.round(STEPS * np.log2(np.maximum(p, 1e-300) * (distinct + 1))), -(1 << 30)).astype(np.int64)
            frame = pd.DataFrame({"bucket": bucket, "two": step(two), "one": step(one)}).groupby(["bucket", "two", "one"]).size().reset_index(name="n")
            frames.append(frame.assign(n=frame["n"] * len(own)))
        return pd.concat(frames)

    named = answers.where("block is not null")
    gone = table.where("deleted").groupBy("block").cogroup(named.where("kept is not null").groupBy("block"))
    # at most CONTEXTS x (64 STEPS)^2 rows, in practice some thousand
    seen = gone.applyInPandas(events, "bucket bigint, two bigint, one bigint, n bigint").groupBy("bucket", "two", "one").agg(F.sum("n").alias("n")).collect()
    weights = _weights([(b, None if x <= -(1 << 30) else x, None if y <= -(1 << 30) else y, n) for b, x, y, n in seen])
    floor, vocabulary = 1 / (distinct + 1), distinct

    def scores(_: tuple, own: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        names = [x.split()[0] for x in SCORES.split(", ")]
        if own.empty:
            return pd.DataFrame(columns=names)
        block = _Block(own.iloc[0].to_dict())
        ones, twos = _gathered(got.drop_duplicates(["level", "bucket"]), block, "both")
        bucket, two, one = _estimates(block, ones, twos, all_starts, total)
        w = weights[bucket]
        logs = np.log10(w[:, 0] * two + w[:, 1] * one + w[:, 2] * floor)
        count = ones[block.tokens]
        base = np.log10((count + 0.1) / (total + 0.1 * (vocabulary + 1)))
        frame = pd.DataFrame({
            "doc_id": pd.array(spread(block.row["doc_ids"], np.int64), "Int64"), "held_out": block.held, "n_tokens": block.lengths, "n_known": np.add.reduceat(count > 0, block.first, dtype=np.int64),
            "train_tokens": total, "base_score": np.add.reduceat(base, block.first), "score": np.add.reduceat(logs, block.first),
        })
        frame.loc[spread(block.row["nulls"]).astype(bool), "doc_id"] = pd.NA
        return pd.concat([frame] * len(own))

    return table.groupBy("block").cogroup(named.select("level", "bucket", "block", "both").groupBy("block")).applyInPandas(scores, SCORES)
