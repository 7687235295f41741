"""Periodic runs of words: stretches that repeat one short sequence of words at least four times over.

Karp-Miller-Rosenberg naming gives each place of a document a number for its next 2^k words, equal numbers for equal words;
level k + 1 ranks pairs of level k's names. A name that its document holds once can't be met again and is dropped, so the
levels thin out and end at the longest repeat. A stretch with period q and at least 4 q words covers a multiple g of q with
the 2 q words from g equal to those from g + q: only these grid places are looked at, n / q for each q, by one comparison
of names; the first of each series is drawn out to both sides by descending levels of names. No hashes, no suffix sorting.

Texts never leave their partition. Null texts have no words; a null doc_id counts as the empty text; repeated rows are
told apart by nothing and each get their row; columns other than doc_id and text are not looked at. A text is taken whole,
whatever its length: a batch holds about 2 MB of texts or one longer text, and some 200 bytes a word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm._shared import lean, slices, split_words, task, text_bytes

#: A run has at least this many words, and this many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Grid places looked at together.
_BLOCK = 1 << 21


def _names(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Levels x words: the name of the 2^k words from each place, -1 where they leave the document or occur once in it."""
    n = len(ids)
    left = np.repeat(at[1:], np.diff(at)) - np.arange(n)  # words from here to the document's end
    doc = np.repeat(np.arange(len(at) - 1, dtype=np.int64), np.diff(at))
    levels: list[np.ndarray] = []
    places, pair = np.arange(n), doc * (int(ids.max(initial=0)) + 1) + ids
    while len(places):
        _, name, count = np.unique(pair, return_inverse=True, return_counts=True)
        again = count[name] > 1
        places, name = places[again], name[again]
        if not len(places):
            break
        level = np.full(n, -1, dtype=np.int32)
        level[places] = name
        levels.append(level)
        step = 1 << (len(levels) - 1)
        places = places[left[places] >= 2 * step]
        places = places[level[places + step] >= 0]
        pair = level[places].astype(np.int64) * len(count) + level[places + step]
    return np.array(levels, dtype=np.int32).reshape(len(levels), n)


def _ragged(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists of these sizes on end: the list of each element, and its place there."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _common(names: np.ndarray, low: np.ndarray, high: np.ndarray, i: np.ndarray, q: np.ndarray, way: int) -> np.ndarray:
    """How many words from i and i + q on are equal (``way`` 1), or before them (-1), within the bounds low and high."""
    total = np.zeros(len(i), dtype=np.int64)
    for k in range(len(names) - 1, -1, -1):
        size = 1 << k
        a = i + total if way > 0 else i - total - size
        fits = (a + q + size <= high) if way > 0 else (a >= low)
        a = np.where(fits, a, 0)
        b = np.where(fits, a + q, 0)
        total += np.where(fits & (names[k][a] >= 0) & (names[k][a] == names[k][b]), size, 0)
    return total


def runs(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows (document, start, length, period), ascending by document, start and period, of all runs.

    ``ids``: word numbers of documents on end; ``at``: the documents' n + 1 offsets.
    """
    names = _names(ids, at)
    found = [np.zeros((0, 4), dtype=np.int64)]
    if len(names):
        size = np.diff(at)
        some = [np.maximum.reduceat(np.append(x, -1), at[:-1]) >= 0 if len(at) > 1 else np.zeros(0, bool) for x in names]
        levels = np.sum([x & (size > 0) for x in some], axis=0)  # names' levels that a document has
        # 2 q words from g are those from g + q: a repeat of 2 q words, so 2 q < 2^levels
        most = np.minimum(size // LEAST_PERIODS, ((1 << levels) - 1) // 2)
        doc, q = _ragged(most)
        q = q + 1
        grid = size[doc] // q - 2  # g + 3 q <= n
        step = np.cumsum(grid)
        low = 0
        while low < len(doc):
            high = max(low + 1, int(np.searchsorted(step, (step[low - 1] if low else 0) + _BLOCK, side="right")))
            found.append(_runs_at(names, at, doc[low:high], q[low:high], grid[low:high]))
            low = high
    out = np.concatenate(found)
    # of one stretch's periods the smallest: it divides the others
    out = out[np.lexsort((out[:, 3], out[:, 2], out[:, 1], out[:, 0]))]
    first = np.ones(len(out), dtype=bool)
    first[1:] = (out[1:, :3] != out[:-1, :3]).any(axis=1)
    out = out[first]
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _runs_at(names: np.ndarray, at: np.ndarray, doc: np.ndarray, q: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Runs that the grid places of these documents and periods lie in."""
    owner, m = _ragged(grid)
    g = at[doc[owner]] + m * q[owner]
    level = np.log2(2 * q).astype(np.int64)[owner]  # exact: q is far below 2^50
    flat = names.ravel()
    n = names.shape[1]
    name = flat[level * n + g]
    hit = name >= 0
    hit[hit] = name[hit] == flat[(level * n + g + q[owner])[hit]]
    new = hit.copy()
    new[1:] &= ~(hit[:-1] & (owner[1:] == owner[:-1]))  # the place before already stands for this stretch
    g, owner = g[new], owner[new]
    d, period = doc[owner], q[owner]
    low, high = at[d], at[d + 1]
    before = _common(names, low, high, g, period, -1)
    length = before + period + _common(names, low, high, g, period, 1)
    long = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
    return np.stack([d, g - before - low, length, period], axis=1)[long]


def _greater(a: tuple, b: tuple) -> int:
    """Compares (start, length, period) by exact length / period, then the smaller start, then the smaller period."""
    left, right = a[1] * b[2], b[1] * a[2]
    return (left > right) - (left < right) or (b[0] > a[0]) - (b[0] < a[0]) or (b[2] > a[2]) - (b[2] < a[2])


def _worded(batch: pa.RecordBatch, rewrite: Callable | None) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, word numbers of all documents on end, and offsets; ``rewrite``: (doc_id, n) to the places to take."""
    words, at = split_words(*text_bytes(batch.column(1)), lower=False)
    ids = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if rewrite is not None:
        for k, doc_id in enumerate(batch.column(0).to_pylist()):
            taken = rewrite(doc_id, int(at[k + 1] - at[k]))
            if taken is not None:
                ids[at[k] : at[k + 1]] = ids[at[k] : at[k + 1]][taken]
    return words.dictionary.to_pylist(), ids, at


def _kept(found: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a word is outside what its runs hold after their first period."""
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    start = at[found[:, 0]] + found[:, 1]
    np.add.at(edge, start + found[:, 3], 1)
    np.add.at(edge, start + found[:, 2], -1)
    return np.cumsum(edge[:-1]) == 0


def _texts(words: list[bytes], ids: np.ndarray, at: np.ndarray, kept: np.ndarray) -> list[bytes]:
    ends = np.concatenate([[0], np.cumsum(kept)])[at]
    left = [words[x] for x in ids[kept].tolist()]
    return [b" ".join(left[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _mapped(documents: DataFrame, each: Callable, schema: str) -> DataFrame:
    @task("periodic")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                yield each(piece)

    return lean(documents.select("doc_id", "text")).mapInArrow(run, schema)


def listed(documents: DataFrame) -> DataFrame:
    """doc_id, start, length, period (counted in words, from 0) of every run of every document."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, ids, at = _worded(batch, None)
        found = runs(ids, at)
        doc = pa.array(batch.column(0)).take(pa.array(found[:, 0]))
        return pa.RecordBatch.from_arrays([doc, *[pa.array(found[:, k]) for k in (1, 2, 3)]], names=["doc_id", "start", "length", "period"])

    return _mapped(documents, each, f"doc_id {dict(documents.dtypes)['doc_id']}, start long, length long, period long")


def collapsed(documents: DataFrame) -> DataFrame:
    """doc_id, text: words joined by one space, each run cut down to its first period (null text: empty)."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, ids, at = _worded(batch, None)
        texts = _texts(words, ids, at, _kept(runs(ids, at), ids, at))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.decode() for x in texts], pa.string())], names=["doc_id", "text"])

    return _mapped(documents, each, f"doc_id {dict(documents.dtypes)['doc_id']}, text string")


def digests(documents: DataFrame, rewrite: Callable | None = None) -> DataFrame:
    """doc_id, n_runs, the run of greatest length / period (start, length, period, exponent_milli; ties: smallest start,
    then period; nulls without runs), and SHA-256 of the list of runs and of the collapsed text.

    ``rewrite``: takes doc_id and the number of words, gives the places of the words to read instead, or None.
    """
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, ids, at = _worded(batch, rewrite)
        found = runs(ids, at)
        texts = _texts(words, ids, at, _kept(found, ids, at))
        edge = np.searchsorted(found[:, 0], np.arange(batch.num_rows + 1)).tolist()
        rows = [tuple(x) for x in found[:, 1:].tolist()]
        out = []
        for k, text in enumerate(texts):
            own = rows[edge[k] : edge[k + 1]]
            best = max(own, key=cmp_to_key(_greater)) if own else (None, None, None)
            told = "".join(f"{s},{n},{q}\n" for s, n, q in own)
            out.append((len(own), *best, 1000 * best[1] // best[2] if own else None, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(text).hexdigest()))
        types = [pa.int64()] * 5 + [pa.string()] * 2
        columns = [pa.array([r[k] for r in out], t) for k, t in enumerate(types)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    schema = ", ".join([f"doc_id {dict(documents.dtypes)['doc_id']}", *[f"{x} long" for x in names[1:6]], *[f"{x} string" for x in names[6:]]])
    return _mapped(documents, each, schema)
