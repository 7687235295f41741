"""Quality by Bradley-Terry ranking.

Each text has measures (shares of character kinds, repetition, lengths of words and lines), each cut into one-hot
features midway between the quantiles of the learned texts (classes weigh alike) and the next greater value. From all
preference pairs of a text labelled 1 over one labelled 0, a weight for each feature is learned by logistic loss on the
differences of features; a text's worth is its weights' sum. The threshold is the quantile of worth that cuts off as
many labelled rows as bear the label 0; the score is a logistic function of the worth that is 0.7 there.

Fitting: every learned row with a label, whole; cuts, weights, threshold and scale come from passes over a table of
their measures (``ranking``). A null text is learned and scored as the empty one. Without texts of both labels every
score is the share of label 1 (1 without labels). Repeated rows are learned and scored each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm._shared import lean, remainder, removed, slices, split_words, task, text_bytes, written
from quarry.llm.linear import logistic
from quarry.llm.ranking import Pass, here, over, quantiles, ranked

BINS, THRESHOLD = 10, 0.7
_KINDS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\n\x0b\x0c", b".", b",", b"!", b"?", b"|", b"*#%&$@^~_=+", b"-/\\:;'\"()[]{}<>`", bytes(range(128, 256)), b"\n"]


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[at[1:]] - total[at[:-1]]


def measures(texts: pa.Array) -> np.ndarray:
    """A row of real measures for each text; every one is finite, for the empty text too."""
    raw, at = text_bytes(texts)
    n, size = len(texts), np.maximum(1, np.diff(at)).astype(float)
    out = [np.log1p(np.diff(at))]
    for kind in _KINDS:
        table = np.zeros(256, dtype=bool)
        table[np.frombuffer(kind, np.uint8)] = True
        out.append(_sums(table[raw], at) / size)
    words, w = split_words(raw, at)
    code = np.asarray(words.indices).astype(np.int64)
    count = np.maximum(1, np.diff(w)).astype(float)
    owner = np.repeat(np.arange(n), np.diff(w))
    length = np.diff(text_bytes(words.dictionary)[1])[code] if len(code) else np.zeros(0)
    mean = _sums(length, w) / count
    out += [np.log1p(np.diff(w)), mean, np.sqrt(np.maximum(0, _sums(length.astype(float) ** 2, w) / count - mean**2))]
    again = np.zeros(len(code), dtype=bool)
    if len(code):
        again[1:] = (code[1:] == code[:-1]) & (owner[1:] == owner[:-1])
    wide = len(words.dictionary) + 1
    _, first, times = np.unique(owner * wide + code, return_index=True, return_counts=True)
    top = np.zeros(n)
    np.maximum.at(top, owner[first], times)
    pair = (code[:-1] * wide + code[1:])[owner[1:] == owner[:-1]] if len(code) else np.zeros(0, np.int64)
    pair_owner = owner[1:][owner[1:] == owner[:-1]] if len(code) else np.zeros(0, np.int64)
    order = np.lexsort((pair, pair_owner))
    fresh = np.concatenate([[True], (np.diff(pair[order]) != 0) | (np.diff(pair_owner[order]) != 0)])[: len(order)]
    pairs = np.bincount(pair_owner, minlength=n)
    out += [_sums(again, w) / count, np.bincount(owner[first], minlength=n) / count, top / count, np.where(pairs > 0, np.bincount(pair_owner[order][fresh], minlength=n) / np.maximum(1, pairs), 1.0)]
    lines = out[len(_KINDS)] * size + 1
    out += [np.log1p(np.diff(w) / lines), np.log1p(np.diff(at) / lines)]
    return np.column_stack(out)


@dataclass
class QualityModel:
    cuts: list[np.ndarray]
    weights: np.ndarray
    threshold: float
    scale: float
    share: float

    def features(self, x: np.ndarray) -> np.ndarray:
        """Numbers of the one-hot features that are set, a column for each measure."""
        return np.column_stack([np.searchsorted(cut, x[:, k], side="right") + k * BINS for k, cut in enumerate(self.cuts)])

    def worth(self, x: np.ndarray) -> np.ndarray:
        return self.weights[self.features(x)].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(x), self.share)
        return logistic((self.worth(x) - self.threshold) / self.scale + np.log(THRESHOLD / (1 - THRESHOLD)))


def _fitted(rows: Pass, coded: Callable[[QualityModel], Pass], shares: dict[int, float] | None = None) -> QualityModel:
    """A model of rows of measures; ``coded``: the same rows as feature numbers within each measure. ``shares``: the
    weight of each label in the threshold; as many as its rows, if not given."""
    n = rows(lambda x, y: np.bincount(y, minlength=2).astype(float), np.add)
    n = np.zeros(2) if n is None else n
    total = n if shares is None else np.array([shares.get(0, 0), shares.get(1, 0)], dtype=float)
    share = float(total[1] / total.sum()) if total.sum() else 1.0
    if not n.all():
        return QualityModel([], np.zeros(0), 0.0, 1.0, share)
    width = measures(pa.array([""])).shape[1]
    column, part = np.repeat(np.arange(width), BINS - 1), np.tile(np.arange(1, BINS) / BINS, width)
    value, after = quantiles(rows, lambda x: x, column, part * 2 * n[0] * n[1], n[::-1])
    cuts = [np.unique((value + after)[(column == k) & np.isfinite(after)] / 2) for k in range(width)]
    model = QualityModel(cuts, np.zeros(width * BINS), 0.0, 1.0, share)
    rows = coded(model)
    weights = model.weights = ranked(rows, width, BINS, n)
    first, weight = np.arange(width) * BINS, total / n

    def worth(x: np.ndarray) -> np.ndarray:
        return weights[x + first].sum(axis=1)

    value, after = quantiles(rows, lambda x: worth(x)[:, None], np.zeros(1, int), total[:1], weight, 16)
    model.threshold = middle = float((value[0] + after[0]) / 2 if np.isfinite(after[0]) else value[0])

    def spreads(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        away = worth(x) - middle
        return np.array([(weight[y] * away).sum(), (weight[y] * away**2).sum()])

    mean, square = rows(spreads, np.add) / total.sum()
    model.scale = max(1e-6, float(np.sqrt(max(0.0, square - mean**2))) / 3)
    return model


def _codes(model: QualityModel, x: np.ndarray) -> np.ndarray:
    return (model.features(x) - np.arange(x.shape[1]) * BINS).astype(np.uint8)


def fit(texts: list[str], labels: list[int], shares: dict[int, float]) -> QualityModel:
    """A model of texts at hand; ``shares``: the labelled rows that each label stands for."""
    y = np.array(labels, dtype=np.int64)
    x = np.concatenate([np.zeros((0, measures(pa.array([""])).shape[1]))] + [measures(pa.array(texts[k : k + 500], pa.string())) for k in range(0, len(texts), 500)])
    return _fitted(here(x, y), lambda model: here(_codes(model, x), y), shares)


def _binary(x: np.ndarray) -> pa.Array:
    """A row's numbers as bytes."""
    x = np.ascontiguousarray(x)
    at = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * x.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(at), pa.py_buffer(x.tobytes())])


def _reals(x: pa.Array) -> np.ndarray:
    return text_bytes(x)[0].view(np.float64).reshape(len(x), -1)


def _scored(batch: pa.RecordBatch, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])


_SCORED = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]


def judged(df: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """``df`` with the columns score double and predicted int; columns so named before are replaced."""
    df = lean(df.drop("score", "predicted"))
    told = df.sparkSession.sparkContext.broadcast(model)

    @task("quality")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                yield _scored(batch, told.value.score(measures(batch.column(text))))

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *_SCORED]))


def _measured(df: DataFrame) -> DataFrame:
    """``df`` with its texts' measures, x, in place of the column text."""
    df = lean(df)
    names = [c for c in df.columns if c != "text"]

    @task("quality")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), _binary(measures(batch.column("text")))], names=[*names, "x"])

    return df.mapInArrow(run, T.StructType([*(df.schema[c] for c in names), T.StructField("x", T.BinaryType())]))


def _learned(measured: DataFrame, labels: DataFrame) -> QualityModel:
    marks = labels.where(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("y"))
    rows = written(measured.join(marks, "doc_id").select("x", "y"))
    tables = [rows]

    def coded(model: QualityModel) -> Pass:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([_binary(_codes(model, _reals(batch.column("x")))), batch.column("y")], names=["x", "y"])

        tables.append(written(rows.mapInArrow(run, rows.schema)))
        return over(tables[-1], "uint8")

    model = _fitted(over(rows, "float64"), coded)
    for table in tables:
        removed(table)
    return model


def learned(documents: DataFrame, labels: DataFrame) -> QualityModel:
    """A model of all labelled documents whose crc32(doc_id) mod 4 isn't 2."""
    return _learned(_measured(documents.where(remainder(F.col("doc_id"), 4) != 2).select("doc_id", "text")), labels)


def predicted(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``documents``. Texts are measured once, for both uses."""
    known = written(_measured(documents.select("doc_id", "text", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"))))
    told = known.sparkSession.sparkContext.broadcast(_learned(known.where(~F.col("held_out")).select("doc_id", "x"), labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _scored(batch, told.value.score(_reals(batch.column("x"))))

    return known.mapInArrow(run, T.StructType([*known.schema.fields, *_SCORED])).select("doc_id", "held_out", "score", "predicted")
