"""Toxicity by a string-subsequence-kernel support vector machine with Nystroem landmarks.

Units are words: A-Z lower-cased, ASCII marks taken out (so ``i-d.i*o_t`` is one unit), runs of three single characters
or more joined, a mark at either end, units of over 48 bytes cut into windows of 48 that overlap by half. The kernel of
a unit with a landmark counts their common subsequences of three bytes, gaps and all, each weighed by 0.7 for every byte
it spans, scaled to 1 for equal units, cubed; it is 0 where the unit has fewer than three fifths of the landmark's
neighbouring byte pairs (in order, at most three apart). A sentence's kernel with a landmark is the greatest of its
units'. Mapped by the landmarks' matrix of the same kernel (made symmetric) to the power -1/2 (Nystroem), sentences are
told apart by a linear support vector machine. A document has two features, the hyperbolic tangent of its worst
sentence's margin, and the sum of the tangents of its positive margins against its length in words (one in ``USUAL``
words counts in full); a logistic function of both, learned on the sample, is its score.

Fitting: about ``PER_CLASS`` learned documents of each label, of 20,000 characters at most. Landmarks come from both
labels: words and beginnings of words that tell toxic documents best (at least ``ODDS`` times as frequent there as in the
others, and oftener than chance would have it for one in a hundred samples, all words tried), and the commonest words of
clean documents that resemble one of them. Toxic words with a character put in are
positive sentences besides.
Whole texts are scored. A null or empty text has the score of a text without any hit. Without landmarks (no toxic
document learned) every score is the share of label 1. Repeated rows are scored each.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm._shared import _LOWER, _SPACE, lean, ragged, remainder, slices, split_words, task, text_bytes
from quarry.llm.linear import chances, labelled_sample, logistic, svm

PER_CLASS, LANDMARKS, CLEAN, ODDS, CHANCE, USUAL, WINDOW, DECAY, LENGTH, APART, SHARE = 2000, 112, 16, 10, 0.01, 50, 48, 0.7, 3, 3, 0.6
_KEPT = np.zeros(256, dtype=bool)
_KEPT[np.r_[0x30:0x3A, 0x41:0x5B, 0x61:0x7B, 0x80:0x100]] = True
_KEPT |= _SPACE
_HEAD, _TAIL = b"\x02", b"\x03"
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?;:")] = True


def _grid(units: list[bytes] | tuple[np.ndarray, np.ndarray], width: int) -> np.ndarray:
    """Units as rows of 16-bit codes, -1 behind their ends."""
    data, at = units if isinstance(units, tuple) else (np.frombuffer(b"".join(units), np.uint8), np.concatenate([[0], np.cumsum(list(map(len, units)))]).astype(np.int64))
    sizes = np.diff(at)
    out = np.full((len(sizes), width), -1, dtype=np.int16)
    out[np.arange(width) < sizes[:, None]] = data
    return out


def _raw_kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The unscaled kernel of each row of ``s`` with the same row of ``t``."""
    match = ((s[:, :, None] == t[:, None, :]) & (s[:, :, None] >= 0)).astype(np.float32)
    fall = lambda n: np.tril(np.float32(DECAY) ** np.abs(np.subtract.outer(np.arange(n), np.arange(n))).astype(np.float32), -1)
    left, right = fall(s.shape[1]), fall(t.shape[1]).T
    found = match * np.float32(DECAY**2)
    for _ in range(LENGTH - 1):
        found = match * (left @ found @ right)
    return found.sum(axis=(1, 2))


def kernel(s: np.ndarray, t: np.ndarray, s_own: np.ndarray | None = None, t_own: np.ndarray | None = None) -> np.ndarray:
    """The kernel, from 0 to 1, of each row of ``s`` with the same row of ``t``."""
    own = np.sqrt((_raw_kernel(s, s) if s_own is None else s_own) * (_raw_kernel(t, t) if t_own is None else t_own))
    return np.divide(_raw_kernel(s, t), own, out=np.zeros(len(s), np.float32), where=own > 0) ** 3


def sentences(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray, np.ndarray]:
    """The units of texts on end: the units, each one's sentence (a number that grows along all texts), the first
    sentence of each text, and the units that were spelt as single characters: (sentence, bytes)."""
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[at] = True
    space = _SPACE[raw]
    after = np.ones(len(raw), dtype=bool)
    after[:-1] = space[1:]
    after |= edge[1:]
    ends = (_STOP[raw] & after) | (raw == 0x0A)
    number = np.cumsum(ends | edge[1:]) - (ends | edge[1:])
    kept = _KEPT[raw]
    new_at = np.concatenate([[0], np.cumsum(kept)])[at]
    clean = _LOWER[raw[kept]]
    words, word_at = split_words(clean, new_at, lower=False)
    starts = _word_starts(clean, new_at)
    return number[kept][starts] if len(starts) else np.zeros(0, np.int64), word_at, words, clean


def _word_starts(clean: np.ndarray, at: np.ndarray) -> np.ndarray:
    space = _SPACE[clean]
    before = np.ones(len(clean), dtype=bool)
    before[1:] = space[:-1]
    before[at[:-1][at[:-1] < len(clean)]] = True
    return np.flatnonzero(~space & before)


def _spelt(words: pa.DictionaryArray, word_at: np.ndarray) -> list[tuple[int, bytes]]:
    """Runs of three single characters or more within a text: the first word's number, and the characters joined."""
    data, at = text_bytes(words.dictionary)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    single = (heads[at[1:]] - heads[at[:-1]] == 1)[np.asarray(words.indices)] if len(words) else np.zeros(0, bool)
    owner = np.repeat(np.arange(len(word_at) - 1), np.diff(word_at))
    fresh = np.ones(len(single), dtype=bool)
    fresh[1:] = (single[1:] != single[:-1]) | (owner[1:] != owner[:-1])
    begun = np.flatnonzero(fresh)
    sizes = np.diff(np.append(begun, len(single)))
    texts = words.dictionary
    codes = np.asarray(words.indices)
    return [(int(a), b"".join(texts[int(c)].as_py() for c in codes[a : a + n])) for a, n in zip(begun, sizes, strict=True) if n >= 3 and single[a]]


@dataclass
class ToxicModel:
    landmarks: list[bytes]
    root: np.ndarray
    weights: np.ndarray
    scale: tuple[float, ...] = (1.0, 0.0, 0.0)
    share: float = 0.0
    pairs: dict = field(default_factory=dict)

    def prepare(self) -> None:
        if self.pairs or not self.landmarks:
            return
        column = np.full(1 << 16, -1, dtype=np.int32)
        rows, need = [], []
        for m, mark in enumerate(self.landmarks):
            own = sorted({mark[k] << 8 | mark[k + 1] for k in range(len(mark) - 1)})
            need.append(max(1, int(np.ceil(SHARE * len(own) - 1e-9))))
            for code in own:
                if column[code] < 0:
                    column[code] = len(rows)
                    rows.append([])
                rows[column[code]].append(m)
        grid = _grid(self.landmarks, max(map(len, self.landmarks)))
        self.pairs = {"column": column, "at": np.concatenate([[0], np.cumsum(list(map(len, rows)))]), "marks": np.array([m for x in rows for m in x]), "need": np.array(need), "grid": grid, "own": _raw_kernel(grid, grid)}

    def hits(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of units on end: the unit, the landmark and the kernel of each two whose kernel isn't 0."""
        self.prepare()
        n, m = len(at) - 1, len(self.landmarks)
        owner = np.arange(n)
        long = np.flatnonzero(np.diff(at) > WINDOW)
        if len(long):  # long units as windows
            lows = [np.arange(at[k], at[k + 1] - WINDOW // 2, WINDOW // 2) for k in long]
            short = np.flatnonzero(np.diff(at) <= WINDOW)
            starts = np.concatenate([at[short], *lows])
            owner = np.concatenate([short, np.repeat(long, list(map(len, lows)))])
            sizes = np.minimum(at[owner + 1] - starts, WINDOW)
            new_at = np.concatenate([[0], np.cumsum(sizes)])
            data = data[np.arange(new_at[-1]) + np.repeat(starts - new_at[:-1], sizes)]
            at, n = new_at, len(owner)
        unit = np.repeat(np.arange(n, dtype=np.int64), np.diff(at))
        wide, keys = data.astype(np.int32), []
        columns = len(self.pairs["at"]) - 1
        for d in range(1, APART + 1):
            found = self.pairs["column"][wide[:-d] << 8 | wide[d:]]
            good = (found >= 0) & (unit[:-d] == unit[d:])
            keys.append(unit[:-d][good] * columns + found[good])
        key = np.unique(np.concatenate(keys))
        picks, step = [], 8192
        for low in range(0, n, step):
            part = key[np.searchsorted(key, low * columns) : np.searchsorted(key, (low + step) * columns)]
            marks, ends = ragged(self.pairs["marks"], self.pairs["at"], part % columns)
            count = np.bincount(np.repeat(part // columns - low, np.diff(ends)) * m + marks, minlength=step * m)
            picks.append(np.flatnonzero(count.reshape(step, m) >= self.pairs["need"]) + low * m)
        pick = np.concatenate(picks)
        u, k = pick // m, pick % m
        value = np.zeros(len(pick), dtype=np.float32)
        sizes = np.diff(at)[u]
        for low, high in ((0, 8), (8, 16), (16, 32), (32, WINDOW)):
            for part in np.array_split(np.flatnonzero((sizes > low) & (sizes <= high)), 1 + ((sizes > low) & (sizes <= high)).sum() // 2000):
                if len(part):
                    grid = _grid(ragged(data, at, u[part]), high)
                    value[part] = kernel(grid, self.pairs["grid"][k[part]], None, self.pairs["own"][k[part]])
        some = value > 0
        return owner[u[some]], k[some], value[some]

    def sentence_vectors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The text and the kernels with the landmarks of each sentence that has a hit, and each text's words."""
        raw, at = text_bytes(texts)
        number, word_at, words, _ = sentences(raw, at)
        index = np.asarray(words.indices).astype(np.int64) if len(words) else np.zeros(0, np.int64)
        spelt = _spelt(words, word_at)
        data, ends = text_bytes(words.dictionary)
        if spelt:
            extra = [x for _, x in spelt]
            index = np.append(index, len(ends) - 1 + np.arange(len(extra)))
            number = np.append(number, number[[k for k, _ in spelt]])
            data = np.concatenate([data, np.frombuffer(b"".join(extra), np.uint8)])
            ends = np.concatenate([ends, ends[-1] + np.cumsum(list(map(len, extra)))])
        owner = np.repeat(np.arange(len(texts)), np.diff(word_at))
        owner = np.append(owner, owner[[k for k, _ in spelt]]) if spelt else owner
        size = np.diff(ends) + 2
        data = np.insert(data, np.repeat(ends, [1, *[2] * (len(ends) - 2), 1] if len(ends) > 1 else [0]), np.frombuffer((_HEAD + _TAIL) * (len(ends) - 1), np.uint8))
        ends = np.concatenate([[0], np.cumsum(size)])
        if len(data) <= APART:
            return np.zeros(0, np.int64), np.zeros((0, len(self.landmarks)), np.float32), np.diff(word_at)
        unit, mark, value = self.hits(data, ends)
        order = np.argsort(unit, kind="stable")
        unit, mark, value = unit[order], mark[order], value[order]
        first = np.searchsorted(unit, np.arange(len(ends)))
        told = np.flatnonzero(first[index + 1] > first[index])
        rows, row_at = ragged(np.arange(len(unit)), first, index[told])
        names, place = np.unique(number[told], return_inverse=True)
        out = np.zeros((len(names), len(self.landmarks)), dtype=np.float32)
        np.maximum.at(out, (np.repeat(place, np.diff(row_at)), mark[rows]), value[rows])
        which = np.zeros(len(names), dtype=np.int64)
        which[place] = owner[told]
        return which, out, np.diff(word_at)

    def features(self, which: np.ndarray, x: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The two features of each document, from ``sentence_vectors``."""
        out = np.zeros((len(words), 2))
        out[:, 0] = np.tanh(self.weights[-1])
        told = np.tanh(x @ self.root @ self.weights[:-1] + self.weights[-1])
        np.maximum.at(out[:, 0], which, told)
        np.add.at(out[:, 1], which, np.maximum(told, 0))
        out[:, 1] = np.minimum(out[:, 1] / (1 + words / USUAL), 1)
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        if not self.landmarks:
            return np.full(len(texts), self.share)
        return logistic(self.features(*self.sentence_vectors(texts)) @ np.array(self.scale[:-1]) + self.scale[-1])


def _parts(word: bytes) -> set[bytes]:
    """The word with both its marks, and its beginnings."""
    return ({_HEAD + word + _TAIL} if LENGTH <= len(word) <= 24 else set()) | {_HEAD + word[:k] for k in range(4, min(len(word), 9))}


def _landmarks(texts: list[str], toxic: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Words and beginnings of words that tell the toxic texts, the most telling first, and clean texts' words, the
    commonest first.

    As copies repeat a word's surroundings, its support is the number of different words before it or behind it in toxic
    texts, whichever is less.
    """
    bags: list[list[bytes]] = []
    hits: dict[bytes, int] = defaultdict(int)
    misses: dict[bytes, int] = defaultdict(int)
    clean: Counter[bytes] = Counter()
    for text, bad in zip(texts, toxic, strict=True):
        raw, at = text_bytes(pa.array([text], pa.string()))
        words = sentences(raw, at)[2]
        bags.append(words.to_pylist() if bad else [])
        kinds = words.dictionary.to_pylist()
        for part in set().union(*map(_parts, kinds)) if kinds else ():
            (hits if bad else misses)[part] += 1
        if not bad:
            clean.update(kinds)
    bad, fine = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    usual, needed = bad / (bad + fine), float(np.log(max(1, len(hits)) / CHANCE))

    def told(part: bytes, n: int) -> bool:
        """Whether the part is in toxic texts so often, and oftener than by chance (Chernoff's bound)."""
        rest = misses.get(part, 0)
        share = n / (n + rest)
        if n / bad < ODDS * rest / fine or share <= usual:
            return False
        gain = share * np.log(share / usual) + (1 - share) * np.log(max(1 - share, 1e-12) / (1 - usual))
        return (n + rest) * gain >= needed

    good = {part for part, n in hits.items() if told(part, n)}
    covers: dict[bytes, set[int]] = defaultdict(set)
    befores: dict[bytes, set[bytes]] = defaultdict(set)
    afters: dict[bytes, set[bytes]] = defaultdict(set)
    for n, words in enumerate(bags):
        for before, word, after in zip([b"", *words], words, [*words[1:], b""], strict=False):
            for part in _parts(word) & good:
                covers[part].add(n)
                befores[part].add(before)
                afters[part].add(after)
    support = {part: min(len(befores[part]), len(afters[part]), len(docs)) for part, docs in covers.items()}
    out: list[bytes] = []
    for part in sorted(covers, key=lambda x: (-support[x], -len(x), x)):
        docs = covers[part]
        kin = (x for x in out if x.startswith(part) or part.startswith(x.removesuffix(_TAIL)))
        if told(part, support[part]) and not any(len(docs & covers[x]) > 0.9 * len(docs) and misses.get(x, 0) <= misses.get(part, 0) for x in kin):
            out.append(part)
        if len(out) == LANDMARKS:
            break
    order = sorted((w for w, n in clean.items() if n > 1 and LENGTH <= len(w) <= 24), key=lambda w: (-clean[w], w))
    return out, [_HEAD + w + _TAIL for w in order]


def _kin(model: ToxicModel, words: list[bytes], most: int) -> list[bytes]:
    """The first ``most`` of ``words`` that have half of the kernel's greatest value with a landmark."""
    out: list[bytes] = []
    for low in range(0, len(words), 5000):
        some = words[low : low + 5000]
        unit, _, value = model.hits(*text_bytes(pa.array(some, pa.binary())))
        near = np.zeros(len(some))
        np.maximum.at(near, unit, value)
        out += [some[k] for k in np.flatnonzero(near >= 0.5) if some[k] not in model.landmarks]
        if len(out) >= most:
            break
    return out[:most]


def _disguised(marks: list[bytes], texts: list[str], forms: int = 8) -> list[bytes]:
    """Forms with one character put in: of the landmarks that are whole words, and of words of ``texts`` that begin with
    one of the others (within that beginning)."""
    random = np.random.default_rng(0)
    words = sorted({w for text in texts for w in sentences(*text_bytes(pa.array([text], pa.string())))[2].dictionary.to_pylist()})
    out = []
    for mark in marks:
        whole = [mark] if mark.endswith(_TAIL) else [_HEAD + w + _TAIL for w in words if w.startswith(mark[1:]) and len(w) <= 24]
        for _ in range(forms if whole else 0):
            word = whole[int(random.integers(len(whole)))]
            k = int(random.integers(2, min(len(word), len(mark)) - (word == mark)))
            out.append(word[:k] + bytes([int(random.integers(0x61, 0x7B))]) + word[k:])
    return out


def fit(texts: list[str], labels: list[int], counts: dict[int, int]) -> ToxicModel:
    y = np.array(labels, dtype=int)
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    none = ToxicModel([], np.zeros((0, 0)), np.zeros(1), share=share)
    marks, others = _landmarks(texts, y == 1) if len(texts) else ([], [])
    if not marks or not (y == 0).any():
        return none
    clean = _kin(ToxicModel(marks, none.root, none.weights), others, CLEAN)
    m = len(marks) + len(clean)
    model = ToxicModel([*marks, *clean], np.eye(m), np.zeros(m + 1), share=share)
    own = np.zeros((m, m))
    unit, mark, value = model.hits(*text_bytes(pa.array(model.landmarks, pa.binary())))
    own[unit, mark] = value
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    model.root = (vectors / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    rows, signs, read = [np.zeros((1, m))], [-1.0], []
    for low in range(0, len(texts), 500):
        which, x, words = model.sentence_vectors(pa.array(texts[low : low + 500], pa.string()))
        read.append((which, x, words))
        bad = y[low + which] == 1
        peak = x[:, : len(marks)].max(axis=1) if len(x) else np.zeros(0)
        best = np.zeros(500)
        np.maximum.at(best, which, peak)
        use = ~bad | (peak >= best[which])  # of a toxic text the sentence nearest to a landmark
        rows.append(x[use])
        signs += np.where(bad[use], 1.0, -1.0).tolist()
    forms = _disguised(marks, [text for text, bad in zip(texts, y, strict=True) if bad])
    if forms:
        unit, mark, value = model.hits(*text_bytes(pa.array(forms, pa.binary())))
        x = np.zeros((len(forms), m), dtype=np.float32)
        x[unit, mark] = value
        rows.append(x)
        signs += [1.0] * len(forms)
    model.weights = svm(np.concatenate(rows) @ model.root, np.array(signs), cost=10.0, level=False)
    told = np.concatenate([model.features(*x) for x in read])
    model.scale = tuple(chances(told, np.where(y == 1, 1.0, -1.0)))
    return model


def scored(df: DataFrame, model: ToxicModel, text: str = "text") -> DataFrame:
    """``df`` with the columns score double and predicted int; columns so named before are replaced."""
    df = lean(df.drop("score", "predicted"))
    model.pairs = {}
    told = df.sparkSession.sparkContext.broadcast(model)

    @task("toxicity")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                score = told.value.score(batch.column(text))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def learned(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> ToxicModel:
    """A model of the labelled documents whose crc32(doc_id) mod 5 isn't 0."""
    marks = labels.where(F.col("toxic").isin(0, 1)).select("doc_id", "toxic")
    rows = documents.where(remainder(F.col("doc_id"), 5) != 0).select("doc_id", "text").join(marks, "doc_id")
    sample, counts = labelled_sample(rows, "toxic", per_class)
    return fit([x for x, _ in sample], [int(y) for _, y in sample], counts)


def predicted(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``documents``."""
    rows = documents.select("doc_id", "text", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"))
    return scored(rows, learned(documents, labels)).select("doc_id", "held_out", "score", "predicted")


def accepted(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't predicted toxic."""
    names = documents.columns
    plain = documents.toDF(*[f"__{k}" for k in range(len(names))])  # no name clashes
    tagged = scored(plain, learned(documents, labels), f"__{names.index('text')}")
    return tagged.where("predicted = 0").drop("score", "predicted").toDF(*names)
