"""Language identification by hierarchical discrimination.

A text's byte n-grams (2 to 4) are hashed into counts. First linear support vector machines, one against the rest,
choose the language family; then one-versus-one linear support vector machines separate the languages within it, each
pair's margin turned into a probability. The score is the family's probability times the language's within it.

Fitting: about ``PER_CLASS`` texts of each language among the learned rows, of 20,000 characters at most; whole texts
are scored. A null text, and one without any letter, is ``und`` with score 1; so is every text when no language can be
learned (score 0). Ties go to the language that sorts first. Repeated rows are scored each.

Familiarity tells a text of none of the languages, which the machines, made to choose, may well score high: the cosine of
its n-grams to the nearest language's mean, over the median cosine of learned snippets with as many different n-grams
(short texts are less like any mean). Texts of the learned languages lie around 1; ``FAMILIAR`` parts them from others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm._shared import _LOWER, lean, remainder, slices, task, text_bytes
from quarry.llm.linear import calibration, labelled_sample, logistic, svm

DIMENSIONS, PER_CLASS, ROWS = 4096, 400, 200
#: Below this score, or this familiarity, a pipeline rejects a document.
DOUBT, FAMILIAR = 0.3, 0.6
#: Language families by ISO 639-1 code; a language not listed is a family of its own.
FAMILIES = {
    "Germanic": "af da de en fy is lb nl nn no sv yi",
    "Romance": "ca es fr gl it oc pt ro",
    "Slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "Uralic": "et fi hu",
    "Turkic": "az kk ky tr uz",
    "Semitic": "am ar he mt",
    "Indo-Aryan": "bn gu hi mr ne pa ur",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
_ALPHA = np.zeros(256, dtype=np.uint8)
_ALPHA[:] = 32
_ALPHA[np.r_[0x61:0x7B, 0x80:0x100]] = np.r_[0x61:0x7B, 0x80:0x100]


def features(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of hashed n-gram counts for each text, square roots scaled to length one."""
    n = len(at) - 1
    out = np.zeros(n * DIMENSIONS, dtype=np.float64)
    if len(raw):
        b = _ALPHA[_LOWER[raw]].astype(np.uint32)
        owner = np.repeat(np.arange(n, dtype=np.int64) * DIMENSIONS, np.diff(at))
        code = b
        for k in range(1, 4):
            code = code[:-1] * np.uint32(256) + b[k:]
            same = owner[: len(code)] == owner[k:]
            bucket = ((code + np.uint32(k)) * np.uint32(2654435761)) >> np.uint32(32 - 12)
            out += np.bincount((owner[: len(code)] + bucket)[same], minlength=len(out))
    x = np.sqrt(out.reshape(n, DIMENSIONS))
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)


@dataclass
class LanguageModel:
    languages: list[str]
    families: list[list[int]]
    family_weights: np.ndarray
    family_scales: np.ndarray
    pairs: list[tuple[int, int]]
    pair_weights: np.ndarray
    pair_scales: np.ndarray
    means: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def familiarity(self, x: np.ndarray) -> np.ndarray:
        """How like the nearest language's mean texts are, by what learned snippets of as many n-grams are."""
        usual = np.interp(np.log2(1 + (x > 0).sum(axis=1)), *self.knots)
        return (x @ self.means).max(axis=1) / np.maximum(usual, 1e-6)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the languages, and scores."""
        n = len(x)
        if len(self.families) > 1:
            chance = logistic((x @ self.family_weights[:-1] + self.family_weights[-1]) * self.family_scales[:, 0] + self.family_scales[:, 1])
            chance /= chance.sum(axis=1, keepdims=True)
        else:
            chance = np.ones((n, 1))
        family = chance.argmax(axis=1)
        language, score = np.zeros(n, dtype=np.int64), chance.max(axis=1)
        margin = (x @ self.pair_weights[:-1] + self.pair_weights[-1]) if self.pairs else np.zeros((n, 0))
        for f, members in enumerate(self.families):
            mine = family == f
            votes = np.zeros((int(mine.sum()), len(members)))
            for k, (a, b) in enumerate(self.pairs):
                if a in members:
                    p = logistic(margin[mine, k] * self.pair_scales[k, 0] + self.pair_scales[k, 1])
                    votes[:, members.index(a)] += p
                    votes[:, members.index(b)] += 1 - p
            if len(members) > 1:
                votes /= votes.sum(axis=1, keepdims=True)
                score[mine] *= votes.max(axis=1)
            language[mine] = np.array(members)[votes.argmax(axis=1)]
        return language, np.clip(score, 0, 1)


def _trend(texts: list[str], means: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (log2 of different n-grams + 1, median cosine to the nearest mean) from snippets of 8 characters and more."""
    pieces = [x[: 8 << (k % 12)] for k, x in enumerate(texts)] + texts
    x = np.concatenate([features(*text_bytes(pa.array(pieces[k : k + ROWS], pa.string()))) for k in range(0, len(pieces), ROWS)])
    size, like = np.log2(1 + (x > 0).sum(axis=1)), (x @ means).max(axis=1)
    bins = np.round(2 * size).astype(int)
    some = [b for b in np.unique(bins) if (bins == b).sum() >= 5] or [int(bins[0])]
    return np.array([size[bins == b].mean() for b in some]), np.array([np.median(like[bins == b]) for b in some])


def fit(texts: list[str], langs: list[str]) -> LanguageModel | None:
    """None if there is nothing to learn from."""
    if not texts:
        return None
    languages = sorted(set(langs))
    y = np.array([languages.index(x) for x in langs])
    x = np.concatenate([features(*text_bytes(pa.array(texts[k : k + ROWS], pa.string()))) for k in range(0, len(texts), ROWS)])
    named: dict[str, list[int]] = {}
    for k, code in enumerate(languages):
        named.setdefault(_FAMILY.get(code, f"={code}"), []).append(k)
    families = list(named.values())

    def machine(rows: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, tuple[float, float]]:
        w = svm(x[rows], sign, rounds=80)
        return w, calibration(x[rows] @ w[:-1] + w[-1], sign)

    every = np.arange(len(y))
    tops = [machine(every, np.where(np.isin(y, members), 1.0, -1.0)) for members in families] if len(families) > 1 else []
    pairs = [pair for members in families for pair in combinations(members, 2)]
    within = [machine(rows := np.flatnonzero((y == a) | (y == b)), np.where(y[rows] == a, 1.0, -1.0)) for a, b in pairs]
    stack = lambda found: np.column_stack([w for w, _ in found]).astype(np.float32) if found else np.zeros((DIMENSIONS + 1, 0), np.float32)
    scale = lambda found: np.array([s for _, s in found]).reshape(-1, 2)
    means = np.stack([x[y == k].mean(axis=0) for k in range(len(languages))], axis=1)
    means /= np.maximum(np.linalg.norm(means, axis=0), 1e-12)
    return LanguageModel(languages, families, stack(tops), scale(tops), pairs, stack(within), scale(within), means, _trend(texts, means))


def identify(df: DataFrame, model: LanguageModel | None, text: str = "text", familiar: bool = False) -> DataFrame:
    """``df`` with the columns lang_pred string and score double, and with ``familiar`` familiarity double (1 for ``und``);
    columns so named before are replaced."""
    more = ["lang_pred", "score", *(["familiarity"] if familiar else [])]
    df = lean(df.drop(*more))
    told = df.sparkSession.sparkContext.broadcast(model)

    @task("langid")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = told.value
        for whole in batches:
            for part in slices(whole, text, 1 << 20):
                for low in range(0, part.num_rows, ROWS):
                    batch = part.slice(low, ROWS)
                    texts = batch.column(text)
                    raw, at = text_bytes(texts)
                    ascii_letter = np.concatenate([[0], np.cumsum((_LOWER[raw] >= 0x61) & (_LOWER[raw] <= 0x7A))])
                    letters = ascii_letter[at[1:]] > ascii_letter[at[:-1]]
                    for k in np.flatnonzero(~letters):
                        letters[k] = any(map(str.isalpha, texts[int(k)].as_py() or ""))
                    if known is None:
                        names, scores, like = ["und"] * len(batch), np.where(letters, 0.0, 1.0), np.ones(len(batch))
                    else:
                        x = features(raw, at)
                        found, scores = known.predict(x)
                        like = np.where(letters, known.familiarity(x), 1.0)
                        names = [known.languages[k] if good else "und" for k, good in zip(found, letters, strict=True)]
                        scores = np.where(letters, scores, 1.0)
                    told_of = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(like, pa.float64())][: len(more)]
                    yield pa.RecordBatch.from_arrays([*batch.columns, *told_of], names=[*batch.schema.names, *more])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *[T.StructField(x, T.StringType() if x == "lang_pred" else T.DoubleType()) for x in more]]))


def learned(documents: DataFrame, per_class: int = PER_CLASS) -> LanguageModel | None:
    """A model of the documents whose crc32(doc_id) mod 4 isn't 2, from text and lang alone."""
    rows, _ = labelled_sample(documents.where(remainder(F.col("doc_id"), 4) != 2).select("doc_id", "text", "lang"), "lang", per_class)
    return fit([x for x, _ in rows], [y for _, y in rows])


def predicted(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of ``documents``."""
    rows = documents.select("doc_id", "text", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"))
    return identify(rows, learned(documents)).select("doc_id", "held_out", "lang_pred", "score")


def accepted(documents: DataFrame) -> DataFrame:
    """The documents whose language is told with a score of ``DOUBT`` and a familiarity of ``FAMILIAR`` at least."""
    names = documents.columns
    plain = documents.toDF(*[f"__{k}" for k in range(len(names))])  # no name clashes
    tagged = identify(plain, learned(documents), f"__{names.index('text')}", familiar=True)
    return tagged.where((F.col("lang_pred") != "und") & (F.col("score") >= DOUBT) & (F.col("familiarity") >= FAMILIAR)).drop("lang_pred", "score", "familiarity").toDF(*names)
