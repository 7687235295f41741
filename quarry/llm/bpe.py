"""Byte-pair encoding and decoding by a merge automaton.

The automaton reads tokens. It starts as one state with a loop for each byte; each merge (a, b) -> c in turn adds a
gadget: the state behind a is split, its copy loses the arc b, and wherever a can be read the arc c leads to where
a b led. In such an automaton all arcs with one label end in one state, so a state is named by the token that leads
to it, and it is stored as its gadgets: when each token's arcs appear (from which pair) and when an arc is cut.
``MergeAutomaton.step`` resolves an arc from them once and keeps it in the transition table.

A token sequence is the encoding of its bytes just if the automaton reads it. As the automaton is deterministic, each
prefix of a word has one last token, so a word is encoded by one walk over its positions.

Nulls and empty texts give no ids; equal rows give equal rows; other columns pass through unread.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm._shared import lean, ragged, slices, task

#: Fixed value: white space of the pre-splitting pattern.
SPACE = r"\t-\r \x85\xa0  -     　"
#: Fixed value: the byte-level tokenizer's pre-splitting pattern.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Distinct words whose encoding a Python worker keeps.
KEPT_WORDS = 400_000
#: Arcs that the transition table keeps.
KEPT_ARCS = 400_000


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, then from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class MergeAutomaton:
    """A byte-level BPE vocabulary compiled into a deterministic automaton over tokens."""

    def __init__(self, specification: str):
        model = json.loads(specification)
        letters = byte_letters()
        to_bytes = lambda token: bytes(letters[x] for x in token)
        vocabulary = model["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in model["added_tokens"]}
        self.pattern = regex.compile(PATTERN)
        self.split = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None
        size = 1 + max([*vocabulary.values(), *self.special.values()], default=-1)
        self.labels: list[bytes] = [b""] * size
        for token, k in vocabulary.items():
            self.labels[k] = to_bytes(token)
        for token, k in self.special.items():
            self.labels[k] = token.encode()
        self.born = [0] * size
        self.parts: list[tuple[int, int] | None] = [None] * size
        self.cut: dict[int, int] = {}
        self.table: dict[int, bool] = {}
        self.read = {bytes([b]): vocabulary[x] for x, b in letters.items() if x in vocabulary}
        for time, pair in enumerate(model["model"]["merges"], 1):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self._merge(time, vocabulary[left], vocabulary[right], vocabulary[left + right])
        #: The longest token that begins with three bytes; others have two at most.
        self.reach: dict[bytes, int] = {}
        for token in self.read:
            if len(token) > 2:
                self.reach[token[:3]] = max(len(token), self.reach.get(token[:3], 0))
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        self._ids, self._ends = array("i"), array("q", [0])

    def _merge(self, time: int, left: int, right: int, token: int) -> None:
        """Adds the gadget of one merge. A pair that no longer can be read adds none: its token is never used."""
        if self.born[token] or self.labels[left] not in self.read or self.labels[right] not in self.read:
            return
        if self._open(left, right, time):
            self.cut[left << 20 | right] = time
            self.born[token], self.parts[token] = time, (left, right)
            self.read[self.labels[token]] = token

    def _open(self, state: int, token: int, time: int) -> bool:
        """Whether the state behind ``state`` has the arc ``token`` when ``time`` comes."""
        while True:
            if self.cut.get(state << 20 | token, time) < time:
                return False
            first, second = self.born[state], self.born[token]
            if not first and not second:
                return True
            if self.parts[token] == (state, state):  # the split-off copy of a state lost the arc before the new one came
                return False
            if second >= first:
                time, token = second, self.parts[token][0]
                if first == second:
                    state = self.parts[state][1]
            else:
                time, state = first, self.parts[state][1]

    def step(self, state: int, token: int) -> bool:
        """The transition table: whether ``token`` can be read in the state behind ``state``."""
        key = state << 20 | token
        found = self.table.get(key)
        if found is None:
            if len(self.table) > KEPT_ARCS:
                self.table.clear()
            found = self.table[key] = self._open(state, token, 1 << 40)
        return found

    def encode_word(self, word: bytes) -> list[int]:
        """The one path of the automaton that reads the word: from each state the longest arc that fits is tried first.

        A place in the word is reached by one path only, so one that led nowhere is never tried again.
        """
        read, step, table, reach = self.read, self.step, self.table, self.reach
        if (whole := read.get(word)) is not None:
            return [whole]
        size, at, state = len(word), 0, 0
        out: list[int] = []
        dead: set[int] = set()
        length = min(size, reach.get(word[:3], 2))
        while at < size:
            while length:
                token = read.get(word[at : at + length])
                if token is not None and at + length not in dead:
                    if not at:
                        break
                    fits = table.get(state << 20 | token)
                    if fits or (fits is None and step(state, token)):
                        break
                length -= 1
            if length:
                out.append(token)
                at, state = at + length, token
                length = min(size - at, reach.get(word[at : at + 3], 2))
            elif out:
                dead.add(at)
                length = len(self.labels[out.pop()])
                at, state = at - length, out[-1] if out else 0
                length -= 1
            else:
                raise ValueError("the vocabulary lacks a byte of the word")
        return out

    def _index(self, word: str) -> int:
        found = self.words.get(word)
        if found is None:
            found = self.words[word] = len(self._ends) - 1
            self._ids.extend([self.special[word[1:]]] if word[:1] == "\0" and word[1:] in self.special else self.encode_word(word.encode()))
            self._ends.append(len(self._ids))
        return found

    def pieces(self, text: str) -> list[str]:
        """Pre-split words; a special token's text stands as NUL and that text, which no pre-split word can be."""
        if self.split is None or not any(x in text for x in self.special):
            return self.pattern.findall(text)
        out, low = [], 0
        for m in self.split.finditer(text):
            out += [*self.pattern.findall(text[low : m.start()]), "\0" + m[0]]
            low = m.end()
        return out + self.pattern.findall(text[low:])

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, and the texts' offsets in them."""
        if len(self.words) > KEPT_WORDS:
            self._forget()
        known, index, picks, sizes = self.words, self._index, [], [0]
        for text in texts:
            words = self.pieces(text) if text else []
            try:
                picks.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
            except KeyError:
                picks.append(np.fromiter(map(index, words), np.int64, len(words)))
            sizes.append(len(words))
        pick = np.concatenate(picks) if picks else np.zeros(0, np.int64)
        ids, at = ragged(np.array(self._ids, dtype=np.int32), np.array(self._ends, dtype=np.int64), pick)
        return ids, at[np.cumsum(sizes)]

    def decode_batch(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arc labels of the ids on end, and the texts' offsets in them. An id without a label emits nothing."""
        if not hasattr(self, "_label_bytes"):
            self._label_bytes = np.frombuffer(b"".join(self.labels), np.uint8)
            self._label_at = np.concatenate([[0], np.cumsum([len(x) for x in self.labels])])
        good = np.where((ids >= 0) & (ids < len(self.labels)), ids, len(self.labels))
        data, ends = ragged(self._label_bytes, np.append(self._label_at, self._label_at[-1]), good)
        return data, ends[at]


_compiled: dict[str, MergeAutomaton] = {}


def automaton(specification: str) -> MergeAutomaton:
    """Compiled once for each Python worker."""
    if specification not in _compiled:
        _compiled.clear()
        _compiled[specification] = MergeAutomaton(specification)
    return _compiled[specification]


def specification(path: str) -> str:
    """A tokenizer's JSON, read on the driver: executors get its text (a few MB at most), not the path."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def _encoded(machine: MergeAutomaton, batch: pa.RecordBatch, text: str, ids: str) -> pa.RecordBatch:
    values, at = machine.encode_batch(batch.column(text).to_pylist())
    lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values, pa.int32()))
    return pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, ids])


def _decoded(machine: MergeAutomaton, batch: pa.RecordBatch, ids: str, text: str) -> pa.RecordBatch:
    lists = batch.column(ids)
    lists = pa.array([x or [] for x in lists.to_pylist()], pa.list_(pa.int32())) if lists.null_count else lists
    at = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.slice(at[0], at[-1] - at[0])
    data, ends = machine.decode_batch(np.asarray(values.fill_null(-1)), at - at[0])
    raw = data.tobytes()
    try:
        for a, b in zip(ends, ends[1:], strict=False):
            raw[a:b].decode()
        out = pa.Array.from_buffers(pa.string(), len(batch), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])
    except UnicodeDecodeError:
        out = pa.array([raw[a:b].decode(errors="replace") for a, b in zip(ends, ends[1:], strict=False)], pa.string())
    return pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, text])


def encode(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``df`` with the column ``ids`` array<int>: the encoding of each whole text. ``tokenizer``: a vocabulary's path.

    ``decoded``: also add this column, the ids decoded again (in the same Python worker). A null text has no ids, like
    the empty one. Columns already named ``ids`` or ``decoded`` are replaced.
    """
    df = lean(df.drop(ids, *[decoded] * bool(decoded)))
    told = df.sparkSession.sparkContext.broadcast(specification(tokenizer))

    @task("bpe", _compiled.clear)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(told.value)
        for whole in batches:
            for batch in slices(whole, text):
                out = _encoded(machine, batch, text, ids)
                yield _decoded(machine, out, ids, decoded) if decoded else out

    more = [T.StructField(ids, T.ArrayType(T.IntegerType())), *[T.StructField(decoded, T.StringType())] * bool(decoded)]
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *more]))


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the column ``text`` string: the labels of the ids on end, bytes that aren't UTF-8 replaced by U+FFFD.

    Null ids give the empty text. A column already named ``text`` is replaced.
    """
    df = lean(df.drop(text))
    told = df.sparkSession.sparkContext.broadcast(specification(tokenizer))

    @task("bpe", _compiled.clear)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(told.value)
        for batch in batches:
            yield _decoded(machine, batch, ids, text)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(text, T.StringType())]))


def ids_text(ids: Column) -> Column:
    """Decimal ids joined by commas."""
    return F.concat_ws(",", ids.cast("array<string>"))


def round_trip(documents: DataFrame, tokenizer: str) -> DataFrame:
    """Digests of the ids and of the decoded text of each document."""
    return encode(documents.select("doc_id", "text"), tokenizer, decoded="decoded").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids_text(F.col("ids")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
