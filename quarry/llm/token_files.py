"""Token-id files of shuffled planes.

A file holds ids in blocks of a fixed size. Each block is transposed into planes (all first bytes, all second bytes,
... or all first bits, ...), each plane is one zstandard frame, and an index at the end has each block's offset, its
ids and its planes' sizes, so that a span of ids is read by unpacking the blocks it touches alone.

Layout, little-endian: magic ``QPL1``; per block its frames on end; per block in the index: u64 offset, u32 ids, u32
size of each plane; at the end u64 place of the index, u64 ids in all, u32 blocks, u32 block size, u8 planes, magic.

Files lie in the binary column of a Parquet table, the one container that Spark writes to any store: a row is a file
with the ids of its documents, their lengths and the place of its first id.

A null text is an empty one and has just the end id. Rows with one doc_id follow each other by text; a null doc_id
comes first. An empty table gives an empty table of files.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm._shared import lean, ragged, shared_folder, slices, split_words, task, text_bytes
from quarry.llm.bpe import specification

MAGIC = b"QPL1"
BLOCK = 16_384
#: Ids of a file at least, but for a partition's last.
FILE_IDS = 1 << 20
#: Distinct pieces whose ids a Python worker keeps.
KEPT_PIECES = 1_000_000
#: Marks that the tokenizer splits from the letters before them.
MARKS = b".,;:!?*#%&$@^~_=+|-/)]}>\""
_TAIL = struct.Struct("<QQIIB4s")
FILES = "part int, part_start bigint, doc_ids array<bigint>, n_tokens array<bigint>, payload binary"


def pack(ids: np.ndarray, block: int = BLOCK, planes: int = 4, level: int = 3) -> bytes:
    """A file of unsigned 32-bit ids. ``planes``: 4 (bytes) or 32 (bits)."""
    if planes not in (4, 32):
        raise ValueError("planes must be 4 or 32")
    squeeze = zstandard.ZstdCompressor(level=level).compress
    out, index, at = [MAGIC], [], len(MAGIC)
    for low in range(0, len(ids), block):
        part = np.ascontiguousarray(ids[low : low + block], dtype="<u4")
        bytewise = part.view(np.uint8).reshape(-1, 4)
        if planes == 4:
            rows = [np.ascontiguousarray(bytewise[:, k]).tobytes() for k in range(4)]
        else:
            bits = np.unpackbits(bytewise, axis=1, bitorder="little")
            rows = [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]
        frames = [squeeze(x) for x in rows]
        index.append(struct.pack(f"<QI{planes}I", at, len(part), *map(len, frames)))
        out += frames
        at += sum(map(len, frames))
    return b"".join([*out, *index, _TAIL.pack(at, len(ids), len(index), block, planes, MAGIC)])


def unpack(data: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """The ids ``start`` to ``stop`` of a file; only blocks that hold some of them are unpacked."""
    place, total, blocks, block, planes, magic = _TAIL.unpack_from(data, len(data) - _TAIL.size)
    if data[:4] != MAGIC or magic != MAGIC:
        raise ValueError("not a token-id file")
    stop = total if stop is None else min(stop, total)
    start = min(max(0, start), stop)
    entry, spread = struct.Struct(f"<QI{planes}I"), zstandard.ZstdDecompressor().decompress
    out = []
    for k in range(start // block, min(blocks, -(-stop // block))):
        at, n, *sizes = entry.unpack_from(data, place + k * entry.size)
        rows = []
        for size in sizes:
            rows.append(np.frombuffer(spread(data[at : at + size]), np.uint8))
            at += size
        if planes == 4:
            whole = np.stack(rows, axis=1)
        else:
            bits = np.stack([np.unpackbits(x, count=n, bitorder="little") for x in rows], axis=1)
            whole = np.packbits(bits, axis=1, bitorder="little")
        ids = np.ascontiguousarray(whole).view("<u4").ravel()
        out.append(ids[max(0, start - k * block) : stop - k * block])
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


class PieceEncoder:
    """A tokenizer of the tokenizers library, asked once for each distinct run of characters other than white space.

    Pieces are known by their 64-bit hash. Holds for tokenizers that lower-case, drop white space, and never join text across it or a letter with a mark.
    """

    def __init__(self, told: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(told)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.closes = np.array([(self.tokenizer.id_to_token(k) or "").endswith("</w>") for k in range(self.tokenizer.get_vocab_size())])
        self._forget()

    def _forget(self) -> None:
        #: Hashes of the pieces known, sorted, and each one's number; 16 bytes for a piece where a dictionary takes 180.
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.values, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _asked(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces on end, and their lengths."""
        lists = [x.ids for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.fromiter((i for x in lists for i in x), np.uint32), np.fromiter(map(len, lists), np.int64, len(lists))

    def _asked_together(self, pieces: list[str], parts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The same, asked as one text, for pieces of letters (1 part), some with a mark behind (2): an id ends each part."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, dtype=np.uint32)
        ends, last = np.flatnonzero(self.closes[ids]) + 1, np.cumsum(parts) - 1
        if len(ends) != last[-1] + 1 or len(ids) != ends[-1]:
            return self._asked(pieces)
        return ids, np.diff(ends[last], prepend=0)

    def _learn(self, new: list[bytes], hashes: np.ndarray) -> None:
        texts = [x.decode(errors="replace") for x in new]
        parts = [1 if x.isalpha() else 2 if x[-1] in ".,;:!?" and x[:-1].isalpha() else 0 for x in texts]
        plain = [k for k, n in enumerate(parts) if n]
        rest = [k for k, n in enumerate(parts) if not n]
        found = [self._asked([texts[k] for k in rest])]
        for low in range(0, len(plain), 2000):
            some = plain[low : low + 2000]
            found.append(self._asked_together([texts[k] for k in some], [parts[k] for k in some]))
        asked = np.array([*rest, *plain], dtype=np.int64)
        order = np.argsort(hashes[asked])
        at = np.searchsorted(self.hashes, hashes[asked][order])
        self.numbers = np.insert(self.numbers, at, len(self.lengths) + order)
        self.hashes = np.insert(self.hashes, at, hashes[asked][order])
        self.values = np.concatenate([self.values, *(x[0] for x in found)])
        self.lengths = np.concatenate([self.lengths, *(x[1] for x in found)])

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts on end, and the texts' offsets in them."""
        plain = b"<|" not in raw.tobytes()  # else a special token's text could come about
        words, word_at = split_words(raw, at, lower=plain, marks=MARKS if plain else b"")
        if len(self.hashes) > KEPT_PIECES:
            self._forget()
        distinct = words.dictionary.to_pylist()
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
        at = np.searchsorted(self.hashes, hashes)
        found = np.append(self.hashes, np.uint64(0))[at] == hashes
        found[at == len(self.hashes)] = False
        if not found.all():
            new = np.flatnonzero(~found)
            self._learn([distinct[k] for k in new], hashes[new])
            at = np.searchsorted(self.hashes, hashes)
        rank = self.numbers[at]
        pick = rank[np.asarray(words.indices)] if len(words) else np.zeros(0, np.int64)
        ids, ends = ragged(self.values, np.concatenate([[0], np.cumsum(self.lengths)]), pick)
        return ids, ends[word_at]


_encoders: dict[str, PieceEncoder] = {}


def _encoder(told: str) -> PieceEncoder:
    if told not in _encoders:
        _encoders.clear()
        _encoders[told] = PieceEncoder(told)
    return _encoders[told]


def write_files(documents: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 2, planes: int = 4) -> str:
    """Encodes ``documents`` (doc_id, text), ends each with ``end_id`` and writes files in ascending doc_id order.

    One range shuffle by doc_id; each task then streams through its sorted rows and emits a file whenever
    ``FILE_IDS`` ids have come, so its memory doesn't depend on the input. Returns the files' table.
    """
    spark = documents.sparkSession
    path = path or shared_folder(spark)
    told = spark.sparkContext.broadcast(specification(tokenizer))

    @task("token_files", _encoders.clear)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, part, begun = _encoder(told.value), TaskContext.get().partitionId(), 0
        keys: list = []
        lengths: list[int] = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            columns = [[part], [begun], [keys], [lengths], [pack(np.concatenate(held), planes=planes)]]
            types = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=["part", "part_start", "doc_ids", "n_tokens", "payload"])

        for whole in batches:
            for batch in slices(whole, "text"):
                ids, at = machine.encode(*text_bytes(batch.column("text")))
                n = np.diff(at) + 1
                keys += batch.column("doc_id").to_pylist()
                lengths += n.tolist()
                held.append(np.insert(ids, at[1:], end_id))
                size += int(n.sum())
                if size >= FILE_IDS:
                    yield flush()
                    begun, keys, lengths, held, size = begun + size, [], [], [], 0
        if keys:
            yield flush()

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = lean(documents.select("doc_id", "text")).repartitionByRange(tasks, "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(run, FILES).write.option("compression", "none").parquet(path)
    return path


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian
    unsigned 32-bit). What goes to the driver is a sum for each written partition."""
    files = spark.read.schema(FILES).parquet(path)
    sums = files.groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect()
    before, total = {}, 0
    for part, n in sorted(tuple(x) for x in sums):
        before[part], total = total, total + n
    told = spark.sparkContext.broadcast(before)

    @task("token_files", _encoders.clear)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ends = np.concatenate([[0], np.cumsum(row["n_tokens"])]).astype(np.int64)
                raw = unpack(row["payload"]).astype("<u4").tobytes()
                ids = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(ends[:-1] + told.value[row["part"]] + row["part_start"]), pa.array(row["n_tokens"], pa.int64()), ids], names=["doc_id", "start", "n_tokens", "ids"])

    return files.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def stored(documents: DataFrame, tokenizer: str) -> DataFrame:
    """Writes the files, reads them back, and returns each document's place, length and checksum."""
    path = write_files(documents, tokenizer)
    return read_files(documents.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
