"""What the operators share: written tables in the shared folder, hold-out remainders, word splitting in numpy."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``[\x20\x09-\x0D]``: the white space that separates words.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, removed when the session's JVM ends. Where the setting is unset, a
    temporary folder serves a local session (as in tests); on a cluster that is an error."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-"))
        top = spark.sparkContext.getCheckpointDir()
    folder = f"{top.rstrip('/')}/quarry-{uuid.uuid4().hex}"
    where, files = _files(spark, folder)
    files.mkdirs(where)
    files.deleteOnExit(where)
    return f"{folder}/table"


def _files(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def removed(df: DataFrame) -> None:
    """Removes the table that ``written`` made; nothing may read it any more."""
    where, files = _files(df.sparkSession, df._quarry_path)
    files.delete(where, True)


def written(df: DataFrame) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it back, which cuts its lineage."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out


_caches: dict[str, Callable[[], None]] = {}


def _give_back() -> None:
    """Returns what is free in this process to the system; large arrays are to be returned as soon as they are freed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        library = ctypes.CDLL(None)
        library.mallopt(-3, 8 << 20)  # M_MMAP_THRESHOLD
        library.malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU C library
        pass


def task(owner: str, clear: Callable[[], None] | None = None) -> Callable:
    """For a function over a task's batches: Spark's Python workers live on, so it first drops what other operators left
    in this one, and at the end gives memory back. ``clear`` drops what ``owner`` itself keeps for its next tasks."""

    def around(run: Callable) -> Callable:
        def settled(batches):
            for name in [x for x in _caches if x != owner]:
                _caches.pop(name)()
            if clear is not None:
                _caches[owner] = clear
            _give_back()
            try:
                yield from run(batches)
            finally:
                _give_back()

        return settled

    return around


def lean(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``, and from now on at most ``rows`` rows in an Arrow batch of its session: texts may be long."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, str(rows))
    return df


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts on end and the n + 1 offsets of the texts in them; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at - at[0]


def split_words(raw: np.ndarray, at: np.ndarray, lower: bool = True, marks: bytes = b"") -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words of texts on end, dictionary-encoded, and the n + 1 offsets of the texts' words.

    ``marks``: bytes whose run at the end of a word, after an ASCII letter, is a word of its own.
    """
    space = _SPACE[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[at] = True
    before = np.empty(len(raw), dtype=bool)
    if len(raw):
        before[0] = True
        before[1:] = space[:-1]
    start = ~space & (before | edge[:-1])
    after = np.empty(len(raw), dtype=bool)
    if len(raw):
        after[-1] = True
        after[:-1] = space[1:]
    end = ~space & (after | edge[1:])
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    if marks and len(starts):
        table = np.zeros(256, dtype=bool)
        table[np.frombuffer(marks, np.uint8)] = True
        letter = (_LOWER[raw] >= 0x61) & (_LOWER[raw] <= 0x7A)
        # each word's last byte that is no mark
        last = np.maximum.accumulate(np.where(table[raw], np.int32(-1), np.arange(len(raw), dtype=np.int32)))[ends - 1]
        cut = last[(last >= starts) & (last < ends - 1) & letter[last]] + 1
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    kept = raw[~space]
    if lower:
        kept = _LOWER[kept]
    offsets = np.zeros(len(starts) + 1, dtype=np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(kept))])
    return words.dictionary_encode(), np.searchsorted(starts, at)


def ragged(values: np.ndarray, offsets: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``pick`` of a ragged array, on end, and their offsets."""
    sizes = (offsets[1:] - offsets[:-1])[pick]
    at = np.zeros(len(pick) + 1, dtype=np.int64)
    np.cumsum(sizes, out=at[1:])
    index = np.arange(at[-1], dtype=np.int64)
    index += np.repeat(offsets[:-1][pick] - at[:-1], sizes)
    return values[index], at


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> list[pa.RecordBatch]:
    """Runs of rows whose texts in ``column`` hold about ``limit`` bytes at most (a longer text stands alone)."""
    _, at = text_bytes(batch.column(column))
    out, low = [], 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(at, at[low] + limit, side="right")) - 1)
        out.append(batch.slice(low, high - low))
        low = high
    return out


def squeeze(values: np.ndarray) -> bytes:
    """An integer or byte array as zstandard over its byte planes."""
    if values.itemsize > 1:
        values = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def spread(data: bytes, dtype: type = np.uint8) -> np.ndarray:
    """The array of ``squeeze``."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    return raw if size == 1 else np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (SplitMix64's finaliser)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
