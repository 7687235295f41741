"""Streams with a state of their own: files that changed, exact rates in a trailing window, findings with their verdicts.

State lies in the checkpoint (RocksDB), by key, so a restart goes on where the last run ended and executors may be lost.
``changed_files`` and ``limited`` are stateful operators in Python: start their streams within ``stateful``. Each key with
news in a batch costs some calls to the state store, so they suit many rows for each key and batch, or few keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    """Streams started within it have the state store that stateful operators in Python need; the setting is put back."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before)


#: Buckets of paths, a number that a checkpoint fixes: a batch calls the state store for each bucket with news, not each path.
BUCKETS = 4096


class _LastHash(StatefulProcessor):
    """Keeps the hash and version of the last content of each path of a bucket, as one table in Arrow's format; lets a version
    through whose hash differs from the one before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "known binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seen = pd.concat([x[["file_path", "order", "hash"]] for x in rows])
        seen = seen.sort_values(["file_path", "order"], kind="stable", ignore_index=True)
        first = ~seen["file_path"].duplicated()
        known = None
        before, base = pd.Series(0, seen.index, dtype="int64"), pd.Series(0, seen.index, dtype="int64")
        if self._last.exists():
            with pa.ipc.open_stream(self._last.get()[0]) as stream:
                known = stream.read_pandas().set_index("file_path")
            at = known.index.get_indexer(seen["file_path"])
            there = at >= 0
            before[there], base[there] = known["hash"].to_numpy()[at[there]], known["version"].to_numpy()[at[there]]
        last = seen["hash"].shift(fill_value=0).where(~first, before)
        new = (seen["hash"] != last) | (first & (base == 0))
        seen["version"] = base + new.astype("int64").groupby(seen["file_path"]).cumsum()
        out = seen[new]
        if len(out):
            kept = seen.loc[~seen["file_path"].duplicated(keep="last"), ["file_path", "hash", "version"]]
            if known is not None:
                kept = pd.concat([known[~known.index.isin(kept["file_path"])].reset_index(), kept], ignore_index=True)
            sink = pa.BufferOutputStream()
            table = pa.Table.from_pandas(kept, preserve_index=False)
            with pa.ipc.new_stream(sink, table.schema) as stream:
                stream.write_table(table)
            self._last.update((sink.getvalue().to_pybytes(),))
            yield out[["file_path", "order", "version"]]

    def close(self) -> None:
        pass


def changed_files(files: DataFrame) -> DataFrame:
    """file_path, order, version (1: new, then one more for each change) of each version of a file whose content differs
    from the version before; ``files``: a stream of file_path, content and order, a number that grows with time.

    Contents are compared by 64-bit hash, taken in the JVM: neither texts nor old versions are kept or sent to Python. A
    null content is a version like others; rows without a path are left out. Versions of one batch are taken by order.
    State is kept by ``BUCKETS`` buckets of paths; a bucket's is read and written whole where one of its files changes.
    """
    hashed = files.where("file_path is not null").select(F.pmod(F.xxhash64("file_path"), F.lit(BUCKETS)).alias("bucket"), "file_path", F.col("order").cast("long").alias("order"), F.xxhash64("content").alias("hash"))
    return hashed.groupBy("bucket").transformWithStateInPandas(_LastHash(), outputStructType="file_path string, order long, version long", outputMode="Append", timeMode="None")


#: Stands for a null id in pandas, where a null would turn the others into floats.
_NONE = -(2**63)


class _Trailing(StatefulProcessor):
    """Holds a key's rows until the watermark has passed them, then tells each one's window in the order of time."""

    def __init__(self, micros: int, most_requests: int, most_tokens: int):
        self._micros, self._most_requests, self._most_tokens = micros, most_requests, most_tokens

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", "at long, event_id long, tokens long")
        self._recent = handle.getListState("recent", "at long, tokens long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [x for part in rows for x in zip(part["at"].tolist(), part["event_id"].tolist(), part["tokens"].tolist(), strict=True)]
        self._waiting.appendList(new)
        # a row is told at the first watermark that reaches it: then no row of its time can come
        self._handle.registerTimer(-(-min(new)[0] // 1000))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(x) for x in self._waiting.get())
        due = [x for x in waiting if x[0] <= passed]
        later = waiting[len(due) :]
        if later:
            self._handle.registerTimer(-(-later[0][0] // 1000))
        if not due:  # an earlier timer of this batch has told them
            return
        recent = [tuple(x) for x in self._recent.get()]
        out, low, total, k = [], 0, sum(t for _, t in recent), 0
        while k < len(due):
            at, end = due[k][0], k
            while end < len(due) and due[end][0] == at:  # rows of one time count together
                recent.append((at, due[end][2]))
                total += due[end][2]
                end += 1
            while recent[low][0] <= at - self._micros:
                total -= recent[low][1]
                low += 1
            n = len(recent) - low
            out += [(key[0], x[1], at, n, total, n > self._most_requests or total > self._most_tokens) for x in due[k:end]]
            k = end
        self._recent.put(recent[low:])
        self._waiting.put(later) if later else self._waiting.clear()
        yield pd.DataFrame(out, columns=["key", "event_id", "at", "requests", "used_tokens", "over"])

    def close(self) -> None:
        pass


def limited(events: DataFrame, seconds: int = 60, most_requests: int = 60, most_tokens: int = 50_000, late: str = "10 minutes") -> DataFrame:
    """key, event_id, ts, requests, used_tokens of the key in the last ``seconds``, the row and those of its time included,
    and over, whether a limit is exceeded: what ``operators.usage.limited`` tells, on a stream of key, event_id, ts, tokens.

    A row is told once the watermark has passed it, so rows that come out of order by up to ``late`` count in their place.
    Rows behind the watermark are dropped and count nowhere. Null tokens count as none, rows without key or time are left
    out. State of a key: its rows of the last ``seconds`` and those not told yet.
    """
    none = F.lit(_NONE)
    told = events.where("key is not null and ts is not null").withWatermark("ts", late)
    told = told.select("key", F.coalesce(F.col("event_id").cast("long"), none).alias("event_id"), "ts", F.unix_micros("ts").alias("at"), F.coalesce(F.col("tokens"), F.lit(0)).cast("long").alias("tokens"))
    schema = f"key {dict(told.dtypes)['key']}, event_id long, at long, requests long, used_tokens long, over boolean"
    out = told.groupBy("key").transformWithStateInPandas(_Trailing(seconds * 1_000_000, most_requests, most_tokens), outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return out.select("key", F.nullif("event_id", none).alias("event_id"), F.timestamp_micros("at").alias("ts"), "requests", "used_tokens", "over")


def judged(findings: DataFrame, verdicts: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Findings (key, finding_id, found_at) with the verdicts on their key (key, verdict, judged_at) that come at most
    ``within`` later; a finding without one has nulls, and comes out once the watermark shows that none can follow.

    Rows of either stream behind its watermark are dropped. Both sides are kept in state only as long as they may match.
    A null key matches none; such a finding comes out alone.
    """
    f, v = findings.withWatermark("found_at", late).alias("f"), verdicts.withWatermark("judged_at", late).alias("v")
    near = F.expr(f"f.key = v.key AND judged_at >= found_at AND judged_at <= found_at + INTERVAL {within}")
    return f.join(v, near, "left_outer").select("f.key", "finding_id", "found_at", "verdict", "judged_at")


def beat(like: DataFrame, path: str, **values) -> DataFrame:
    """A stream with the rows of ``like`` and one more row of these ``values`` (nulls elsewhere), written below ``path``: of a
    time far ahead it moves the watermark, which lets go of all that waits. Its key must not be null, as rows without a key
    are taken out before they are seen."""
    spark = like.sparkSession
    row = spark.range(1).select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in like.schema])
    row.write.parquet(path)
    return like.unionByName(spark.readStream.schema(like.schema).parquet(path))
