"""Stateful streams over the driver's tables; each is drained and equal to its batch twin."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from quarry.functions.durable import shared_top
from quarry.plans.queries import query
from quarry.sources import bindings as b
from quarry.streaming import state
from quarry.streaming import usage as st

#: A time behind all events, by which the streams' ends are told.
_END = datetime(2100, 1, 1)


def _folder(spark) -> str:
    return f"{shared_top(spark)}/quarry-stream-{uuid.uuid4().hex}"


@query("""SELECT concat('doc_', doc_id) AS file_path, 1::BIGINT AS "order", 1::BIGINT AS version FROM documents
 UNION ALL SELECT concat('doc_', doc_id), 2, 2 FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 = 0 UNION ALL SELECT concat('new_', doc_id), 2, 1 FROM documents WHERE doc_id % 11 = 0
 UNION ALL SELECT concat('doc_', doc_id), 3, CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 = 0 THEN 3 ELSE 2 END FROM documents WHERE doc_id % 35 IN (0, 7)""")
def stream_changed_files(spark, d):
    """All documents seen first; then four fifths of them again, every seventh one changed, beside new ones; then, by a
    stream that is started anew, some changed once more."""
    folder, docs = _folder(spark), b.table(spark, d, "documents")
    path = F.concat(F.lit("doc_"), "doc_id").alias("file_path")
    changed = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text"))
    rounds = [
        docs.select(path, F.col("text").alias("content"), F.lit(1).alias("order")),
        docs.where("doc_id % 5 <> 0").select(path, changed.alias("content"), F.lit(2).alias("order")).union(docs.where("doc_id % 11 = 0").select(F.concat(F.lit("new_"), "doc_id"), "text", F.lit(2))),
        docs.where("doc_id % 35 in (0, 7)").select(path, F.concat("text", F.lit(" again")).alias("content"), F.lit(3).alias("order")),
    ]
    for files in rounds:
        files.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rounds[0].schema).parquet(f"{folder}/in")
        with state.stateful(spark):
            out = st.drained(state.changed_files(stream), f"{folder}/run")
    return out


@query("""SELECT event_id, key, requests, used_tokens, requests > 4 OR used_tokens > 150 AS over FROM (SELECT event_id, key, count(*) OVER w AS requests, (sum(tokens) OVER w)::BIGINT AS used_tokens FROM (SELECT event_id, user_id AS key, ts, floor(value)::BIGINT AS tokens FROM events) WINDOW w AS (PARTITION BY key ORDER BY ts RANGE BETWEEN INTERVAL 86399999999 MICROSECONDS PRECEDING AND CURRENT ROW))""")
def stream_limiter(spark, d):
    """Each event's requests and tokens in its key's last day, told in the order of time."""
    folder = _folder(spark)
    events = st.read_events(spark, f"{d}/events.parquet").select("key", "event_id", "ts", "tokens")
    told = state.limited(state.beat(events, f"{folder}/end", key=-1, ts=_END), 86400, 4, 150)
    with state.stateful(spark):
        out = st.drained(told, f"{folder}/run")
    return out.where("key >= 0").select("event_id", "key", "requests", "used_tokens", "over")


@query("""SELECT f.event_id AS finding_id, f.user_id AS key, v.event_id AS verdict, v.ts AS judged_at FROM (FROM events WHERE event_type = 'error') f LEFT JOIN (FROM events WHERE event_type IN ('click', 'view')) v ON f.user_id = v.user_id AND v.ts >= f.ts AND v.ts <= f.ts + INTERVAL 6 HOURS""")
def stream_verdicts(spark, d):
    """Errors with the clicks and views of their user in the next six hours, and errors that none follows."""
    folder, path = _folder(spark), f"{d}/events.parquet"
    findings = st.read_events(spark, path).where("kind = 'error'").select("key", F.col("event_id").alias("finding_id"), F.col("ts").alias("found_at"))
    verdicts = st.read_events(spark, path).where("kind in ('click', 'view')").select("key", F.col("event_id").alias("verdict"), F.col("ts").alias("judged_at"))
    ends = [state.beat(findings, f"{folder}/f", key=-1, found_at=_END), state.beat(verdicts, f"{folder}/v", key=-2, judged_at=_END)]
    out = st.drained(state.judged(*ends, "6 HOURS"), f"{folder}/run")
    return out.where("key >= 0").select("finding_id", "key", "verdict", F.col("judged_at").cast("timestamp_ntz").alias("judged_at"))
