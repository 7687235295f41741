"""Usage metering on streams: windows with watermarks, sessions, repeated events dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """A stream of the event files below ``path``: event_id, ts, key, kind, tokens."""
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"  # as a pattern, since a path must be a folder
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(pattern)
    return files.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("key"), F.col("event_type").alias("kind"), F.floor("value").cast("long").alias("tokens"))


def rate_windows(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, kind, requests, tokens of each tumbling window and kind."""
    told = events.withWatermark("ts", late).groupBy(F.window("ts", length), "kind").agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"))
    return told.select(F.col("window.start").alias("start"), "kind", "requests", "tokens")


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """key, start, end, requests of each stretch of a key's events without a pause of ``gap``."""
    told = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "key").agg(F.count("*").alias("requests"))
    return told.select("key", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "requests")


def distinct_events(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def drained(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all there is, its output as Parquet below ``path``, and reads it.

    Windows that the watermark hasn't closed are written only in ``complete`` mode, which replaces the output each time.
    """
    spark = stream.sparkSession
    writer = stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    if mode == "complete":
        query = writer.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{path}/out")).start()
    else:
        query = writer.outputMode(mode).format("parquet").option("path", f"{path}/out").start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
