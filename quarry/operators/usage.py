"""Metering: rates in a trailing window, hit rates, histograms, last values, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of latency buckets, in seconds; the last bucket has none.
BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]


def trailing_rate(events: DataFrame, seconds: int = 60, spread: int = 64) -> DataFrame:
    """``events`` with requests and used_tokens of the same key in the last ``seconds``, the row itself included.

    Windows run within a key and a stretch of ``spread`` times ``seconds``, so a busy key's events are dealt over many
    tasks; events in the last ``seconds`` of a stretch are lent to the next one, a share of 1 / ``spread``.
    """
    span = seconds * 1_000_000
    wide = span * spread
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    told = events.withColumn("_at", at).withColumn("_b", F.floor(F.col("_at") / wide))
    own, lent = F.struct(F.col("_b").alias("_stretch"), F.lit(False).alias("_lent")), F.struct((F.col("_b") + 1).alias("_stretch"), F.lit(True).alias("_lent"))
    late = (F.col("_b") + 1) * wide - F.col("_at") < span
    dealt = told.select(*events.columns, "_at", F.inline(F.when(late, F.array(own, lent)).otherwise(F.array(own))))
    within = Window.partitionBy("key", "_stretch").orderBy("_at").rangeBetween(-(span - 1), 0)
    out = dealt.withColumns({"requests": F.count("*").over(within), "used_tokens": F.sum("tokens").over(within)})
    return out.where("not _lent").drop("_at", "_stretch", "_lent")


def limited(events: DataFrame, seconds: int = 60, most_requests: int = 60, most_tokens: int = 50_000) -> DataFrame:
    """``trailing_rate`` with over: whether a limit is exceeded there."""
    return trailing_rate(events, seconds).withColumn("over", (F.col("requests") > most_requests) | (F.col("used_tokens") > most_tokens))


def hit_rate(events: DataFrame, by: str = "kind") -> DataFrame:
    return events.groupBy(by).agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), (F.count_if("hit") / F.greatest(F.count("*"), F.lit(1))).alias("hit_rate"))


def histogram(events: DataFrame, value: str, by: str, buckets: list[float] | None = None) -> DataFrame:
    """by, le, n: cumulative counts of values up to each bound; the last bound is infinity (as text ``+Inf``)."""
    bounds = BUCKETS if buckets is None else buckets
    counts = [F.count_if(F.col(value) <= b) for b in bounds] + [F.count(value)]
    names = [str(b) for b in bounds] + ["+Inf"]
    told = events.groupBy(by).agg(F.array(*[F.struct(F.lit(name).alias("le"), n.alias("n")) for name, n in zip(names, counts, strict=True)]).alias("b"))
    return told.select(by, F.inline("b"))


def last_value(events: DataFrame, by: str, value: str = "value", order: str = "event_id") -> DataFrame:
    return events.groupBy(by).agg(F.max_by(value, F.struct("ts", order)).alias("last_value"))


def profile(events: DataFrame, by: str, value: str = "value") -> DataFrame:
    return events.groupBy(by).agg(F.count("*").alias("runs"), F.avg(value).alias("avg_value"), F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.sum("tokens").alias("total_tokens"))


def usage_stats(events: DataFrame, seconds: int = 60) -> DataFrame:
    """key, recent_requests, recent_tokens (in the last ``seconds`` before the key's newest event), requests, tokens."""
    newest = events.groupBy("key").agg(F.max("ts").alias("newest"))
    recent = F.unix_micros(F.col("newest").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) < seconds * 1_000_000
    told = events.join(newest, "key")
    return told.groupBy("key").agg(F.count_if(recent).alias("recent_requests"), F.sum(F.when(recent, F.col("tokens")).otherwise(0)).alias("recent_tokens"), F.count("*").alias("requests"), F.sum("tokens").alias("total_tokens"))


def recent_errors(errors: DataFrame, by: str, order: list[str], kept: int = 100, shown: int = 10) -> DataFrame:
    """The last ``kept`` errors of each ``by``, with rank (1: the last) and whether a report shows it. Ranked below a
    limit for each group, which tasks apply before the shuffle, so a hot group never gathers."""
    w = Window.partitionBy(by).orderBy(*[F.desc(x) for x in order])
    return errors.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= kept).withColumn("shown", F.col("rank") <= shown)


def cache_state(accesses: DataFrame, most: int, ttl: int) -> DataFrame:
    """key, rank, tier: what a cache of ``most`` entries holds after these accesses (key, ts, stored: whether it wrote).

    Entries last written over ``ttl`` seconds before the last access of all are gone, and so are keys never written. The
    others rank by their last access (ties to the smaller key): a quarter of ``most`` in tier ``first``, the rest of
    ``most`` in ``second``. Partial aggregates, then a bounded top-k: ``most`` rows are ranked in one task.
    """
    at = lambda x: F.unix_micros(x.cast("timestamp"))
    told = accesses.groupBy("key").agg(F.max(at(F.col("ts"))).alias("used"), F.max(F.when(F.col("stored"), at(F.col("ts")))).alias("written"))
    now = accesses.agg(F.max(at(F.col("ts"))).alias("now"))
    alive = told.crossJoin(F.broadcast(now)).where(F.col("now") - F.col("written") <= ttl * 1_000_000)
    keys = [F.desc("used"), F.asc("key")]
    top = alive.orderBy(*keys).limit(most).withColumn("rank", F.row_number().over(Window.orderBy(*keys)))
    return top.select("key", "rank", F.when(F.col("rank") <= most // 4, "first").otherwise("second").alias("tier"))
