"""How findings lie across chunks: clusters, associations, distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.maps import severity_ordinal, severity_weight


def clusters(findings: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """For each group: n, n_types, n_files, worst severity, mean confidence, and the primary finding's line (the greatest
    severity word, then confidence, as clusters have always ranked; ties by ``order``)."""
    worst = F.max_by("severity", severity_ordinal(F.col("severity")))
    primary = F.max_by("start_line", F.struct("severity", "confidence", *order))
    # files are counted apart, lest every group of type and file carries a finding's columns; the set of types lets the rest be
    # combined by hash, without a sort
    told = findings.groupBy(*by).agg(
        F.count("*").alias("n"), F.size(F.collect_set("vulnerability_type")).cast("long").alias("n_types"), worst.alias("severity"), F.avg("confidence").alias("avg_confidence"), primary.alias("primary_line"))
    files = findings.where("file_path is not null").select(*[F.col(x).alias(f"_{x}") for x in by], "file_path").distinct().groupBy(*[f"_{x}" for x in by]).agg(F.count("*").alias("n_files"))
    on = [F.col(x).eqNullSafe(F.col(f"_{x}")) for x in by]
    return told.join(files, on, "left").select(*by, "n", "n_types", F.coalesce("n_files", F.lit(0).cast("long")).alias("n_files"), "severity", "avg_confidence", "primary_line")


def associations(pairs: DataFrame, correlations: DataFrame | None = None) -> DataFrame:
    """chunk_id, total_findings, priority: weights times confidences, correlated ones (chunk_id, strength, confidence)
    at half; 1.0 at most."""
    direct = pairs.groupBy("chunk_id").agg(F.count("*").alias("total_findings"), F.sum(severity_weight(F.col("severity")) * F.col("confidence")).alias("direct"))
    if correlations is None:
        return direct.select("chunk_id", "total_findings", F.least("direct", F.lit(1.0)).alias("priority"))
    other = correlations.groupBy("chunk_id").agg(F.sum(F.col("strength") * F.col("confidence") * 0.5).alias("other"))
    both = direct.join(other, "chunk_id", "full_outer")
    total = F.coalesce("direct", F.lit(0.0)) + F.coalesce("other", F.lit(0.0))
    return both.select("chunk_id", F.coalesce("total_findings", F.lit(0)).alias("total_findings"), F.least(total, F.lit(1.0)).alias("priority"))


def distribution(chunks: DataFrame, told: DataFrame) -> DataFrame:
    """One row over all chunks (chunk_id): how many have findings, coverage in percent, findings a chunk, priorities."""
    both = chunks.select("chunk_id").join(told, "chunk_id", "left")
    n = F.count("*")
    some = F.count_if(F.col("total_findings") > 0)
    total = F.coalesce(F.sum("total_findings"), F.lit(0))
    p = F.coalesce("priority", F.lit(0.0))
    return both.agg(
        n.alias("total_chunks"), some.alias("chunks_with_findings"), total.alias("total_findings"),
        F.when(n == 0, 0.0).otherwise(some / n * 100).alias("coverage_percentage"), F.when(n == 0, 0.0).otherwise(total / n).alias("density"),
        F.count_if(p >= 0.8).alias("high_priority"), F.count_if((p >= 0.5) & (p < 0.8)).alias("medium_priority"), F.count_if(p < 0.5).alias("low_priority"),
    )


def project_rollup(chunks: DataFrame, by: str) -> DataFrame:
    """by, n_chunks, n_files, tokens, lines, average_tokens, valid_share (blank chunks are invalid)."""
    valid = F.avg((~F.col("content").rlike(r"^\s*$")).cast("double"))
    return chunks.groupBy(by).agg(
        F.count("*").alias("n_chunks"), F.count_distinct("file_path").alias("n_files"), F.sum("token_count").alias("tokens"), F.sum("line_count").alias("lines"),
        (F.sum("token_count") / F.greatest(F.count("*"), F.lit(1))).alias("average_tokens"), F.coalesce(valid, F.lit(1.0)).alias("valid_share"),
    )
