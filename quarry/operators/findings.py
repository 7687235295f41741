"""Operators on findings: filters, deduplication, counts, rankings, report order.

A finding row has file_path, start_line, end_line, source_tool, severity, vulnerability_type, confidence, description.
Every ranking takes the columns of a total order, so results don't depend on partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import maps
from quarry.functions.text import squeezed


def normalized_description(description: Column) -> Column:
    """Lower case, tool prefixes off (each once, in order), white space squeezed."""
    text = F.lower(description)
    for prefix in maps.PREFIXES:
        text = F.when(text.startswith(prefix), F.regexp_replace(F.substr(text, F.lit(len(prefix) + 1)), r"^\s+|\s+$", "")).otherwise(text)
    return squeezed(text)


def signed(path: str = "file_path", line: str = "start_line", kind: str = "vulnerability_type", description: str = "description") -> Column:
    """What findings of one flaw share: file, line, type and the start of the normalised description."""
    return F.concat_ws("|", path, F.col(line).cast("string"), kind, F.substring(normalized_description(F.col(description)), 1, 100))


def signature(path: str = "file_path", line: str = "start_line", kind: str = "vulnerability_type", description: str = "description") -> Column:
    """The hash of ``signed``."""
    return F.md5(signed(path, line, kind, description))


def included(df: DataFrame, least_confidence: float = 0.3, least_severity: str = "low", types: list[str] | None = None) -> DataFrame:
    """Findings of at least this confidence and severity, of these types if any are named. Nulls don't pass."""
    good = (F.col("confidence") >= least_confidence) & (maps.severity_ordinal(F.col("severity")) >= maps.SEVERITIES.index(least_severity))
    return df.where(good & F.col("vulnerability_type").isin(types) if types else good)


def valid_spans(df: DataFrame) -> DataFrame:
    return df.where(F.col("end_line").isNull() | (F.col("end_line") >= F.col("start_line")))


def high_severity(df: DataFrame) -> DataFrame:
    return df.where(F.col("severity").isin("critical", "high"))


def deduplicated(df: DataFrame, order: list[str], severity_order: str = "lexical", columns: list[str] | None = None) -> DataFrame:
    """One finding of each signature: the tool trusted most, then the greatest confidence, then severity, then ``order``.

    Adds n (findings merged), confidence raised by 0.1 for each other one (0.3 and 1.0 at most; confidence_level stays
    that of the survivor), and also_detected_by, the others' tools in rank order. ``severity_order``: ``lexical`` ranks
    severities as words, as reports have always done; ``ordinal`` by weight.

    Where findings have ``metadata`` (a map of texts), the survivor's gains an entry ``<tool>_metadata`` for each other
    tool, as JSON: that of the tool's last finding in rank order. Tools without a priority give no entry.

    One aggregate with map-side combining: the survivor is the least of a struct, and of the others only a count
    for each tool is kept, so neither a hot signature nor its sort ever meets in one task's memory. What is shuffled is
    ``columns`` of the survivors (all if not given; source_tool and confidence always stay) under the text that is hashed,
    of which neighbouring rows share much, while hashes can't be compressed; the hash is taken of each group behind it.
    """
    ranks = {x: k for k, x in enumerate(sorted(maps.SEVERITIES))} if severity_order == "lexical" else {x: k for k, x in enumerate(maps.SEVERITIES)}
    tool, level = F.lower("source_tool"), F.lower("severity")
    priority = maps.lookup(maps.TOOL_PRIORITY, tool, 0)
    rank = F.struct((-priority).alias("p"), (-F.coalesce("confidence", F.lit(-1.0))).alias("c"), (-maps.lookup(ranks, level, -1)).alias("s"), *order)
    keep = [x for x in df.columns if x not in order and (columns is None or x in {*columns, "source_tool", "confidence", "metadata"})]
    names = sorted(maps.TOOL_PRIORITY, key=lambda x: -maps.TOOL_PRIORITY[x])
    counts = [F.count_if(tool == x).alias(f"_{x}") for x in names]
    merged = "metadata" in df.columns
    if merged:
        ranked = {x: F.when(tool == x, rank) for x in names}
        counts += [F.max_by(F.to_json("metadata", {"ignoreNullFields": "false"}), ranked[x]).alias(f"_m_{x}") for x in names]
    best = df.groupBy(signed().alias("_k")).agg(F.min_by(F.struct(*keep), rank).alias("b"), F.count("*").alias("n"), *counts)
    others = F.concat(*[F.array_repeat(F.lit(x), (F.col(f"_{x}") - F.when(F.lower("b.source_tool") == x, 1).otherwise(0)).cast("int")) for x in names])
    boosted = F.least(F.lit(1.0), F.col("b.confidence") + F.least(0.1 * (F.col("n") - 1), F.lit(0.3)))
    if merged:
        # the last of the survivor's own tool is the survivor itself if it is the only one
        alone = {x: F.col(f"_{x}") - F.when(F.lower("b.source_tool") == x, 1).otherwise(0) == 0 for x in names}
        entries = F.filter(F.array(*[F.when(~alone[x], F.struct(F.lit(f"{x}_metadata").alias("k"), F.coalesce(f"_m_{x}", F.lit("{}")).alias("v"))) for x in names]), lambda e: e.isNotNull())
        own = F.coalesce("b.metadata", F.create_map().cast("map<string,string>"))
        theirs = F.map_from_entries(entries)
        kept = F.map_filter(own, lambda k, v: ~F.array_contains(F.map_keys(theirs), k))
        best = best.withColumn("b", F.col("b").withField("metadata", F.map_concat(kept, theirs)))
    out = best.select(F.md5("_k").alias("signature"), "b.*", "n", F.array_join(others, ", ").alias("also_detected_by"), boosted.alias("_boosted"))
    level_was = maps.confidence_level(F.col("confidence"))
    return out.withColumn("confidence_level", level_was).withColumn("confidence", F.col("_boosted")).drop("_boosted")


def counts_by_dimension(df: DataFrame) -> DataFrame:
    """dimension, value, n: findings by severity, by type and by tool, in one pass of grouping sets."""
    sets = df.groupingSets([["severity"], ["vulnerability_type"], ["source_tool"]], "severity", "vulnerability_type", "source_tool")
    told = sets.agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    name = F.when(F.col("g") == 3, "severity").when(F.col("g") == 5, "vulnerability_type").otherwise("source_tool")
    value = F.when(F.col("g") == 3, F.col("severity")).when(F.col("g") == 5, F.col("vulnerability_type")).otherwise(F.col("source_tool"))
    return told.select(name.alias("dimension"), value.alias("value"), "n")


def severity_dashboard(df: DataFrame) -> DataFrame:
    """One row: total, critical, high, medium, low."""
    return df.agg(F.count("*").alias("total"), *[F.count_if(F.col("severity") == x).alias(x) for x in ("critical", "high", "medium", "low")])


def status_gate(dashboard: DataFrame) -> DataFrame:
    """status and alert of a dashboard row: any critical or over 10 high fails; over 5 high or any critical alerts."""
    c, h = F.col("critical"), F.col("high")
    status = F.when((c > 0) | (h > 10), "failure").when(h > 0, "success_review").otherwise("success")
    return dashboard.select("critical", "high", status.alias("status"), ((c > 0) | (h > 5)).alias("alert"))


def top_types(df: DataFrame, k: int = 5) -> DataFrame:
    return df.groupBy("vulnerability_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "vulnerability_type").limit(k)


def report_order(df: DataFrame, order: list[str], k: int | None = None) -> DataFrame:
    """Findings as reports list them: severity from the worst down, confidence up, then ``order``."""
    out = df.orderBy(maps.severity_ordinal(F.col("severity")).desc(), F.col("confidence").asc(), *order)
    return out if k is None else out.limit(k)


def enrichment_candidates(df: DataFrame, order: list[str], most: int = 8, sure: float = 0.6, critical_first: bool = False) -> DataFrame:
    """The k findings worth a model's look, with rank; k is the count of findings of confidence ``sure``, ``most`` at most.

    Ranked by severity (high 2, medium 1, others 0, so critical comes last unless ``critical_first``), confidence,
    and whether the type is one of three injected kinds. Two passes, one a count, one a bounded top-k.
    """
    level = maps.lookup({"high": 2, "medium": 1} | ({"critical": 3} if critical_first else {}), F.col("severity"), 0)
    special = F.col("vulnerability_type").isin("command_injection", "sql_injection", "unsafe_deserialization").cast("int")
    keys = [level.desc(), F.desc("confidence"), special.desc(), *order]
    top = df.orderBy(*keys).limit(most).withColumn("rank", F.row_number().over(Window.orderBy(*keys)))  # of ``most`` rows
    return top.crossJoin(df.agg(F.least(F.count_if(F.col("confidence") >= sure), F.lit(most)).alias("k"))).where("rank <= k").drop("k")


def enriched(findings: DataFrame, verdicts: DataFrame, on: str, mode: str = "merge") -> DataFrame:
    """Findings with a model's verdicts (``on``, valid): confirmed ones gain 0.1 of confidence, 1.0 at most.

    ``merge``: each finding once. ``append``: findings as they are, and confirmed ones again with the gain.
    """
    gain = F.least(F.lit(1.0), F.col("confidence") + 0.1)
    if mode == "append":
        good = findings.join(verdicts.where("valid").select(on).distinct(), on, "left_semi").withColumn("confidence", gain)
        return findings.withColumn("validated", F.lit(False)).unionByName(good.withColumn("validated", F.lit(True)))
    told = findings.join(verdicts.groupBy(on).agg(F.bool_or("valid").alias("_valid")), on, "left")
    out = told.withColumn("validated", F.coalesce("_valid", F.lit(False)))
    return out.withColumn("confidence", F.when(F.col("validated"), gain).otherwise(F.col("confidence"))).drop("_valid")


def trend(before: DataFrame, after: DataFrame) -> DataFrame:
    """status, n: signatures new, resolved or persisting between two scans."""
    a, b = (x.select(signature().alias("signature")).distinct() for x in (before, after))
    both = a.withColumn("a", F.lit(True)).join(b.withColumn("b", F.lit(True)), "signature", "full_outer")
    status = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "resolved").otherwise("persisting")
    return both.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def union_tools(*outputs: DataFrame) -> DataFrame:
    """All tools' findings on end; columns that one lacks are null."""
    out = outputs[0]
    for more in outputs[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out
