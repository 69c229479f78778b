"""Quality gates: retrieval, change classifier, documentation risk, memory kills in logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_HIT, MIN_MRR = 0.65, 0.5
BLOCKED = ("stale_sources", "unsafe_content", "conflict_detected", "policy_blocked")


def contains_ci(text: Column, part: Column) -> Column:
    """Case-insensitive containment; a null part always passes."""
    return part.isNull() | F.coalesce(F.contains(F.lower(text), F.lower(part)), F.lit(False))


def retrieval_quality(results: DataFrame, fixtures: DataFrame) -> DataFrame:
    """hit@k and mean reciprocal rank.

    ``fixtures``: query_id, max_rank and the expected source, url, title and text
    parts (null: any).  A rank beyond max_rank is no hit but counts in the mean.
    """
    both = fixtures.join(results, "query_id", "left")
    ok = (
        (F.col("want_source").isNull() | (F.col("source_id") == F.col("want_source")))
        & contains_ci(F.col("url"), F.col("want_url"))
        & contains_ci(F.col("title"), F.col("want_title"))
        & contains_ci(F.col("text"), F.col("want_text"))
    )
    first = both.groupBy("query_id").agg(F.min(F.when(ok, F.col("rank"))).alias("first"), F.first("max_rank").alias("max_rank"))
    hit = F.coalesce((F.col("first") <= F.col("max_rank")).cast("int"), F.lit(0))
    return first.agg(
        F.count(F.lit(1)).alias("fixtures"),
        F.coalesce(F.round(F.avg(hit), 4), F.lit(0.0)).alias("hit_at_k"),
        F.coalesce(F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 4), F.lit(0.0)).alias("mrr"),
    )


def retrieval_gate(results: DataFrame, fixtures: DataFrame, freshness: DataFrame) -> DataFrame:
    """Quality over fixtures whose source is in use: synced once, not failing, last run not failed."""
    bad = freshness.where((F.col("health") == "failing") | (F.col("last_status") == "failed") | (F.col("lag_minutes") >= 1_000_000))
    used = fixtures.join(bad.select(F.col("source_id").alias("want_source")), "want_source", "left_anti")
    q = retrieval_quality(results, used)
    return q.withColumn("passed", (F.col("hit_at_k") >= MIN_HIT) & (F.col("mrr") >= MIN_MRR))


def accuracy(judged: DataFrame) -> DataFrame:
    """Share of rows whose got equals expected; 1 without rows."""
    right = (F.col("got") == F.col("expected")).cast("int")
    return judged.agg(
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.sum(right), F.lit(0)).cast("long").alias("correct"),
        F.coalesce(F.round(F.avg(right), 6), F.lit(1.0)).alias("accuracy"),
    )


def doc_gate(changes: DataFrame, decisions: DataFrame) -> DataFrame:
    """Fails on risky changes or blocked decisions."""
    risky = changes.agg(F.count_if((F.col("event_type") == "breaking_change") | (F.col("severity") == "critical")).alias("risky"))
    held = decisions.agg(F.count_if(F.col("status").isin(*BLOCKED)).alias("blocked"))
    return risky.join(F.broadcast(held)).withColumn("passed", (F.col("risky") == 0) & (F.col("blocked") == 0))


# Wording of log lines about processes killed for memory.
KILLS = r"(?i)oom|out of memory|Process appears to have been OOM killed|node killed"


def memory_kills(lines: DataFrame, as_of: Column, minutes: int = 30, least: int = 1) -> DataFrame:
    """Counts log lines (value) of killed processes in the last minutes; a line without a time counts as recent."""
    stamp = F.regexp_extract("value", r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})(?:\.\d+)?Z\s", 1)
    at = F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz")
    recent = at.isNull() | (at >= as_of - F.make_dt_interval(mins=F.lit(minutes)))
    return lines.agg(F.count_if(F.col("value").rlike(KILLS) & recent).alias("kills")).withColumn("alarm", F.col("kills") >= least)
