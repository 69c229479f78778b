"""Extractive answers with a decision envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.functions.lexicon import ANSWER_REFERENCE, ANSWER_REJECTED, GUIDE, INSTRUCTION, STEP
from foliospark.operators.retrieve import schema_like

STALE_MINUTES = 1440
#: status -> (uncertainty, flag, next step); the last is our own wording.
DECISIONS = {
    "insufficient_sources": ("insufficient_evidence", "abstained", "Widen the sources or rephrase the question."),
    "stale_sources": ("stale_evidence", "stale_source_block", "Sync the cited sources, then ask again."),
    "conflict_detected": ("conflicting_sources", "manual_review_recommended", "Compare the cited sources by hand."),
    "unsafe_content": ("untrusted_source_content", "prompt_injection_block", "Have the cited pages reviewed."),
    "policy_blocked": ("tenant_policy_restriction", "policy_blocked", "Ask for access to the sources."),
    "grounded": (None, None, "Follow the cited sources."),
}
_word = lambda p: rf"(?i){T.LEFT}(?:{p}){T.RIGHT}"


def segments(text: Column) -> Column:
    """Lines and sentences with blanks collapsed; empty ones dropped."""
    parts = F.split(text, r"\r?\n|(?<=[.!?])\s+", -1)
    return F.filter(F.transform(parts, lambda p: T.trim_ws(T.sub(p, rf"{T.WS}+", " "))), lambda p: p != "")


def line_score(line: Column, terms: Column, phrases: Column) -> Column:
    low = F.lower(line)
    count = lambda needles: F.size(F.filter(needles, lambda n: F.contains(low, n)))
    bonus = lambda c, x: F.when(c, x).otherwise(0.0)
    score = (
        count(terms) / F.greatest(F.size(terms), F.lit(1))
        + count(phrases) * 0.3
        + bonus(line.rlike("/[a-z0-9_/-]+"), 0.1)
        + bonus(line.rlike(_word(INSTRUCTION)), 0.1)
        + bonus(line.rlike(r"^(\d+\.|-)\s+") | line.rlike(_word(STEP)), 0.08)
    )
    refused = (F.length(line) < 25) | (F.length(line) > 280) | schema_like(line) | low.rlike(_word(ANSWER_REJECTED))
    return F.when(refused, 0.0).otherwise(score)


def result_score(acts: Column, heading: Column, title: Column, url: Column) -> Column:
    context = F.lower(F.concat(F.coalesce(heading, F.lit("")), F.lit(" "), title, F.lit(" "), url))
    bonus = lambda p, x: F.when(context.rlike(_word(p)), x).otherwise(0.0)
    return F.when(acts, bonus(GUIDE, 0.35) - bonus(ANSWER_REFERENCE, 0.25)).otherwise(0.0)


def answer_lines(results: DataFrame) -> DataFrame:
    """Scored segments of the first three results of each query."""
    top = results.where("rank <= 3").select(
        "query_id", "rank", "terms", "phrases",
        result_score(F.col("acts"), F.col("heading_path"), F.col("title"), F.col("url")).alias("context_score"),
        F.posexplode(segments(F.col("text"))).alias("pos", "line"),
    )
    score = line_score(F.col("line"), F.col("terms"), F.col("phrases")) + F.col("context_score")
    return top.select("query_id", "rank", "pos", "line", F.round(score, 6).alias("line_score")).where("line_score > 0")


def pick_lines(lines: DataFrame, budget: int = 900, most: int = 4) -> DataFrame:
    """Greedy choice by score: repeats and what overruns the budget are skipped; at most ``most`` lines."""
    item = F.struct((-F.col("line_score")).alias("s"), "rank", "pos", "line")
    grouped = lines.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("chosen"), F.lit(0).alias("total"))

    def step(acc: Column, x: Column) -> Column:
        size = acc["total"] + F.length(x["line"]) + F.when(F.size(acc["chosen"]) > 0, 1).otherwise(0)
        known = F.exists(acc["chosen"], lambda c: F.lower(c) == F.lower(x["line"]))
        take = (F.size(acc["chosen"]) < most) & ~known & (size <= budget)
        return F.struct(
            F.when(take, F.concat(acc["chosen"], F.array(x["line"]))).otherwise(acc["chosen"]).alias("chosen"),
            F.when(take, size).otherwise(acc["total"]).alias("total"),
        )

    return grouped.select("query_id", F.array_join(F.aggregate("items", start, step, lambda a: a["chosen"]), "\n").alias("answer"))


def concise_answers(queries: DataFrame, results: DataFrame) -> DataFrame:
    """An answer for every query: chosen lines, else the first result's text, else empty."""
    picked = pick_lines(answer_lines(results))
    first = results.where("rank = 1").select("query_id", F.col("text").alias("first"))
    both = queries.select("query_id").join(picked, "query_id", "left").join(first, "query_id", "left")
    return both.select("query_id", F.coalesce(F.nullif("answer", F.lit("")), "first", F.lit("")).alias("answer"))


def verdicts(queries: DataFrame, results: DataFrame, as_of: Column, blocked: DataFrame | None = None) -> DataFrame:
    """Status, age, conflict and confidence of every query, from one grouping of its few results.

    ``blocked`` lists queries (query_id) whose tenant has no permitted source.
    """
    minutes_old = F.greatest(
        F.lit(0),
        F.round((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("last_changed_at").cast("timestamp"))) / 6e7),
    ).cast("long")
    risky = F.size(T.injection_signals(F.col("text"))) > 0
    seen = results.select(
        "query_id", F.struct("rank", "score", "source_id", minutes_old.alias("age"), risky.alias("risky")).alias("r")
    )
    grouped = seen.groupBy("query_id").agg(F.sort_array(F.collect_list("r")).alias("all"))  # at most top_k each
    safe = F.filter("all", lambda r: ~r["risky"])
    used = grouped.select("query_id", "all", F.when(F.size(safe) > 0, safe).otherwise(F.col("all")).alias("used"))
    score = lambda k: F.get("used", k)["score"]
    per_query = used.select(
        "query_id", F.size("used").alias("citations"),
        F.array_max(F.transform("used", lambda r: r["age"])).alias("age"),
        F.size(F.array_distinct(F.transform("used", lambda r: r["source_id"]))).alias("sources"),
        score(0).alias("first"), score(1).alias("second"),
        F.get("used", 0)["risky"].alias("unsafe"), F.exists("all", lambda r: r["risky"]).alias("any_risky"),
    )
    all_ = queries.select("query_id").join(per_query, "query_id", "left")
    if blocked is not None:
        all_ = all_.join(blocked.select("query_id", F.lit(True).alias("denied")), "query_id", "left")
    else:
        all_ = all_.withColumn("denied", F.lit(None).cast("boolean"))
    conflict = F.coalesce(
        (F.col("sources") > 1) & (F.abs(F.col("first") - F.col("second")) <= 0.15) & ~F.col("unsafe"), F.lit(False)
    )
    status = (
        F.when(F.coalesce("denied", F.lit(False)), "policy_blocked")
        .when(F.coalesce("citations", F.lit(0)) == 0, "insufficient_sources")
        .when(F.col("unsafe"), "unsafe_content")
        .when(F.col("age") > STALE_MINUTES, "stale_sources")
        .when(conflict, "conflict_detected")
        .otherwise("grounded")
    )
    judged = all_.withColumn("status", status).withColumn("conflict", conflict)
    counted = F.col("status").isin("stale_sources", "conflict_detected", "grounded")
    minutes = F.when(counted, F.col("age")).otherwise(0).cast("long")
    return judged.select(
        "query_id",
        "status",
        minutes.alias("max_age_minutes"),
        "conflict",
        F.coalesce("any_risky", F.lit(False)).alias("injection_seen"),
        F.round(confidence(minutes, F.col("conflict") & counted, F.col("status")), 6).alias("confidence"),
        F.when(F.col("status").isin("policy_blocked", "insufficient_sources"), 0)
        .otherwise(F.coalesce("citations", F.lit(0))).cast("long").alias("citations"),
    )


def confidence(age: Column, conflict: Column, status: Column) -> Column:
    value = (
        0.92
        - F.least(age / 10000, F.lit(0.35))
        - F.when(conflict, 0.35).otherwise(0.0)
        - F.when(status != "grounded", 0.25).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def envelope(judged: DataFrame) -> DataFrame:
    """Adds uncertainty, flag, next step and warnings of each status."""

    def of(k: int) -> Column:
        out = F.lit(None).cast("string")
        for status, values in DECISIONS.items():
            out = F.when(F.col("status") == status, F.lit(values[k])).otherwise(out)
        return out

    s = F.col("status")
    warnings = F.array_compact(
        F.array(
            F.when(s.isin("policy_blocked", "insufficient_sources", "stale_sources", "conflict_detected"), s),
            F.when(F.col("injection_seen") & ~s.isin("policy_blocked", "insufficient_sources"), "prompt_injection_signals_detected"),
        )
    )
    return judged.select("*", of(0).alias("uncertainty"), of(1).alias("flag"), of(2).alias("next_step"), warnings.alias("warnings"))
