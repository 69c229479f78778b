"""Operational analytics: freshness, change feed, alerts, telemetry, audit, policy."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.functions.lexicon import CHANGE_SENSITIVE, HIGH_STAKES, HOW_TO, SEVERITY

NEVER = 1_000_000


@dataclass(frozen=True)
class TenantPolicy:
    """Source policy of a tenant; None means unrestricted."""

    allow_sources: tuple[str, ...] | None = None
    deny_sources: tuple[str, ...] = ()
    min_trust_score: float | None = None
    sync_allowed_sources: tuple[str, ...] | None = None

    def effective(self, requested: tuple[str, ...] | None = None, strict_among: tuple[str, ...] = ()) -> tuple[str, ...] | None:
        """Sources a request may use; None is unrestricted.

        A policy that only denies leaves a request without sources unrestricted,
        unless ``strict_among`` lists all sources to subtract from.
        """
        if requested is None and self.allow_sources is None:
            if self.deny_sources and strict_among:
                return tuple(s for s in strict_among if s not in self.deny_sources)
            return None
        pool = requested if requested is not None else self.allow_sources
        if requested is not None and self.allow_sources is not None:
            pool = tuple(s for s in requested if s in self.allow_sources)
        return tuple(s for s in pool if s not in self.deny_sources)

    def may_sync(self, source: str) -> bool:
        if self.sync_allowed_sources is not None:
            return source in self.sync_allowed_sources
        if source in self.deny_sources:
            return False
        return self.allow_sources is None or source in self.allow_sources

    def sync_column(self, source: Column) -> Column:
        """:meth:`may_sync` for a column of sources."""
        if self.sync_allowed_sources is not None:
            return source.isin(*self.sync_allowed_sources)
        ok = F.lit(True) if self.allow_sources is None else source.isin(*self.allow_sources)
        return ok & ~source.isin(*self.deny_sources)


def parse_policies(raw: str | None) -> dict[str, TenantPolicy]:
    """Policies by tenant from JSON; malformed text gives none; trust is clamped to 0..1."""
    try:
        data = json.loads(raw or "{}")
    except ValueError:
        return {}
    out = {}
    for tenant, p in data.items() if isinstance(data, dict) else ():
        names = lambda k, p=p: tuple(x for x in p[k] if isinstance(x, str)) if isinstance(p.get(k), list) else None
        if isinstance(p, dict):
            trust = p.get("min_trust_score")
            out[tenant] = TenantPolicy(
                names("allow_sources"), names("deny_sources") or (),
                max(0.0, min(1.0, float(trust))) if isinstance(trust, int | float) else None, names("sync_allowed_sources"),
            )
    return out


def tenant_policy(policies: dict[str, TenantPolicy], tenant: str) -> TenantPolicy:
    return policies.get(tenant) or policies.get("default") or TenantPolicy()


def effective_sources(policies: DataFrame) -> DataFrame:
    """Array form for many tenants: requested, allow and deny arrays to the effective ones; null is unrestricted."""
    pool = F.when(F.col("requested").isNull(), F.col("allow")).when(F.col("allow").isNull(), F.col("requested"))
    pool = pool.otherwise(F.array_intersect("requested", "allow"))
    return policies.withColumn("effective", F.array_except(pool, F.coalesce("deny", F.array().cast("array<string>"))))


def may_sync(source: Column, allow: Column, deny: Column, sync: Column) -> Column:
    inside = lambda a: F.array_contains(a, source)
    return (
        F.when(sync.isNotNull(), inside(sync))
        .when(F.coalesce(inside(deny), F.lit(False)), False)
        .otherwise(F.coalesce(inside(allow), F.lit(True)))
    )


def source_freshness(sources: DataFrame, snapshots: DataFrame, as_of: Column) -> DataFrame:
    """Latest snapshot, lag and health of each source; no window over all snapshots.

    The latest time of each source comes from a hash aggregation.  Only snapshots of that time are compared by all
    columns, which Spark does by sorting.
    """
    last = snapshots.groupBy("source_id").agg(F.max("fetched_at").alias("__last")).withColumnRenamed("source_id", "__source")
    # broadcast, as it has a time for each source
    final = snapshots.join(F.broadcast(last), (F.col("source_id") == F.col("__source")) & F.col("fetched_at").eqNullSafe(F.col("__last")))
    latest = final.groupBy("source_id").agg(F.max(F.struct("fetched_at", "id", "status", "error")).alias("s"))
    both = sources.join(latest, "source_id", "left")
    lag = F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("s.fetched_at").cast("timestamp"))) / 6e7)
    lag = F.when(lag.isNull(), NEVER).otherwise(F.greatest(lag, F.lit(0))).cast("long")
    health = F.when(lag <= 60, "healthy").when(lag <= 240, "degraded").otherwise("failing")
    return both.select(
        *sources.columns,
        F.coalesce(F.col("s.fetched_at"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).alias("last_synced_at"),
        lag.alias("lag_minutes"), health.alias("health"), F.col("s.status").alias("last_status"),
        F.when(F.col("s.status") == "failed", F.coalesce("s.error", F.lit("unknown"))).alias("error"),
    )


def recommended_actions(kind: Column, severity: Column, changed: Column, url: Column) -> Column:
    """What to do about a change: by type, escalation, changed sections, where to look."""
    none = F.lit(None).cast("string")
    is_ = lambda k: kind == k
    other = ~kind.isin("breaking_change", "deprecation", "updated")
    return F.array_compact(
        F.array(
            F.when(is_("breaking_change"), F.lit("Plan a migration and hold releases until checks pass.")),
            F.when(is_("breaking_change"), F.lit("Test the endpoints and client methods concerned.")),
            F.when(is_("breaking_change"), F.lit("Pin versions and note the incompatibility.")),
            F.when(is_("deprecation"), F.lit("File a replacement task with an owner and a date.")),
            F.when(is_("deprecation"), F.lit("Find uses of what is deprecated.")),
            F.when(is_("updated"), F.lit("Read the updated section for changed contracts.")),
            F.when(other, F.lit("Read the new page and extend internal guides.")),
            F.when(severity.isin("critical", "high"), F.lit("Tell the owner on call before merging.")),
            F.when(F.size(changed) > 0, F.concat(F.lit("Sections first: "), F.array_join(F.slice(changed, 1, 3), ", "))).otherwise(none),
            F.concat(F.lit("Page: "), url),
        )
    )


def change_feed(events: DataFrame, kind: str | None = None, severity: str | None = None, sources: tuple[str, ...] | None = None,
                limit: int = 20) -> DataFrame:
    """Newest events first, filtered, with recommended actions; at most 100."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be from 1 to 100")
    out = events
    if kind:
        out = out.where(F.col("event_type") == kind)
    if severity:
        out = out.where(F.col("severity") == severity)
    if sources is not None:
        out = out.where(F.col("source_id").isin(*sources))
    actions = recommended_actions(F.col("event_type"), F.col("severity"), F.col("changed_sections"), F.col("url"))
    return out.orderBy(F.desc("detected_at"), "id").limit(limit).withColumn("recommended_actions", actions)


def severity_weight(severity: Column) -> Column:
    out = F.lit(0)
    for name, w in SEVERITY.items():
        out = F.when(severity == name, w).otherwise(out)
    return out


def select_alerts(events: DataFrame, least: str = "medium", include_updated: bool = False, most: int = 8) -> DataFrame:
    """Events worth an alert: severe first, then newest."""
    out = events.where(severity_weight(F.col("severity")) >= SEVERITY[least])
    if not include_updated:
        out = out.where(~F.col("event_type").isin("updated", "document_added"))
    return out.orderBy(severity_weight(F.col("severity")).desc(), F.desc("detected_at"), "id").limit(max(1, most))


def alert_actions(kind: Column, severity: Column) -> Column:
    """The shorter list that goes with an alert."""
    is_ = lambda k: kind == k
    other = ~kind.isin("breaking_change", "deprecation", "updated")
    return F.array_compact(
        F.array(
            F.when(is_("breaking_change"), F.lit("Plan a migration; hold the deploy until checks pass.")),
            F.when(is_("breaking_change"), F.lit("Test the paths concerned.")),
            F.when(is_("deprecation"), F.lit("File a ticket with an owner.")),
            F.when(is_("deprecation"), F.lit("Find uses and plan their replacement.")),
            F.when(is_("updated"), F.lit("Read the update against runbooks.")),
            F.when(other, F.lit("Read the new page and extend internal notes.")),
            F.when(severity.isin("high", "critical"), F.lit("Tell the platform owner before merging.")),
        )
    )


def alert_messages(events: DataFrame, least: str = "medium", include_updated: bool = False, most: int = 8) -> DataFrame:
    """One text for each source with events worth an alert, the severest and newest ``most`` of them.

    Ranks are cut before rows meet, so a source with many events sends few.
    """
    out = events.where(severity_weight(F.col("severity")) >= SEVERITY[least])
    if not include_updated:
        out = out.where(~F.col("event_type").isin("updated", "document_added"))
    order = W.partitionBy("source_id").orderBy(severity_weight(F.col("severity")).desc(), F.desc("detected_at"), "id")
    top = out.withColumn("n", F.row_number().over(order)).where(F.col("n") <= max(1, most))
    action = F.get(alert_actions(F.col("event_type"), F.col("severity")), 0)
    block = F.concat(
        F.lit("- ["), F.upper("severity"), F.lit("] "), "event_type", F.lit(": "), "title", F.lit("\n  "), "summary",
        F.lit("\n  Next: "), action, F.lit("\n  "), "url",
    )
    grouped = top.groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("n", block.alias("block")))).alias("b"))
    head = F.concat("source_id", F.lit(": "), F.size("b").cast("string"), F.when(F.size("b") == 1, " change").otherwise(" changes"))
    message = F.concat(head, F.lit("\n"), F.array_join(F.transform("b", lambda x: x["block"]), "\n"))
    return grouped.select("source_id", F.size("b").cast("long").alias("events"), message.alias("message"))


def sources_by_id(freshness: DataFrame) -> DataFrame:
    return freshness.orderBy("source_id")


def resolve_policies(tenants: DataFrame, policies: dict[str, TenantPolicy]) -> DataFrame:
    """Policy of each tenant (tenant_id): its own, else the default one, else none; at most as many rows as policies are sent."""
    spark = tenants.sparkSession
    rows = [(k, p.allow_sources, list(p.deny_sources), p.min_trust_score, p.sync_allowed_sources) for k, p in policies.items()]
    kinds = "name string, allow array<string>, deny array<string>, min_trust double, sync array<string>"
    known = spark.createDataFrame([(a, b and list(b), c, d, e and list(e)) for a, b, c, d, e in rows], kinds)
    names = F.array(*map(F.lit, policies)) if policies else F.array().cast("array<string>")
    pick = F.when(F.array_contains(names, F.col("tenant_id")), F.col("tenant_id")).otherwise("default")
    asked = tenants.select("tenant_id", pick.alias("name"))
    return asked.join(known, "name", "left").select("tenant_id", "allow", "deny", "min_trust", "sync")


def telemetry_rows(requests: DataFrame, at: Column) -> DataFrame:
    """Rows of the telemetry table: latency from 0 and rounded half up, metadata never null."""
    fields = F.concat_ws("|", "tenant_id", "endpoint", "request_id")
    return requests.select(
        F.concat(F.lit("tel_"), F.sha2(fields, 256)).alias("id"), "tenant_id", "endpoint", "auth_subject",
        F.greatest(F.lit(0), F.floor(F.col("latency_ms") + 0.5)).cast("long").alias("latency_ms"), "http_status", "decision_status",
        F.coalesce("metadata", F.lit("{}")).alias("metadata"), at.alias("created_at"),
    )


def telemetry_summary(events: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Counts and mean latency of each tenant's last days."""
    days = max(1, min(90, days))
    recent = events.where(F.col("created_at") >= as_of - F.make_dt_interval(days=F.lit(days)))
    status = F.col("decision_status")
    return recent.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("http_status") >= 400).alias("errors"),
        F.count_if(status == "grounded").alias("grounded"),
        F.count_if(status.isNotNull() & (status != "grounded")).alias("abstained"),
        F.round(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 6).alias("avg_latency_ms"),
    )


def audit_export(events: DataFrame, tenant: str, start: str | None = None, end: str | None = None, limit: int = 500) -> DataFrame:
    """A tenant's events in a time range, newest first; the limit is clamped to 1..5000."""
    out = events.where(F.col("tenant_id") == tenant)
    if start:
        out = out.where(F.col("created_at") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        out = out.where(F.col("created_at") <= F.lit(end).cast("timestamp_ntz"))
    return out.orderBy(F.desc("created_at"), "id").limit(max(1, min(5000, limit)))


def policy_observability(events: DataFrame, sources: DataFrame, policies: DataFrame, as_of: Column) -> DataFrame:
    """Coverage of each tenant's policy and what it did in seven days.

    ``policies`` has tenant_id and an array of effective sources, null if unrestricted.
    """
    n = sources.agg(F.count(F.lit(1)).alias("total"), F.collect_set("source_id").alias("all"))
    recent = events.where(F.col("created_at") >= as_of - F.make_dt_interval(days=F.lit(7)))
    s = F.col("decision_status")
    counted = recent.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(s == "policy_blocked").alias("blocked"),
        F.count_if(s == "insufficient_sources").alias("insufficient"), F.count_if(s == "stale_sources").alias("stale"),
        F.count_if(s == "conflict_detected").alias("conflicts"),
    )
    allowed = F.size(F.coalesce(F.array_intersect("all", "effective"), F.col("all"))).cast("long")
    covered = policies.join(F.broadcast(n)).select(
        "tenant_id", F.col("total").alias("sources"), allowed.alias("allowed"), (F.col("total") - allowed).alias("denied")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return covered.join(counted, "tenant_id", "left").select(
        "tenant_id", "sources", "allowed", "denied", *map(zero, ("requests", "blocked", "insufficient", "stale", "conflicts"))
    )


def _mentions(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def preflight(task: Column, scoped: Column | None = None) -> Column:
    """Whether a task needs documentation, how deep, and why; words count as substrings."""
    low = F.lower(task)
    stakes, moving, how = _mentions(low, HIGH_STAKES), _mentions(low, CHANGE_SENSITIVE), _mentions(low, HOW_TO)
    scoped = F.lit(False) if scoped is None else scoped
    reasons = F.array_compact(
        F.array(
            F.when(stakes, F.lit("high_stakes_topic")), F.when(moving, F.lit("change_sensitive_topic")),
            F.when(scoped, F.lit("source_scoped_request")), F.when(how, F.lit("implementation_request")),
        )
    )
    any_ = F.size(reasons) > 0
    level = F.when(~any_, "none").when(stakes & moving, "deep").when(moving, "search").otherwise("freshness")
    pick = lambda none, deep, search, fresh: F.when(level == "none", none).when(level == "deep", deep).when(level == "search", search).otherwise(fresh)
    return F.struct(
        any_.alias("should_lookup"), level.alias("level"),
        F.when(any_, F.array_join(reasons, ",")).otherwise("no_doc_signal").alias("reasons"),
        pick(0, 8, 6, 4).cast("long").alias("search_top_k"), pick(0, 5, 4, 3).cast("long").alias("max_citations"),
        (level == "deep").alias("include_changes"), (level != "none").alias("include_freshness"),
    )
