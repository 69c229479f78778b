"""Validated requests, signatures and the projections that tools return."""

from __future__ import annotations

import hashlib
import hmac
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.operators.retrieve import Filters

EVENT_TYPES = ("document_added", "updated", "deprecation", "breaking_change")
SEVERITIES = ("low", "medium", "high", "critical")


def _within(name: str, value: int, low: int, high: int) -> None:
    if not isinstance(value, int) or not low <= value <= high:
        raise ValueError(f"{name} must be from {low} to {high}")


@dataclass(frozen=True)
class SearchRequest:
    query: str
    filters: Filters = Filters()
    top_k: int = 10

    def __post_init__(self) -> None:
        if len(self.query) < 2:
            raise ValueError("query needs two characters")
        _within("top_k", self.top_k, 1, 50)


@dataclass(frozen=True)
class AnswerRequest:
    question: str
    filters: Filters = Filters()
    style: str = "concise"
    max_citations: int = 5

    def __post_init__(self) -> None:
        if len(self.question) < 3:
            raise ValueError("question needs three characters")
        if self.style not in ("concise", "detailed"):
            raise ValueError("style is concise or detailed")
        _within("max_citations", self.max_citations, 1, 10)


@dataclass(frozen=True)
class ChangesRequest:
    source: str | None = None
    event_type: str | None = None
    severity: str | None = None
    limit: int = 20

    def __post_init__(self) -> None:
        if self.event_type not in (None, *EVENT_TYPES) or self.severity not in (None, *SEVERITIES):
            raise ValueError("unknown event type or severity")
        _within("limit", self.limit, 1, 100)


def address_allowed(address: Column, patterns: tuple[str, ...]) -> Column:
    """Exact addresses, prefixes that end with *, or * for all; no patterns allow all."""
    if not patterns:
        return F.lit(True)
    out = F.lit(False)
    for p in patterns:
        out = out | (address.startswith(p[:-1]) if p.endswith("*") else address == p)
    return out


def signature_valid(secret: str, timestamp: int, body: str, signature: str, now: int, skew: int = 300) -> bool:
    """HMAC-SHA256 over version, time and body, at most ``skew`` seconds old; compared in constant time."""
    if abs(now - timestamp) > skew:
        return False
    want = hmac.new(secret.encode(), f"v0:{timestamp}:{body}".encode(), hashlib.sha256).hexdigest()
    return hmac.compare_digest(f"v0={want}", signature)


def signature_ok(secret: str, timestamp: Column, body: Column, signature: Column, now: Column, skew: int = 300) -> Column:
    """The same verdict for a table of requests, by JVM functions: two nested digests with the padded key."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in key).hex()))
    message = F.encode(F.concat(F.lit("v0:"), timestamp.cast("string"), F.lit(":"), body), "utf-8")
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message), 256))
    want = F.concat(F.lit("v0="), F.sha2(F.concat(pad(0x5C), inner), 256))
    return F.coalesce((F.abs(now - timestamp) <= skew) & (want == signature), F.lit(False))


def defaulted(requests: DataFrame) -> DataFrame:
    """Requests with the values that unset fields stand for."""
    given = {"top_k": 10, "max_citations": 5, "limit": 20, "days": 7}
    values = {c: F.coalesce(c, F.lit(v)) for c, v in given.items() if c in requests.columns}
    if "style" in requests.columns:
        values["style"] = F.coalesce("style", F.lit("concise"))
    return requests.withColumns(values)


def violations(requests: DataFrame) -> DataFrame:
    """Adds the names of the fields whose values a request may not have; an empty list for a valid one."""
    within = lambda c, low, high: F.when(~F.coalesce(F.col(c).between(low, high), F.lit(False)), F.lit(c))
    length = lambda c, n: F.when(F.length(F.coalesce(c, F.lit(""))) < n, F.lit(c))
    rules = {
        "query": length("query", 2), "question": length("question", 3), "top_k": within("top_k", 1, 50),
        "max_citations": within("max_citations", 1, 10), "limit": within("limit", 1, 100), "days": within("days", 1, 90),
        "event_type": F.when(~F.col("event_type").isin(*EVENT_TYPES), F.lit("event_type")),
        "severity": F.when(~F.col("severity").isin(*SEVERITIES), F.lit("severity")),
        "style": F.when(~F.col("style").isin("concise", "detailed"), F.lit("style")),
    }
    found = [rule for c, rule in rules.items() if c in requests.columns]
    return requests.withColumn("violations", F.array_compact(F.array(*found)))


def iso(at: Column) -> Column:
    """A time as the wire has it, in UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def wire(rows: DataFrame) -> DataFrame:
    """Rows as they are sent: empty texts as null, times in ISO form, decimals as numbers."""
    out = []
    for f in rows.schema.fields:
        c, kind = F.col(f.name), f.dataType.typeName()
        if kind == "string":
            c = F.nullif(c, F.lit(""))
        elif kind.startswith("timestamp"):
            c = iso(c)
        elif kind.startswith("decimal"):
            c = c.cast("double")
        out.append(c.alias(f.name))
    return rows.select(*out)


def commands(text: Column) -> Column:
    """Struct of verb and argument for a column of chat commands; the same grammar as :func:`command`."""
    blank = r"[\s\x1c-\x1f\x85\p{Z}]"
    line = F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(rf"^{blank}+|{blank}+\z"), F.lit(""))
    low = F.lower(line)
    rest = F.nullif(F.regexp_replace(F.substring(line, F.lit(8), F.length(line)), F.lit(rf"^{blank}+|{blank}+\z"), F.lit("")), F.lit(""))
    second = F.nullif(F.regexp_extract(line, rf"^[^\s]+{blank}+([^\s]+)", 1), F.lit(""))
    none = F.lit(None).cast("string")
    is_help, is_search, is_changes = (low == "") | (low == "help"), low.startswith("search "), low.startswith("changes")
    return F.struct(
        F.when(is_help, "help").when(is_search, "search").when(is_changes, "changes").otherwise("answer").alias("verb"),
        F.when(is_help, none).when(is_search, rest).when(is_changes, second).otherwise(line).alias("argument"),
    )


def command(text: str) -> tuple[str, str | None]:
    """A chat command as (verb, argument): help, search, changes, or a question."""
    line = text.strip()
    low = line.lower()
    if not line or low == "help":
        return "help", None
    if low.startswith("search "):
        return "search", line[7:].strip() or None
    if low.startswith("changes"):
        words = line.split()
        return "changes", words[1] if len(words) > 1 else None
    return "answer", line


#: Columns of the compact form of each tool's result.
COMPACT = {
    "search": ("query_id", "title", "url", "source_id", "last_changed_at"),
    "answer": ("query_id", "answer", "status", "confidence"),
    "freshness": ("source_id", "health", "lag_minutes"),
    "changes": ("source_id", "event_type", "severity", "summary", "recommended_actions", "detected_at"),
}


def compact(result: DataFrame, tool: str) -> DataFrame:
    """The narrow form of a result; of recommended actions the first two stay."""
    if tool not in COMPACT:
        raise ValueError(f"unknown tool: {tool}")
    out = result.select(*[c for c in COMPACT[tool] if c in result.columns])
    if "recommended_actions" in out.columns:
        out = out.withColumn("recommended_actions", F.slice("recommended_actions", 1, 2))
    return out


def limited_sources(result: DataFrame, sources: tuple[str, ...]) -> DataFrame:
    """Keeps the sources asked for; none asked for keeps all."""
    return result.where(F.col("source_id").isin(*sources)) if sources else result
