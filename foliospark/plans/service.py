"""Queries over requests: limits, policies, commands, signatures, jobs, alerts, projections, logs."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import functions as F

from foliospark.functions import settings as Z
from foliospark.operators import evaluate as E
from foliospark.operators import ops as O
from foliospark.operators import requests as Q
from foliospark.plans import operations as P
from foliospark.plans import sqltext as S
from foliospark.sources import tables as D
from foliospark.streaming import queue as J

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _turns(spark, sf_dir):
    return D.read(spark, sf_dir, "conversations")


# Requests ---------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN substr(coalesce(text, ''), 1, (conv_id % 4)::INT) ELSE coalesce(text, '') END AS query,
  coalesce(CASE WHEN conv_id % 5 > 0 THEN conv_id % 60 END, 10) AS top_k, coalesce(CASE WHEN conv_id % 2 = 0 THEN turn * 3 END, 5) AS max_citations,
  CASE WHEN conv_id % 9 = 0 THEN 'severe' WHEN conv_id % 9 = 1 THEN 'high' END AS severity FROM conversations)
SELECT conv_id, turn, top_k, max_citations, array_to_string(list_filter([CASE WHEN length(query) < 2 THEN 'query' END, CASE WHEN top_k NOT BETWEEN 1 AND 50 THEN 'top_k' END,
 CASE WHEN max_citations NOT BETWEEN 1 AND 10 THEN 'max_citations' END, CASE WHEN severity = 'severe' THEN 'severity' END], lambda x: x IS NOT NULL), ',') AS violations FROM r""")
def request_checks(spark, sf_dir):
    """Defaults and limits of search requests, one for each turn."""
    text, k = F.coalesce("text", F.lit("")), F.col("conv_id")
    r = _turns(spark, sf_dir).select(
        "conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.substring(text, F.lit(1), (k % 4).cast("int"))).otherwise(text).alias("query"),
        F.when(k % 5 > 0, k % 60).alias("top_k"), F.when(k % 2 == 0, F.col("turn") * 3).alias("max_citations"),
        F.when(k % 9 == 0, "severe").when(k % 9 == 1, "high").alias("severity"),
    )
    return Q.violations(Q.defaulted(r)).select("conv_id", "turn", "top_k", "max_citations", F.array_join("violations", ",").alias("violations"))


_ADDRESS = "'10.' || (user_id % 4) || '.' || (event_id % 7) || '.' || (event_id % 256)"


@query(f"""SELECT event_id, starts_with({_ADDRESS}, '10.1.') OR {_ADDRESS} = '10.2.3.10' OR starts_with({_ADDRESS}, '10.3.5.1') AS allowed FROM events""")
def address_filter(spark, sf_dir):
    e = D.read(spark, sf_dir, "events")
    n = lambda c, k: (F.col(c) % k).cast("string")
    address = F.concat(F.lit("10."), n("user_id", 4), F.lit("."), n("event_id", 7), F.lit("."), n("event_id", 256))
    return e.select("event_id", Q.address_allowed(address, ("10.1.*", "10.2.3.10", "10.3.5.1*")).alias("allowed"))


_SECRET = "a shared secret"

def _signed(secret: str):
    """A signature for each event, the work of a plain library; every third one is spoilt."""

    @F.pandas_udf("string")
    def sign(n: pd.Series, at: pd.Series, body: pd.Series) -> pd.Series:
        out = []
        for k, t, text in zip(n, at, body, strict=True):
            digest = hmac.new(secret.encode(), f"v0:{t}:{text}".encode(), hashlib.sha256).hexdigest()
            out.append(f"v0={digest[::-1] if k % 3 == 0 else digest}")
        return pd.Series(out)

    return sign


@query("""SELECT event_id, event_id % 3 <> 0 AND event_id % 700 <= 300 AS valid FROM events""")
def signature_check(spark, sf_dir):
    """Signatures made by a plain library, verified by JVM functions; older ones than five minutes don't count."""
    e = D.read(spark, sf_dir, "events").select("event_id", (F.lit(1_700_000_000) - F.col("event_id") % 700).alias("at"), "props")
    signed = e.withColumn("signature", _signed(_SECRET)(F.col("event_id"), F.col("at"), F.col("props")))
    return signed.select("event_id", Q.signature_ok(_SECRET, F.col("at"), F.col("props"), F.col("signature"), F.lit(1_700_000_000)).alias("valid"))


_COMMAND = """CASE conv_id % 6 WHEN 0 THEN '  Search ' || text || ' ' WHEN 1 THEN 'changes src' || conv_id WHEN 2 THEN 'HELP' WHEN 3 THEN ' ' WHEN 4 THEN 'search  ' ELSE text END"""
_WORDS = r"regexp_split_to_array(line, '[ \t\n]+')"


@query(f"""WITH c AS (SELECT conv_id, turn, {S.trim_ws(_COMMAND)} AS line FROM conversations WHERE text IS NOT NULL),
 v AS (SELECT *, CASE WHEN line = '' OR lower(line) = 'help' THEN 'help' WHEN starts_with(lower(line), 'search ') THEN 'search' WHEN starts_with(lower(line), 'changes') THEN 'changes' ELSE 'answer' END AS verb FROM c)
SELECT conv_id, turn, verb, CASE verb WHEN 'help' THEN NULL WHEN 'search' THEN nullif({S.trim_ws('substr(line, 8)')}, '') WHEN 'changes' THEN {_WORDS}[2] ELSE line END AS argument FROM v""")
def commands(spark, sf_dir):
    """Chat commands: help, search, changes, or a question."""
    k, text = F.col("conv_id") % 6, F.col("text")
    line = (
        F.when(k == 0, F.concat(F.lit("  Search "), text, F.lit(" "))).when(k == 1, F.concat(F.lit("changes src"), F.col("conv_id").cast("string")))
        .when(k == 2, "HELP").when(k == 3, " ").when(k == 4, "search  ").otherwise(text)
    )
    return _turns(spark, sf_dir).where("text is not null").select("conv_id", "turn", Q.commands(line).alias("c")).select("conv_id", "turn", "c.*")


_POLICIES = """{"tenant_0": {"allow_sources": ["src0", "src1"], "deny_sources": ["src1"], "min_trust_score": 7},
 "tenant_1": {"sync_allowed_sources": ["src3"], "min_trust_score": 0.4}, "default": {"deny_sources": ["src9", 5], "min_trust_score": -1}, "odd": 3}"""


@query("""WITH t AS (SELECT DISTINCT 'tenant_' || (user_id % 10) AS tenant_id FROM events)
SELECT tenant_id, CASE WHEN tenant_id = 'tenant_0' THEN 'src0,src1' END AS allow,
 CASE tenant_id WHEN 'tenant_0' THEN 'src1' WHEN 'tenant_1' THEN '' ELSE 'src9' END AS deny,
 CASE tenant_id WHEN 'tenant_0' THEN 1.0 WHEN 'tenant_1' THEN 0.4 ELSE 0.0 END::DOUBLE AS min_trust,
 CASE WHEN tenant_id = 'tenant_1' THEN 'src3' END AS sync FROM t""")
def tenant_policies(spark, sf_dir):
    """The policy of every tenant seen: its own, else the default one."""
    tenants = D.telemetry(spark, sf_dir).select("tenant_id").distinct()
    out = O.resolve_policies(tenants, O.parse_policies(_POLICIES))
    join = lambda c: F.array_join(c, ",").alias(c)
    return out.select("tenant_id", join("allow"), join("deny"), "min_trust", join("sync"))


@query("""WITH v AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'off' WHEN 2 THEN '' WHEN 3 THEN NULL WHEN 4 THEN 'High' WHEN 5 THEN '12.5' WHEN 6 THEN '-3' ELSE 'on' END AS x FROM events)
SELECT event_id, CASE event_id % 8 WHEN 0 THEN true WHEN 2 THEN true WHEN 3 THEN true WHEN 7 THEN true ELSE false END AS flag,
 CASE WHEN event_id % 8 = 4 THEN 'high' ELSE 'medium' END AS severity,
 CASE event_id % 8 WHEN 5 THEN 12.5 WHEN 6 THEN 1.0 ELSE 8.0 END::DOUBLE AS number FROM v""")
def settings(spark, sf_dir):
    """Flags, severities and numbers read from texts, with their fallbacks."""
    given = F.array(*map(F.lit, ["TRUE", "off", "", None, "High", "12.5", "-3", "on"]))
    e = D.read(spark, sf_dir, "events").select("event_id", F.element_at(given, (F.col("event_id") % 8 + 1).cast("int")).alias("x"))
    x = F.col("x")
    return e.select("event_id", Z.as_flag(x, True).alias("flag"), Z.as_severity(x).alias("severity"), Z.as_number(x, 8, 1).alias("number"))


# Jobs and telemetry -----------------------------------------------------------------------------------

_JOBS = """r AS (SELECT 'ssr_' || (event_id // 4) AS job_id, min(ts) AS requested_at, arg_min('src' || (user_id % 12), ts) AS source_id,
  count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY 1),
 j AS (SELECT *, source_id NOT IN ('src3', 'src7') AS ok FROM r),
 states AS (SELECT job_id, source_id, requested_at, CASE WHEN NOT ok OR failures >= 3 THEN 'failed' ELSE 'completed' END AS state,
  (CASE WHEN NOT ok THEN 0 ELSE least(failures + 1, 3) END)::BIGINT AS attempts_made,
  CASE WHEN NOT ok OR failures = 0 THEN '' WHEN failures = 1 THEN '3000' ELSE '3000,6000' END AS waits FROM j)"""


def _jobs(spark, sf_dir):
    e = D.read(spark, sf_dir, "events")
    job = F.concat(F.lit("ssr_"), F.floor(F.col("event_id") / 4).cast("string"))
    asked = e.select("event_id", job.alias("request_id"), F.concat(F.lit("src"), (F.col("user_id") % 12).cast("string")).alias("source_id"), F.col("ts").alias("requested_at"))
    jobs = J.enqueue(asked, O.TenantPolicy(deny_sources=("src3", "src7")).sync_column(F.col("source_id")), ("event_id",))
    return J.job_states(jobs, e.select(job.alias("job_id"), (F.col("event_type") != "error").alias("ok")))


@query(f"WITH {_JOBS} SELECT * FROM states")
def sync_jobs(spark, sf_dir):
    """Jobs by request id, their attempts and the waits before each retry."""
    return _jobs(spark, sf_dir).withColumn("waits", F.array_join("waits", ","))


@query(f"""WITH {_JOBS} SELECT job_id, state FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY requested_at DESC, job_id) AS n FROM states) WHERE n <= 1000""")
def jobs_retained(spark, sf_dir):
    """The newest thousand finished jobs of either kind."""
    return J.retained(_jobs(spark, sf_dir)).select("job_id", "state")


@query(f"""SELECT 'tel_' || sha256('tenant_' || (user_id % 10) || '|/v1/' || event_type || '|' || event_id) AS id, 'tenant_' || (user_id % 10) AS tenant_id, '/v1/' || event_type AS endpoint,
 'key_' || (user_id % 3) AS auth_subject, greatest(0, floor(value * 3 - 20 + 0.5))::BIGINT AS latency_ms, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS http_status,
 CASE WHEN event_type = 'purchase' THEN 'grounded' END AS decision_status, CASE WHEN event_id % 4 = 0 THEN '{{}}' ELSE props END AS metadata, {D.AS_OF_SQL} AS created_at FROM events""")
def telemetry_write(spark, sf_dir):
    """A telemetry row for each request."""
    e = D.read(spark, sf_dir, "events")
    r = e.select(
        F.col("event_id").cast("string").alias("request_id"), F.concat(F.lit("tenant_"), (F.col("user_id") % 10).cast("string")).alias("tenant_id"),
        F.concat(F.lit("/v1/"), "event_type").alias("endpoint"), F.concat(F.lit("key_"), (F.col("user_id") % 3).cast("string")).alias("auth_subject"),
        (F.col("value") * 3 - 20).alias("latency_ms"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("http_status"),
        F.when(F.col("event_type") == "purchase", "grounded").alias("decision_status"), F.when(F.col("event_id") % 4 > 0, F.col("props")).alias("metadata"),
    )
    return O.telemetry_rows(r, D.as_of())


# Alerts, projections, logs ----------------------------------------------------------------------------

_ALERT = f"""{P._EVENTS}, a AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY CASE severity WHEN 'critical' THEN 4 WHEN 'medium' THEN 2 ELSE 1 END DESC, detected_at DESC, id) AS n
  FROM feed WHERE severity <> 'low'),
 b AS (SELECT source_id, n, '- [' || upper(severity) || '] ' || event_type || ': ' || title || chr(10) || '  ' ||
  CASE event_type WHEN 'breaking_change' THEN 'Possible breaking change in ' ELSE 'New deprecation wording in ' END || title || chr(10) || '  Next: ' ||
  CASE event_type WHEN 'breaking_change' THEN 'Plan a migration; hold the deploy until checks pass.' ELSE 'File a ticket with an owner.' END || chr(10) || '  ' || url AS block FROM a WHERE n <= 8)"""


@query(f"""WITH {_ALERT} SELECT source_id, count(*) AS events, source_id || ': ' || count(*) || CASE WHEN count(*) = 1 THEN ' change' ELSE ' changes' END || chr(10) || string_agg(block, chr(10) ORDER BY n) AS message
FROM b GROUP BY source_id""")
def alert_messages(spark, sf_dir):
    """A message for each source with changes worth an alert."""
    return O.alert_messages(P._events(spark, sf_dir))


@query(f"""WITH {P._EVENTS} SELECT id, array_to_string(list_filter([CASE WHEN event_type = 'breaking_change' THEN 'Plan a migration; hold the deploy until checks pass.' END,
 CASE WHEN event_type = 'breaking_change' THEN 'Test the paths concerned.' END, CASE WHEN event_type = 'deprecation' THEN 'File a ticket with an owner.' END,
 CASE WHEN event_type = 'deprecation' THEN 'Find uses and plan their replacement.' END, CASE WHEN event_type = 'updated' THEN 'Read the update against runbooks.' END,
 CASE WHEN severity = 'critical' THEN 'Tell the platform owner before merging.' END], lambda x: x IS NOT NULL), '|') AS actions FROM feed""")
def alert_actions(spark, sf_dir):
    e = P._events(spark, sf_dir)
    return e.select("id", F.array_join(O.alert_actions(F.col("event_type"), F.col("severity")), "|").alias("actions"))


@query(f"""WITH {P._EVENTS}, t AS (SELECT * FROM feed WHERE source_id IN ('src1', 'src2', 'src3') ORDER BY detected_at DESC, id LIMIT 100)
SELECT source_id, event_type, severity, CASE event_type WHEN 'breaking_change' THEN 'Possible breaking change in ' WHEN 'deprecation' THEN 'New deprecation wording in ' ELSE 'Updated: ' END || title AS summary,
 strftime(detected_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS detected_at, CASE event_type WHEN 'breaking_change' THEN 'Plan a migration and hold releases until checks pass.|Test the endpoints and client methods concerned.'
 WHEN 'deprecation' THEN 'File a replacement task with an owner and a date.|Find uses of what is deprecated.' ELSE 'Read the updated section for changed contracts.|Sections first: ' || changed_sections END AS recommended_actions FROM t""")
def compact_changes(spark, sf_dir):
    """The tool's narrow form of a change feed: two actions each, times as the wire has them."""
    feed = O.change_feed(P._events(spark, sf_dir), sources=("src1", "src2", "src3"), limit=100)
    out = Q.wire(Q.compact(feed, "changes"))
    return out.withColumn("recommended_actions", F.array_join("recommended_actions", "|"))


@query(f"""WITH f AS ({P.SQL['source_freshness']}) SELECT source_id, health, lag_minutes FROM f WHERE source_id IN ('src1', 'src4', 'src28')""")
def compact_freshness(spark, sf_dir):
    """The tool's narrow form of freshness, for the sources asked for."""
    out = O.source_freshness(D.sources(spark, sf_dir), D.snapshots(spark, sf_dir), D.as_of())
    return Q.compact(Q.limited_sources(out, ("src1", "src4", "src28")), "freshness")


@query(f"""WITH {D.DOCUMENTS_SQL} SELECT doc_id, nullif(title, '') AS title, version_tag, language, strftime(last_changed_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS last_changed_at,
 {D.TRUST_SQL}::DOUBLE AS trust_score FROM doc""")
def wire_rows(spark, sf_dir):
    """Documents as the wire has them: empty texts as null, times in ISO form."""
    d = D.documents(spark, sf_dir).withColumn("version_tag", F.coalesce("version_tag", F.lit("")))
    return Q.wire(d.select("doc_id", "title", "version_tag", "language", "last_changed_at", D.trust(F.col("source_id")).alias("trust_score")))


@query("""WITH l AS (SELECT ts, event_type, event_id % 17 = 0 AS bare FROM events)
SELECT count(*) FILTER ((event_type = 'error' OR event_type = 'signup') AND (bare OR date_trunc('second', ts) >= TIMESTAMP '2024-01-25 00:00:00' - INTERVAL 30 MINUTES)) AS kills,
 count(*) FILTER ((event_type = 'error' OR event_type = 'signup') AND (bare OR date_trunc('second', ts) >= TIMESTAMP '2024-01-25 00:00:00' - INTERVAL 30 MINUTES)) >= 1 AS alarm FROM l""")
def memory_kills(spark, sf_dir):
    """Log lines of killed processes in half an hour; lines without a time count."""
    e = D.read(spark, sf_dir, "events")
    said = F.when(F.col("event_type") == "error", "node Killed (pid 7)").when(F.col("event_type") == "signup", "Out of Memory").otherwise("all is well")
    stamp = F.when(F.col("event_id") % 17 == 0, "").otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(" ")))
    return E.memory_kills(e.select(F.concat(stamp, said).alias("value")), F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"))
