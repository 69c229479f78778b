"""Queries over the operational tables: ingest, freshness, changes, telemetry, policy, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from foliospark.functions import chunks as C
from foliospark.functions import urls as U
from foliospark.functions.lexicon import CHANGE_SENSITIVE, HIGH_STAKES, HOW_TO
from foliospark.operators import crawl as K
from foliospark.operators import evaluate as E
from foliospark.operators import changes as G
from foliospark.operators import ingest as I
from foliospark.operators import ops as O
from foliospark.plans import sqltext as S
from foliospark.session import materialize, new_folder, remember, shared_dir, ship
from foliospark.sources import tables as D
from foliospark.streaming import sync

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Ingest -----------------------------------------------------------------------------------------------

# Fixture: every seventh document isn't known yet; of the stored ones every tenth but five has a heading in its chunks.
_CURRENT = """SELECT source_id, url AS canonical_url, NULL::VARCHAR AS version_tag, sha256(previous) AS content_hash, doc_id % 10 <> 5 AS chunks_plain FROM pair WHERE doc_id % 7 <> 0"""


def _current(spark, sf_dir):
    """Stored documents, with what their stored chunks say about headings and languages."""
    p = D.document_pairs(spark, sf_dir).where("doc_id % 7 <> 0")
    stored = F.when(F.col("doc_id") % 10 == 5, F.concat(F.lit("## Intro\n"), "previous")).otherwise(F.col("previous"))
    chunks = p.select(F.col("url").alias("document_id"), F.explode(C.chunks(stored)).alias("c")).select("document_id", "c.*")
    plain = I.plain_documents(chunks)
    rows = p.select(
        "source_id", F.col("url").alias("canonical_url"), F.lit(None).cast("string").alias("version_tag"), F.sha2("previous", 256).alias("content_hash")
    )
    rows = rows.join(plain.withColumnRenamed("document_id", "canonical_url"), "canonical_url", "left")
    return rows.withColumn("chunks_plain", F.coalesce("chunks_plain", F.lit(False)))


def _incoming(spark, sf_dir):
    p = D.document_pairs(spark, sf_dir)
    return p.select(
        "doc_id", "source_id", F.col("url").alias("canonical_url"), F.lit(None).cast("string").alias("version_tag"),
        F.sha2("next", 256).alias("content_hash"),
    )


@query(f"""WITH {D.PAIRS_SQL}, cur AS ({_CURRENT}) SELECT doc_id, CASE WHEN cur.canonical_url IS NULL THEN 'insert' WHEN content_hash <> sha256(next) THEN 'update'
 WHEN chunks_plain THEN 'backfill' ELSE 'touch' END AS action FROM pair LEFT JOIN cur ON pair.source_id = cur.source_id AND pair.url = cur.canonical_url""")
def merge_actions(spark, sf_dir):
    return I.merge_actions(_current(spark, sf_dir), _incoming(spark, sf_dir)).select("doc_id", "action")


@query(f"""WITH {D.PAIRS_SQL}, cur AS ({_CURRENT}) SELECT doc_id FROM pair JOIN cur ON pair.source_id = cur.source_id AND pair.url = cur.canonical_url
 WHERE content_hash = sha256(next) AND chunks_plain""")
def metadata_backfill(spark, sf_dir):
    return I.merge_actions(_current(spark, sf_dir), _incoming(spark, sf_dir)).where("action = 'backfill'").select("doc_id")


_LINE = "string_split(substr(next, length(previous) + 2), chr(10))"


@query(f"""WITH {D.PAIRS_SQL} SELECT doc_id, substr({_LINE}[1], 4) AS heading, {_LINE}[2] AS body FROM pair WHERE next <> previous""")
def changed_sections(spark, sf_dir):
    p = D.document_pairs(spark, sf_dir).where("previous <> next")
    c = p.select("doc_id", F.explode(I.changed_sections(F.col("previous"), F.col("next"))).alias("s"))
    return c.select("doc_id", "s.heading", "s.body")


_EVENTS = f"""{D.PAIRS_SQL}, k AS (SELECT *, doc_id % 5 AS k FROM pair WHERE doc_id % 5 > 0),
 ev AS (SELECT doc_id, source_id, url, title, 'breaking_change' AS event_type, 'critical' AS severity, 'breaking_or_removed' AS keyword_family, 'Support' AS changed_sections FROM k WHERE k IN (3, 4)
  UNION ALL SELECT doc_id, source_id, url, title, 'deprecation', 'medium', 'deprecation', CASE k WHEN 2 THEN 'Notes' ELSE 'Support' END FROM k WHERE k IN (2, 4)
  UNION ALL SELECT doc_id, source_id, url, title, 'updated', 'low', NULL, 'Notes' FROM k WHERE k = 1),
 feed AS (SELECT *, event_type || '_' || doc_id AS id, {D.AS_OF_SQL} - to_minutes((doc_id * 13) % 5000) AS detected_at FROM ev)"""


def _events(spark, sf_dir):
    e = I.change_events(D.document_pairs(spark, sf_dir), ["doc_id", "source_id", "url"])
    titles = D.documents(spark, sf_dir).select("doc_id", "title")
    back = F.make_dt_interval(mins=F.pmod(F.col("doc_id") * 13, F.lit(5000)).cast("int"))
    return e.join(titles, "doc_id").select(
        "*", F.concat("event_type", F.lit("_"), F.col("doc_id").cast("string")).alias("id"), (D.as_of() - back).alias("detected_at")
    )


@query(f"WITH {_EVENTS} SELECT doc_id, event_type, severity, keyword_family, changed_sections, 1::BIGINT AS changed_section_count FROM ev")
def change_events(spark, sf_dir):
    e = I.change_events(D.document_pairs(spark, sf_dir), ["doc_id"])
    return e.select("doc_id", "event_type", "severity", "keyword_family", F.array_join("changed_sections", ",").alias("changed_sections"), "changed_section_count")


@query(f"WITH {_EVENTS} SELECT doc_id, event_type, severity, keyword_family, changed_sections, 1::BIGINT AS changed_section_count FROM ev")
def digest_changes(spark, sf_dir):
    """The same events from stored tables: section digests and states of a first sync, compared with what a second one brings."""
    p = D.document_pairs(spark, sf_dir)
    stored = p.select("doc_id", F.col("previous").alias("text"))
    digests = materialize(G.section_digests(stored), "digests")
    states = materialize(G.document_states(stored), "states")
    e = G.change_events(stored, digests, states, p.select("doc_id", "title", F.col("next").alias("text")))
    return e.select("doc_id", "event_type", "severity", "keyword_family", F.array_join("changed_sections", ",").alias("changed_sections"), "changed_section_count")


_RUN_TEXT = S.page_text(S.denoise(S.main_html("html")))


def _fetched(spark, sf_dir):
    p = D.read(spark, sf_dir, "pages")
    status = F.when(F.col("page_id") % 11 == 0, 500).when(F.col("page_id") % 13 == 0, 304).otherwise(200)
    return p.select(
        "page_id", F.concat(F.lit("src"), (F.col("page_id") % 12).cast("string")).alias("source_id"), "url", "html", status.alias("status")
    )


@query(f"""WITH p AS (SELECT *, 'src' || (page_id % 12) AS source_id, CASE WHEN page_id % 11 = 0 THEN 500 WHEN page_id % 13 = 0 THEN 304 ELSE 200 END AS status,
 length({_RUN_TEXT}) AS n FROM pages),
 c AS (SELECT source_id, count(*) FILTER (status = 200 AND n >= 120) AS documents, count(*) FILTER (status = 500) AS errors FROM p GROUP BY source_id)
SELECT source_id, documents, errors, CASE WHEN documents = 0 AND errors > 0 THEN 'failed' WHEN documents = 0 OR errors > 0 THEN 'partial' ELSE 'success' END AS run_status FROM c""")
def run_status(spark, sf_dir):
    return I.run_status(I.page_documents(_fetched(spark, sf_dir))).select("source_id", "documents", "errors", "run_status")


_SITE = "replace(html, '</article>', '<a href=\"/p/' || (2 * page_id + 1) || '\">more</a><a href=\"/p/' || (2 * page_id + 2) || '\">more</a></article>')"


@query(f"""WITH RECURSIVE p AS (SELECT page_id, page_id % 11 <> 0 AND page_id % 13 <> 0 AS fetched, length({S.page_text(S.denoise(S.main_html(_SITE)))}) >= 120 AS long FROM pages),
 good AS (SELECT page_id FROM p WHERE fetched AND long),
 tree(page_id, depth) AS (SELECT page_id, 0 FROM good WHERE page_id = 1 UNION ALL
  SELECT g.page_id, depth + 1 FROM tree t JOIN good g ON g.page_id IN (2 * t.page_id + 1, 2 * t.page_id + 2) WHERE depth < 4),
 placed AS (SELECT *, row_number() OVER (ORDER BY depth, page_id) AS place FROM tree)
SELECT 'https://site.example.org/p' AS base, 'https://site.example.org/p/' || page_id AS url, depth, place FROM placed WHERE place <= 40""")
def crawl_frontier(spark, sf_dir):
    """Breadth-first crawl of a site made of the pages, each of which links to two more; see the tests for order and caps."""
    site = "https://site.example.org/p/"
    p = _fetched(spark, sf_dir).where("status = 200")
    child = lambda k: F.concat(F.lit('<a href="/p/'), (2 * F.col("page_id") + k).cast("string"), F.lit('">more</a>'))
    html = F.replace("html", F.lit("</article>"), F.concat(child(1), child(2), F.lit("</article>")))
    url = F.concat(F.lit(site), F.col("page_id").cast("string"))
    fetched = p.select("source_id", url.alias("url"), "status", html.alias("html"))
    pages = I.page_documents(fetched).select("canonical_url", "links", "accepted")
    pages = materialize(pages, "pages")  # read once for each depth
    seeds = spark.createDataFrame([(f"{site}1", 0, "https://site.example.org/p")], "url string, n int, base string")
    return K.crawl(pages, seeds, U.CrawlPolicy("pages", max_pages=40, max_depth=4))


# Operations -------------------------------------------------------------------------------------------


@query(f"""WITH {D.SOURCES_SQL}, {D.SNAPSHOTS_SQL}, lat AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY fetched_at DESC, id DESC) AS n FROM snapshot) WHERE n = 1),
 l AS (SELECT src.*, lat.status, lat.error, fetched_at, (CASE WHEN fetched_at IS NULL THEN 1000000 ELSE greatest(floor(epoch_us({D.AS_OF_SQL} - fetched_at) / 6e7), 0) END)::BIGINT AS lag_minutes FROM src LEFT JOIN lat USING (source_id))
SELECT source_id, trust_score::DOUBLE AS trust_score, coalesce(fetched_at, TIMESTAMP '1970-01-01 00:00:00') AS last_synced_at, lag_minutes,
 CASE WHEN lag_minutes <= 60 THEN 'healthy' WHEN lag_minutes <= 240 THEN 'degraded' ELSE 'failing' END AS health, status AS last_status,
 CASE WHEN status = 'failed' THEN coalesce(error, 'unknown') END AS error FROM l""")
def source_freshness(spark, sf_dir):
    out = O.source_freshness(D.sources(spark, sf_dir), D.snapshots(spark, sf_dir), D.as_of())
    return out.withColumn("trust_score", F.col("trust_score").cast("double"))


@query(f"WITH {_EVENTS} SELECT id, source_id, url, event_type, severity, detected_at FROM feed WHERE severity = 'critical' ORDER BY detected_at DESC, id LIMIT 20")
def change_feed(spark, sf_dir):
    return O.change_feed(_events(spark, sf_dir), severity="critical").select("id", "source_id", "url", "event_type", "severity", "detected_at")


@query(f"""WITH {_EVENTS} SELECT id, array_to_string(list_filter([
 CASE WHEN event_type = 'breaking_change' THEN 'Plan a migration and hold releases until checks pass.' END,
 CASE WHEN event_type = 'breaking_change' THEN 'Test the endpoints and client methods concerned.' END,
 CASE WHEN event_type = 'breaking_change' THEN 'Pin versions and note the incompatibility.' END,
 CASE WHEN event_type = 'deprecation' THEN 'File a replacement task with an owner and a date.' END,
 CASE WHEN event_type = 'deprecation' THEN 'Find uses of what is deprecated.' END,
 CASE WHEN event_type = 'updated' THEN 'Read the updated section for changed contracts.' END,
 CASE WHEN severity = 'critical' THEN 'Tell the owner on call before merging.' END,
 'Sections first: ' || changed_sections, 'Page: ' || url], lambda x: x IS NOT NULL), '|') AS actions FROM feed""")
def recommended_actions(spark, sf_dir):
    a = O.recommended_actions(F.col("event_type"), F.col("severity"), F.col("changed_sections"), F.col("url"))
    return _events(spark, sf_dir).select("id", F.array_join(a, "|").alias("actions"))


@query(f"""WITH {_EVENTS} SELECT id, event_type, severity, detected_at FROM feed WHERE severity IN ('medium', 'high', 'critical') AND event_type NOT IN ('updated', 'document_added')
 ORDER BY CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, detected_at DESC, id LIMIT 8""")
def alert_selection(spark, sf_dir):
    return O.select_alerts(_events(spark, sf_dir)).select("id", "event_type", "severity", "detected_at")


@query(f"""WITH {D.TELEMETRY_SQL} SELECT tenant_id, count(*) AS requests, count(*) FILTER (http_status >= 400) AS errors,
 count(*) FILTER (decision_status = 'grounded') AS grounded, count(*) FILTER (decision_status <> 'grounded') AS abstained,
 round(coalesce(avg(latency_ms), 0), 6) AS avg_latency_ms FROM telemetry WHERE created_at >= {D.AS_OF_SQL} - INTERVAL 7 DAYS GROUP BY tenant_id""")
def telemetry_summary(spark, sf_dir):
    return O.telemetry_summary(D.telemetry(spark, sf_dir), D.as_of(), 7)


@query(f"""WITH {D.TELEMETRY_SQL} SELECT id, endpoint, latency_ms, http_status, decision_status, created_at FROM telemetry
 WHERE tenant_id = 'tenant_3' AND created_at >= TIMESTAMP '2024-01-10 00:00:00' AND created_at <= TIMESTAMP '2024-01-25 00:00:00' ORDER BY created_at DESC, id LIMIT 500""")
def audit_export(spark, sf_dir):
    t = O.audit_export(D.telemetry(spark, sf_dir), "tenant_3", "2024-01-10 00:00:00", "2024-01-25 00:00:00")
    return t.select("id", "endpoint", "latency_ms", F.col("http_status").alias("http_status"), "decision_status", "created_at")


_POLICIES = [("tenant_0", ["src0", "src1", "nowhere"]), ("tenant_1", None), ("tenant_2", []), ("tenant_3", ["src4"])]


@query(f"""WITH {D.TELEMETRY_SQL}, {D.SOURCES_SQL}, p AS (SELECT * FROM (VALUES ('tenant_0', 2), ('tenant_1', 30), ('tenant_2', 0), ('tenant_3', 1)) p(tenant_id, allowed)),
 c AS (SELECT tenant_id, count(*) AS requests, count(*) FILTER (decision_status = 'policy_blocked') AS blocked, count(*) FILTER (decision_status = 'insufficient_sources') AS insufficient,
  count(*) FILTER (decision_status = 'stale_sources') AS stale, count(*) FILTER (decision_status = 'conflict_detected') AS conflicts FROM telemetry
  WHERE created_at >= {D.AS_OF_SQL} - INTERVAL 7 DAYS GROUP BY tenant_id)
SELECT tenant_id, (SELECT count(*) FROM src) AS sources, allowed::BIGINT AS allowed, (SELECT count(*) FROM src) - allowed AS denied,
 coalesce(requests, 0) AS requests, coalesce(blocked, 0) AS blocked, coalesce(insufficient, 0) AS insufficient, coalesce(stale, 0) AS stale, coalesce(conflicts, 0) AS conflicts
 FROM p LEFT JOIN c USING (tenant_id)""")
def policy_observability(spark, sf_dir):
    p = spark.createDataFrame(_POLICIES, "tenant_id string, effective array<string>")
    return O.policy_observability(D.telemetry(spark, sf_dir), D.sources(spark, sf_dir), p, D.as_of())


_REQUESTED = """s AS (SELECT 'tenant_' || (user_id % 10) AS tenant_id, 'src' || (event_id % 31) AS source, event_type FROM events WHERE event_id % 3 = user_id % 3),
 r AS (SELECT tenant_id, CASE WHEN tenant_id <> 'tenant_1' THEN list_distinct(list(source) FILTER (event_type IN ('click', 'view'))) END AS requested,
  CASE WHEN tenant_id NOT IN ('tenant_1', 'tenant_2') THEN list_distinct(list(source) FILTER (event_type IN ('view', 'purchase'))) END AS allow,
  list_distinct(list(source) FILTER (event_type = 'error')) AS deny, CASE WHEN tenant_id = 'tenant_3' THEN list_distinct(list(source) FILTER (event_type = 'signup')) END AS sync FROM s GROUP BY tenant_id)"""


def _requested(spark, sf_dir):
    """Policies of tenants, made of the sources of their events: at most 31 names in each list."""
    tenant = F.concat(F.lit("tenant_"), (F.col("user_id") % 10).cast("string"))
    e = D.read(spark, sf_dir, "events").where("event_id % 3 = user_id % 3")
    s = e.select(tenant.alias("tenant_id"), F.concat(F.lit("src"), (F.col("event_id") % 31).cast("string")).alias("source"), "event_type")
    of = lambda *kinds: F.collect_set(F.when(F.col("event_type").isin(*kinds), F.col("source")))
    lists = s.groupBy("tenant_id").agg(
        of("click", "view").alias("requested"), of("view", "purchase").alias("allow"), of("error").alias("deny"), of("signup").alias("sync")
    )
    t = F.col("tenant_id")
    return lists.select(
        "tenant_id", F.when(t != "tenant_1", F.col("requested")).alias("requested"),
        F.when(~t.isin("tenant_1", "tenant_2"), F.col("allow")).alias("allow"), "deny", F.when(t == "tenant_3", F.col("sync")).alias("sync"),
    )


@query(f"""WITH {_REQUESTED}, e AS (SELECT tenant_id, CASE WHEN requested IS NULL THEN allow WHEN allow IS NULL THEN requested ELSE list_filter(requested, lambda s: list_contains(allow, s)) END AS pool, deny FROM r)
SELECT tenant_id, array_to_string(list_sort(list_filter(pool, lambda s: NOT list_contains(coalesce(deny, []), s))), ',') AS effective FROM e""")
def effective_sources(spark, sf_dir):
    out = O.effective_sources(_requested(spark, sf_dir))
    return out.select("tenant_id", F.array_join(F.sort_array("effective"), ",").alias("effective"))


@query(f"""WITH {_REQUESTED}, seen AS (SELECT DISTINCT source AS source_id FROM documents) SELECT tenant_id, source_id, CASE WHEN sync IS NOT NULL THEN list_contains(sync, source_id)
 WHEN coalesce(list_contains(deny, source_id), false) THEN false ELSE coalesce(list_contains(allow, source_id), true) END AS may_sync FROM r, seen""")
def sync_permission(spark, sf_dir):
    """Which tenant may sync which source: the few sources, as a list, beside each tenant."""
    seen = D.read(spark, sf_dir, "documents").agg(F.collect_set("source").alias("sources"))
    both = _requested(spark, sf_dir).join(F.broadcast(seen)).select("*", F.explode("sources").alias("source_id"))
    return both.select("tenant_id", "source_id", O.may_sync(F.col("source_id"), F.col("allow"), F.col("deny"), F.col("sync")).alias("may_sync"))


_HAS = lambda words: "(" + " OR ".join(f"contains(x, {S.q(w)})" for w in words) + ")"


@query(f"""WITH c AS (SELECT conv_id, turn, lower(text) || CASE conv_id % 4 WHEN 0 THEN ' payment api' WHEN 1 THEN ' latest release' WHEN 2 THEN '' ELSE ' oauth' END AS x FROM conversations WHERE role = 'user'),
 f AS (SELECT *, {_HAS(HIGH_STAKES)} AS s, {_HAS(CHANGE_SENSITIVE)} AS m, {_HAS(HOW_TO)} AS h FROM c)
SELECT conv_id, turn, s OR m OR h AS should_lookup, CASE WHEN NOT (s OR m OR h) THEN 'none' WHEN s AND m THEN 'deep' WHEN m THEN 'search' ELSE 'freshness' END AS level,
 CASE WHEN s OR m OR h THEN array_to_string(list_filter([CASE WHEN s THEN 'high_stakes_topic' END, CASE WHEN m THEN 'change_sensitive_topic' END, CASE WHEN h THEN 'implementation_request' END], lambda r: r IS NOT NULL), ',') ELSE 'no_doc_signal' END AS reasons,
 CASE WHEN NOT (s OR m OR h) THEN 0 WHEN s AND m THEN 8 WHEN m THEN 6 ELSE 4 END::BIGINT AS search_top_k FROM f""")
def docs_preflight(spark, sf_dir):
    c = D.read(spark, sf_dir, "conversations").where("role = 'user'")
    k = F.pmod("conv_id", F.lit(4))
    tail = F.when(k == 0, " payment api").when(k == 1, " latest release").when(k == 2, "").otherwise(" oauth")
    p = c.select("conv_id", "turn", O.preflight(F.concat("text", tail)).alias("p"))
    return p.select("conv_id", "turn", "p.should_lookup", "p.level", "p.reasons", "p.search_top_k")


_STEPS = """steps AS (SELECT 'req_' || (event_id // 4) AS request_id, ts AS t,
 CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'processing' WHEN 'error' THEN 'failed' ELSE 'completed' END AS status FROM events)"""


@query(f"""WITH {_STEPS}, l AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY t DESC, status DESC) AS n, min(t) OVER (PARTITION BY request_id) AS requested_at, count(*) OVER (PARTITION BY request_id) AS events FROM steps)
SELECT request_id, status, requested_at, CASE WHEN status IN ('completed', 'failed') THEN t END AS processed_at, events FROM l WHERE n = 1""")
def request_state(spark, sf_dir):
    e = D.read(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "processing")
    status = status.when(F.col("event_type") == "error", "failed").otherwise("completed")
    request = F.concat(F.lit("req_"), F.floor(F.col("event_id") / 4).cast("string"))
    return sync.request_state(e.select(request.alias("request_id"), F.col("ts").alias("at"), status.alias("status")))


@query(f"""WITH {_STEPS}, l AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY t DESC, status DESC) AS n FROM steps),
 k AS (SELECT request_id, count(DISTINCT status) AS seen FROM steps GROUP BY request_id)
SELECT request_id, seen FROM k""")
def request_stream(spark, sf_dir):
    """Requests that arrive twice in a folder of files: a stream keeps each state of a request once."""
    e = D.read(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "processing")
    status = status.when(F.col("event_type") == "error", "failed").otherwise("completed")
    request = F.concat(F.lit("req_"), F.floor(F.col("event_id") / 4).cast("string"))
    # arrival in one hour, so that none is late for the watermark
    rows = e.select(request.alias("request_id"), F.lit("src1").alias("source_id"), status.alias("status"),
                    (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(secs=F.col("event_id") % 3600)).alias("at"))
    place = f"{shared_dir(spark)}/folio/requests-{uuid.uuid4().hex}"
    remember(spark, place)
    rows.union(rows).write.json(f"{place}/in")
    out = f"{place}/out"
    run = sync.start(sync.request_stream(spark, f"{place}/in"), lambda df, n: df.write.mode("append").parquet(out), f"{place}/checkpoint")
    run.awaitTermination()
    seen = spark.read.schema(sync.REQUEST).parquet(out)
    return seen.groupBy("request_id").agg(F.count(F.lit(1)).alias("seen"))


@query("""WITH RECURSIVE e AS (SELECT 'user_' || user_id AS key, event_id AS id, ts AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 w(key, id, t, n, opened, used, ok) AS (SELECT key, id, t, n, t, 1, true FROM e WHERE n = 1 UNION ALL
  SELECT key, id, t, n, CASE WHEN over THEN t ELSE opened END, CASE WHEN over THEN 1 ELSE least(used + 1, 2) END, over OR used < 2
  FROM (SELECT e.*, opened, used, e.t >= opened + INTERVAL 6 HOURS AS over FROM w JOIN e ON e.key = w.key AND e.n = w.n + 1))
SELECT key, id, t AS "at", ok AS allowed, CASE WHEN ok THEN 0 ELSE ceil(epoch_us(opened + INTERVAL 6 HOURS - t) / 1e6) END::BIGINT AS retry_after FROM w""")
def rate_limit(spark, sf_dir):
    """Windows that open at a key's first request."""
    ship(spark)
    e = D.read(spark, sf_dir, "events")
    r = e.select(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("id"), F.col("ts").alias("at"))
    return sync.rate_limit(r, 6 * 3600, 2)


@query(SQL["rate_limit"])
def rate_limit_state(spark, sf_dir):
    """The same verdicts from a stream whose windows are state: requests arrive in two batches, each decided once the watermark has passed it."""
    from foliospark.streaming import state

    e = D.read(spark, sf_dir, "events")
    r = e.select(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"))
    late = F.lit("2024-01-15").cast("timestamp")
    end = spark.createDataFrame([("", -1)], "key string, id long").withColumn("at", F.lit("2100-01-01").cast("timestamp"))
    inbox, checkpoint, out = (new_folder(spark, n) for n in ("requests", "rates", "verdicts"))
    for part in (r.where(F.col("at") < late), r.where(F.col("at") >= late), end):
        part.write.mode("append").parquet(inbox)
        verdicts = state.rate_limit_stream(spark.readStream.schema(r.schema).parquet(inbox), 6 * 3600, 2)
        sync.start(verdicts, lambda df, n: df.write.mode("append").parquet(out), checkpoint).awaitTermination()
    seen = spark.read.schema(state.VERDICT).parquet(out).where("id >= 0")
    return seen.select("key", "id", F.col("at").cast("timestamp_ntz").alias("at"), "allowed", "retry_after")


@query("""SELECT count(*) AS total, count(*) FILTER (doc_id % 20 NOT IN (7, 13)) AS correct, round(count(*) FILTER (doc_id % 20 NOT IN (7, 13)) / count(*), 6)::DOUBLE AS accuracy FROM documents""")
def classifier_accuracy(spark, sf_dir):
    """Accuracy against fixtures of which two of twenty expect another event than the change has."""
    p = D.document_pairs(spark, sf_dir)
    k = F.pmod("doc_id", F.lit(5))
    want = F.when((k <= 1) | (F.col("doc_id") % 20).isin(7, 13), "updated").when(k == 2, "deprecation").otherwise("breaking_change")
    return E.accuracy(p.select(I.primary_event(F.col("previous"), F.col("next")).alias("got"), want.alias("expected")))


@query(f"""WITH {D.TELEMETRY_SQL} SELECT id, to_json({{'tenant_id': tenant_id, 'endpoint': endpoint, 'latency_ms': latency_ms}}) AS line FROM telemetry""")
def json_export(spark, sf_dir):
    t = D.telemetry(spark, sf_dir)
    return t.select("id", F.to_json(F.struct("tenant_id", "endpoint", "latency_ms")).alias("line"))


@query(f"""WITH {D.SOURCES_SQL}, n AS (SELECT source_id, count(*) AS c FROM (SELECT source AS source_id FROM documents) GROUP BY 1)
SELECT coalesce(src.source_id, n.source_id) AS source_id, coalesce(c, 0)::BIGINT AS documents FROM src FULL JOIN n USING (source_id)""")
def source_upsert(spark, sf_dir):
    """Upsert of observed document counts into the stored source table; buckets without an observed source keep their files."""
    from foliospark.sources.sinks import upsert
    from foliospark.sources.store import Store

    current = D.sources(spark, sf_dir).select("source_id", F.lit(0).cast("long").alias("documents"))
    seen = D.read(spark, sf_dir, "documents").groupBy(F.col("source").alias("source_id")).agg(F.count(F.lit(1)).alias("documents"))
    store = Store(spark, new_folder(spark, "store"), 16)
    build = store.begin()
    build.overwrite("sources", current, "source_id")
    build.commit()
    change = store.begin()
    change.merge("sources", seen, "source_id", lambda old, new: upsert(old, new, ["source_id"], ["documents"]))
    change.commit()
    return store.table("sources")
