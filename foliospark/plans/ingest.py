"""Queries over sources and syncs: registry, seeds, sitemaps, fetches, page policies, persisting a run."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from foliospark.functions import chunks as C
from foliospark.functions import text as T
from foliospark.functions import urls as U
from foliospark.operators import ingest as I
from foliospark.operators import ops as O
from foliospark.plans import sqltext as S
from foliospark.session import materialize, new_folder, remember, remove, shared_dir, ship
from foliospark.sources import embedding as M
from foliospark.sources import fetch as X
from foliospark.sources import sinks
from foliospark.sources import tables as D
from foliospark.sources.memo import EmbeddingMemo
from foliospark.sources.policies import CRAWL_POLICIES
from foliospark.sources.registry import read_registry
from foliospark.sources.store import Store
from foliospark.streaming import persist as P

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Sources ----------------------------------------------------------------------------------------------

def _registry(spark, entries):
    """A registry file, a JSON array of the entries in order, written to the shared folder and read by the source; a row for each source."""
    path = new_folder(spark, "registry")
    fields = [c for c in entries.columns if c != "place"]
    listed = entries.agg(F.sort_array(F.collect_list(F.struct("place", F.struct(*fields).alias("e")))).alias("all"))
    listed.select(F.to_json(F.transform("all", lambda x: x["e"])).alias("value")).coalesce(1).write.text(path)
    return read_registry(spark, path)


@query("""WITH s AS (SELECT source AS id, count(*) AS n, min(doc_id) AS first FROM documents WHERE source IS NOT NULL GROUP BY source)
SELECT id, CASE WHEN n % 3 = 0 THEN 'Second of ' ELSE 'First of ' END || id AS name, CASE WHEN n % 3 = 0 THEN 'api' ELSE 'docs' END AS kind,
 CASE WHEN n % 3 = 0 THEN 0.95 WHEN n % 2 = 0 THEN 0.8 ELSE 1.0 END::DOUBLE AS trust_score, CASE WHEN n % 3 <> 0 AND n % 5 > 0 THEN 15 ELSE 60 END::INT AS poll_interval_minutes FROM s""")
def registry_scan(spark, sf_dir):
    """A registry of the documents' sources, some listed twice: the last entry counts; unset trust is 1, unset interval an hour."""
    s = D.read(spark, sf_dir, "documents").where("source IS NOT NULL").groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None)
    base = F.concat(F.lit("https://docs.example.org/"), "id")
    first = s.select(
        F.concat(F.lit("1"), "id").alias("place"), "id", F.concat(F.lit("First of "), "id").alias("name"), F.lit("docs").alias("kind"), base.alias("base_url"),
        F.when(F.col("n") % 2 == 0, 0.8).alias("trust_score"), F.when(F.col("n") % 5 > 0, 15).alias("poll_interval_minutes"),
    )
    again = s.where("n % 3 = 0").select(
        F.concat(F.lit("2"), "id"), "id", F.concat(F.lit("Second of "), "id"), F.lit("api"), base, F.lit(0.95), none.cast("int")
    )
    out = _registry(spark, first.union(again))
    return out.select("id", "name", "kind", F.col("trust_score").cast("double").alias("trust_score"), "poll_interval_minutes")


@query(f"""WITH h AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS id, page_id, url FROM pages), n AS (SELECT id, count(*) AS n FROM h GROUP BY id),
 u AS (SELECT id, 'https://' || id || '/' AS u FROM n WHERE n % 2 = 1 UNION ALL SELECT id, url FROM h JOIN n USING (id) WHERE n % 2 = 0)
SELECT DISTINCT id, {S.canonical('u')} AS seed FROM u""")
def crawl_seeds(spark, sf_dir):
    """Seeds of each host of the pages: its URLs, canonical and once each, or else its base."""
    h = D.read(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("id"), "url")
    base = F.concat(F.lit("https://"), "id", F.lit("/"))
    grouped = h.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.collect_set("url").alias("urls"))
    seeds = U.candidate_seeds(F.when(F.col("n") % 2 == 0, F.col("urls")), base)
    return grouped.select("id", F.explode(seeds).alias("seed"))


_SITEMAP = "['https://docs.example.org/p/' || page_id || '/', 'HTTPS://Docs.Example.org:443/p/' || page_id || '#top', 'https://docs.example.org/p/' || page_id || '/x.PNG', 'https://elsewhere.example.org/p/1', 'https://docs.example.org/q?utm_a=1&k=' || page_id, 'no url']"


@query(f"""WITH u AS (SELECT page_id, unnest({_SITEMAP}) AS u FROM pages), c AS (SELECT page_id, {S.canonical('u')} AS url FROM u)
SELECT page_id, url FROM c WHERE url IS NOT NULL AND starts_with(url, 'https://docs.example.org/') AND NOT ends_with(lower(url), '.png')""")
def sitemap_links(spark, sf_dir):
    """Locations of a sitemap for each page, canonical and in scope."""
    p = D.read(spark, sf_dir, "pages")
    n = F.col("page_id").cast("string")
    site = "https://docs.example.org"
    loc = lambda *parts: F.concat(F.lit("<url><loc> "), *parts, F.lit(" </loc></url>"))
    xml = F.concat(
        loc(F.lit(f"{site}/p/"), n, F.lit("/")), loc(F.lit("HTTPS://Docs.Example.org:443/p/"), n, F.lit("#top")),
        loc(F.lit(f"{site}/p/"), n, F.lit("/x.PNG")), loc(F.lit("https://elsewhere.example.org/p/1")),
        loc(F.lit(f"{site}/q?utm_a=1&k="), n), loc(F.lit("no url")),
    )
    return p.select("page_id", F.explode(U.sitemap_urls(xml, F.lit(f"{site}/"))).alias("url"))


@query("""WITH m AS (SELECT url, max_by(html, page_id) AS html FROM pages GROUP BY url),
 r AS (SELECT page_id AS n, 'src' || (page_id % 12) AS source_id, CASE WHEN page_id % 9 = 0 THEN url || '/gone' ELSE url END AS url FROM pages),
 j AS (SELECT r.*, m.html, '"' || md5(m.html) || '"' AS etag, CASE WHEN n % 5 = 0 THEN true ELSE false END AS known FROM r LEFT JOIN m USING (url))
SELECT source_id, url, CASE WHEN html IS NULL THEN 404 WHEN known THEN 304 ELSE 200 END::INT AS status, CASE WHEN html IS NULL THEN NULL WHEN known THEN '' ELSE html END AS html,
 CASE WHEN html IS NOT NULL THEN etag END AS etag, known AND html IS NOT NULL AS not_modified, 1::INT AS attempts,
 CASE WHEN html IS NULL THEN 'HTTP 404 for ' || url END AS error FROM j""")
def fetch_pages(spark, sf_dir):
    """Conditional requests against a stored mirror of the pages: some are known already, some are gone."""
    p = D.read(spark, sf_dir, "pages")
    mirror = p.groupBy("url").agg(F.max_by("html", "page_id").alias("html"))
    mirror = mirror.select("url", "html", F.concat(F.lit('"'), F.md5("html"), F.lit('"')).alias("etag"), F.lit(None).cast("string").alias("last_modified"))
    own = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    latest = p.select("page_id", "url").join(mirror.select("url", "html"), "url")
    url = F.when(F.col("page_id") % 9 == 0, F.concat("url", F.lit("/gone"))).otherwise(F.col("url"))
    source = F.concat(F.lit("src"), (F.col("page_id") % 12).cast("string"))
    tag = F.when(F.col("page_id") % 5 == 0, own).when(F.col("page_id") % 7 == 0, F.lit('"old"'))
    stored = latest.select(source.alias("source_id"), url.alias("canonical_url"), tag.alias("fetch_etag"), F.lit("").alias("fetch_last_modified"))
    return X.from_mirror(X.conditions(stored), mirror).drop("last_modified")


_FURNITURE = ("On this page", "Was this page helpful?", "Copy page", "Edit this page", "Ask AI", "Blog", "Breadcrumbs", "Kept line")
_DROPS = {
    "openai": ("on this page", "was this page helpful?", "copy page"), "nextjs": ("on this page", "edit this page"),
    "plaid": ("was this page helpful?",), "stripe": ("ask ai", "was this page helpful?", "on this page"), "react": ("blog",),
    "openbanking-uk": ("edit this page", "was this page helpful?"), "mdn-http": ("breadcrumbs",),
}
_NAMES = list(_DROPS)
_WITH_FURNITURE = "replace(html, '</article>', '" + "".join(f"<p>{x}</p>" for x in _FURNITURE) + "</article>')"
_DROPPED = "CASE k " + " ".join(f"WHEN {i} THEN [{', '.join(map(S.q, _DROPS[n]))}]" for i, n in enumerate(_NAMES)) + " END"


@query(f"""WITH p AS (SELECT page_id, page_id % 7 AS k, {S.page_text(S.denoise(S.main_html(_WITH_FURNITURE)))} AS text FROM pages)
SELECT page_id, sha256({S.normalize("array_to_string(list_filter(string_split(text, chr(10)), lambda x: " + S.trim_ws("x") + " <> '' AND NOT list_contains(" + _DROPPED + ", lower(" + S.trim_ws("x") + "))), chr(10))")}) AS text_sha256 FROM p""")
def policy_text(spark, sf_dir):
    """Page text without the noise lines of the source's crawl policy."""
    p = D.read(spark, sf_dir, "pages")
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("page_id") % 7 + 1).cast("int"))
    html = F.replace("html", F.lit("</article>"), F.lit("".join(f"<p>{x}</p>" for x in _FURNITURE) + "</article>"))
    text = T.html_to_text(T.strip_html_noise(T.main_html(html)))
    return p.select("page_id", F.sha2(I.without_noise(text, name, CRAWL_POLICIES), 256).alias("text_sha256"))


_EMBED = """w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(substr(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)), 1, 3500)), '[ \\t\\n\\r]+'), lambda x: x <> '')) AS w FROM documents),
 h AS (SELECT doc_id, ('0x' || md5(w)[1:8])::BIGINT AS h FROM w), d AS (SELECT doc_id, h % 64 AS k, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END)::DOUBLE AS v FROM h GROUP BY doc_id, k),
 n AS (SELECT doc_id, sqrt(sum(v * v)) AS norm FROM d GROUP BY doc_id)"""


@query(f"""WITH {_EMBED} SELECT d.doc_id, round(sum((k + 1) * v / norm), 6) + 0.0 AS checksum, round(CASE WHEN count(*) < 64 THEN greatest(0.0, max(v / norm)) ELSE max(v / norm) END, 6) AS largest
FROM d JOIN n USING (doc_id) WHERE norm > 0 GROUP BY d.doc_id""")
def embedded_documents(spark, sf_dir):
    """Unit vectors of the offline provider, a word's digest giving its place and sign."""
    ship(spark)
    d = D.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    v = M.chunk_embeddings(d, M.hashing_provider(), "words-64")
    weighted = F.aggregate(F.transform("vector", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return v.select(F.col("chunk_id").alias("doc_id"), (F.round(weighted, 6) + 0.0).alias("checksum"), F.round(F.array_max("vector"), 6).alias("largest"))


@query(SQL["embedded_documents"])
def embedding_memo(spark, sf_dir):
    """The same vectors through the memo: half of the documents are known when all are asked for, and equal texts are embedded once."""
    ship(spark)
    d = D.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    memo = EmbeddingMemo(spark, new_folder(spark, "memo"), 16)
    memo.embed(d.where("chunk_id % 2 = 0"), M.hashing_provider(), "words-64")
    v = memo.embed(d, M.hashing_provider(), "words-64")
    weighted = F.aggregate(F.transform("vector", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return v.select(F.col("chunk_id").alias("doc_id"), (F.round(weighted, 6) + 0.0).alias("checksum"), F.round(F.array_max("vector"), 6).alias("largest"))


# Host names of other scripts and their ASCII forms.
_HOSTS = {
    "bücher.example": "xn--bcher-kva.example", "例え.テスト": "xn--r8jz45g.xn--zckzah", "пример.испытание": "xn--e1afmkfd.xn--80akhbyknj4f",
    "www.español.example": "www.xn--espaol-zwa.example", "plain.example": "plain.example",
}


@query(f"""WITH u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*/([^?#]*)', 1) AS path, [{', '.join(map(S.q, _HOSTS.values()))}] AS hosts FROM pages)
SELECT page_id, 'https://' || hosts[page_id % 5 + 1] || rtrim('/' || regexp_replace(path, '[^/]*$', '') || page_id, '/') AS url FROM u""")
def url_hosts(spark, sf_dir):
    """Canonical URLs of hosts in other scripts, with dot segments in their paths."""
    p = D.read(spark, sf_dir, "pages")
    host = F.element_at(F.array(*map(F.lit, _HOSTS)), (F.col("page_id") % 5 + 1).cast("int"))
    path = F.regexp_extract("url", "^[a-z]+://[^/?#]*/([^?#]*)", 1)
    path = F.regexp_replace(path, "[^/]*$", "")
    url = F.concat(F.lit("HTTPS://"), host, F.lit("/"), path, F.lit("x/../y/./%2e%2e/"), F.col("page_id").cast("string"), F.lit("/#top"))
    return p.select("page_id", U.canonical_url(url).alias("url"))


# A run ------------------------------------------------------------------------------------------------

# Fixture: every seventh document is not yet known, and every sixth isn't fetched this time.
_KNOWN = "doc_id % 7 <> 0"
_ACTION = f"""CASE WHEN NOT ({_KNOWN}) THEN 'insert' WHEN next <> previous THEN 'update' WHEN doc_id % 10 = 0 THEN 'backfill' ELSE 'touch' END"""


def _pairs(spark, sf_dir):
    return D.document_pairs(spark, sf_dir)


def _merged(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    tag = F.lit(None).cast("string").alias("version_tag")
    current = p.where(_KNOWN).select(
        "source_id", F.col("url").alias("canonical_url"), tag, F.sha2("previous", 256).alias("content_hash"), (F.col("doc_id") % 10 == 0).alias("chunks_plain")
    )
    incoming = p.select(
        "doc_id", "source_id", F.col("url").alias("canonical_url"), tag, "title", "previous", "next", F.sha2("next", 256).alias("content_hash"),
        F.size(C.chunks(F.col("next"))).cast("long").alias("n_chunks"),
    )
    return I.merge_actions(current, incoming)


_RUN = f"""{D.PAIRS_SQL}, act AS (SELECT *, {_ACTION} AS action, doc_id % 5 AS k,
  length({S.normalize('previous')}) AS size FROM pair),
 counted AS (SELECT *, CASE WHEN k = 0 THEN greatest(1, (size + 1799) // 1800) ELSE (size + 1799) // 1800 + 1 END AS n_chunks FROM act),
 run AS (SELECT doc_id, source_id, title, 'document_added' AS event_type, 'low' AS severity, 'Added: ' || title AS summary FROM act WHERE action = 'insert'
  UNION ALL SELECT doc_id, source_id, title, 'breaking_change', 'critical', 'Possible breaking change in ' || title FROM act WHERE action = 'update' AND k IN (3, 4)
  UNION ALL SELECT doc_id, source_id, title, 'deprecation', 'medium', 'New deprecation wording in ' || title FROM act WHERE action = 'update' AND k IN (2, 4)
  UNION ALL SELECT doc_id, source_id, title, 'updated', 'low', 'Updated: ' || title FROM act WHERE action = 'update' AND k = 1),
 counters AS (SELECT source_id, count(*) FILTER (action = 'insert') AS inserted_documents, count(*) FILTER (action = 'update') AS updated_documents,
  coalesce(sum(n_chunks) FILTER (action <> 'touch'), 0)::BIGINT AS inserted_chunks, (SELECT count(*) FROM run WHERE run.source_id = counted.source_id) AS change_events
  FROM counted GROUP BY source_id)"""


@query(f"WITH {_RUN} SELECT doc_id, source_id, event_type, severity, summary FROM run")
def run_events(spark, sf_dir):
    """Events of a sync: new documents and changed ones."""
    e = I.run_events(_merged(spark, sf_dir), ["doc_id", "source_id"])
    return e.select("doc_id", "source_id", "event_type", "severity", "summary")


def _counters(spark, sf_dir):
    merged = materialize(_merged(spark, sf_dir), "merged")  # read for documents and for events
    return I.run_counters(merged, I.run_events(merged, ["doc_id", "source_id"]))


@query(f"WITH {_RUN} SELECT source_id, inserted_documents, updated_documents, inserted_chunks, change_events FROM counters")
def run_counters(spark, sf_dir):
    return _counters(spark, sf_dir)


@query(f"""WITH {_RUN} SELECT source_id, 'source=' || source_id || ' docs_inserted=' || inserted_documents || ' docs_updated=' || updated_documents
 || ' chunks_inserted=' || inserted_chunks || ' change_events=' || change_events || ' status=success' AS line FROM counters""")
def run_lines(spark, sf_dir):
    return I.run_line(_counters(spark, sf_dir).withColumn("run_status", F.lit("success")))


_AT = D.AS_OF_SQL
_OLD = f"""cur AS (SELECT source_id, url, CASE WHEN doc_id % 5 = 0 THEN 'v1' END AS version_tag, title, sha256(previous) AS content_hash, 'e' || doc_id AS fetch_etag,
  TIMESTAMP '2024-01-01 00:00:00' AS first_seen_at, TIMESTAMP '2024-01-02 00:00:00' + to_minutes(doc_id % 100) AS last_seen_at,
  TIMESTAMP '2024-01-02 00:00:00' AS last_changed_at, doc_id FROM pair WHERE {_KNOWN})"""


def _current(spark, sf_dir):
    seen = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    return _pairs(spark, sf_dir).where(_KNOWN).select(
        "source_id", F.col("url").alias("canonical_url"), F.when(F.col("doc_id") % 5 == 0, "v1").alias("version_tag"), "title",
        F.sha2("previous", 256).alias("content_hash"), F.concat(F.lit("e"), F.col("doc_id").cast("string")).alias("fetch_etag"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("first_seen_at"),
        (seen + F.make_dt_interval(mins=(F.col("doc_id") % 100).cast("int"))).alias("last_seen_at"), seen.alias("last_changed_at"),
    )


@query(f"""WITH {D.PAIRS_SQL}, {_OLD}, new AS (SELECT source_id, url, CASE WHEN doc_id % 5 = 0 THEN 'v1' END AS version_tag, title || ' v2' AS title,
  sha256(next) AS content_hash, CASE WHEN doc_id % 3 > 0 THEN 'n' || doc_id END AS fetch_etag FROM pair WHERE doc_id % 6 <> 0)
SELECT coalesce(n.url, o.url) AS canonical_url, coalesce(n.version_tag, o.version_tag) AS version_tag, coalesce(n.title, o.title) AS title,
 CASE WHEN o.url IS NULL OR n.content_hash <> o.content_hash THEN n.content_hash ELSE o.content_hash END AS content_hash,
 coalesce(n.fetch_etag, o.fetch_etag) AS fetch_etag, coalesce(o.first_seen_at, {_AT}) AS first_seen_at,
 CASE WHEN n.url IS NOT NULL THEN {_AT} ELSE o.last_seen_at END AS last_seen_at,
 CASE WHEN n.url IS NOT NULL AND (o.url IS NULL OR n.content_hash <> o.content_hash) THEN {_AT} ELSE o.last_changed_at END AS last_changed_at
FROM cur o FULL JOIN new n ON o.source_id = n.source_id AND o.url = n.url AND o.version_tag IS NOT DISTINCT FROM n.version_tag""")
def merged_documents(spark, sf_dir):
    """The next version of the document table: new, updated and untouched rows."""
    p = _pairs(spark, sf_dir).where("doc_id % 6 <> 0")
    incoming = p.select(
        "source_id", F.col("url").alias("canonical_url"), F.when(F.col("doc_id") % 5 == 0, "v1").alias("version_tag"),
        F.concat("title", F.lit(" v2")).alias("title"), F.sha2("next", 256).alias("content_hash"),
        F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("n"), F.col("doc_id").cast("string"))).alias("fetch_etag"),
    )
    return I.merged_documents(_current(spark, sf_dir), incoming, D.as_of()).drop("source_id")


@query(f"""WITH {D.PAIRS_SQL}, {_OLD} SELECT url AS canonical_url, CASE WHEN doc_id % 4 = 0 THEN {_AT} ELSE last_seen_at END AS last_seen_at,
 CASE WHEN doc_id % 4 = 0 AND doc_id % 8 > 0 THEN 'f' || doc_id ELSE fetch_etag END AS fetch_etag,
 CASE WHEN doc_id % 4 > 0 THEN 200 WHEN doc_id % 16 = 0 THEN 304 ELSE 299 END::INT AS fetch_last_status,
 CASE WHEN doc_id % 4 = 0 THEN {_AT} END AS fetch_last_checked_at FROM cur""")
def touched_documents(spark, sf_dir):
    """Documents whose fetch answered that nothing changed."""
    current = _current(spark, sf_dir).withColumns({"fetch_last_status": F.lit(200), "fetch_last_checked_at": F.lit(None).cast("timestamp_ntz")})
    same = _pairs(spark, sf_dir).where("doc_id % 4 = 0").select(
        "source_id", F.col("url").alias("canonical_url"), F.when(F.col("doc_id") % 16 > 0, 299).alias("status"),
        F.when(F.col("doc_id") % 8 > 0, F.concat(F.lit("f"), F.col("doc_id").cast("string"))).alias("etag"),
    )
    out = I.touch_not_modified(current, same, D.as_of())
    return out.select("canonical_url", "last_seen_at", "fetch_etag", "fetch_last_status", "fetch_last_checked_at")


@query(f"""WITH {D.PAIRS_SQL}, n AS (SELECT doc_id, {S.normalize('previous')} AS t FROM pair),
 old AS (SELECT doc_id, unnest(range(0, greatest(1, (length(t) + 1799) // 1800)::BIGINT)) AS i, t, length(t) AS size FROM n),
 again AS (SELECT doc_id, unnest(range(0, ((length(t) + 1799) // 1800)::BIGINT)) AS i, t FROM n WHERE doc_id % 5 > 0),
 piece AS (SELECT doc_id, i, substr(t, i * 1800 + 1, 1800) AS text, TIMESTAMP '2024-01-02 00:00:00' AS valid_from FROM old WHERE doc_id % 5 = 0
  UNION ALL SELECT doc_id, i, substr(t, i * 1800 + 1, 1800), {_AT} FROM again
  UNION ALL SELECT pair.doc_id, (length(t) + 1799) // 1800, substr(next, length(previous) + 2), {_AT} FROM pair JOIN n USING (doc_id) WHERE pair.doc_id % 5 > 0)
SELECT 'chk_' || sha256(doc_id::VARCHAR || '#' || i) AS id, doc_id::VARCHAR AS document_id, i::INT AS chunk_index, sha256(text) AS text_sha256,
 greatest(len(list_filter(regexp_split_to_array({S.trim_ws('text')}, '{T.WS}+'), lambda w: w <> '')), ceil(length(text) / 4.0))::BIGINT AS token_count, valid_from FROM piece""")
def replaced_chunks(spark, sf_dir):
    """Stored chunks after a run: those of changed documents are all put in anew, numbered from 0; other buckets keep their files."""
    p = _pairs(spark, sf_dir)
    seen = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    store = Store(spark, new_folder(spark, "store"), 16)
    empty = spark.createDataFrame([], P.TABLES["chunks"])
    first = I.replace_chunks(empty, p.select(F.col("doc_id").cast("string").alias("document_id"), C.chunks(F.col("previous")).alias("chunks")), seen)
    build = store.begin()
    build.overwrite("chunks", first, "document_id")
    build.commit()
    changed = p.where("previous <> next").select(F.col("doc_id").cast("string").alias("document_id"), C.chunks(F.col("next")).alias("chunks"))
    change = store.begin()
    change.merge("chunks", changed, "document_id", lambda kept, new: I.replace_chunks(kept, new, D.as_of()))
    change.commit()
    return store.table("chunks").select("id", "document_id", "chunk_index", F.sha2("text", 256).alias("text_sha256"), "token_count", "valid_from")


@query(f"""WITH {D.CHUNKS_SQL} SELECT doc_id::VARCHAR AS document_id, sha256(string_agg(text, chr(10) || chr(10) ORDER BY chunk_index)) AS text_sha256 FROM chunk GROUP BY doc_id""")
def document_text(spark, sf_dir):
    c = D.chunks(spark, sf_dir).select(F.col("doc_id").cast("string").alias("document_id"), "chunk_index", "text")
    return I.document_text(c).select("document_id", F.sha2("text", 256).alias("text_sha256"))


_PLACED = """p AS (SELECT page_id, url, 'src' || (page_id % 12) AS source_id, CASE WHEN page_id % 4 = 0 OR page_id % 12 = 6 THEN 'HTTP 500 for ' || url END AS error FROM pages),
 u AS (SELECT source_id, string_agg(url, ',' ORDER BY page_id) AS ref FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY page_id, url) AS n FROM p WHERE error IS NULL) WHERE n <= 8 GROUP BY source_id),
 e AS (SELECT source_id, string_agg(error, ' | ' ORDER BY page_id) AS error FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY page_id, url) AS n FROM p WHERE error IS NOT NULL) WHERE n <= 10 GROUP BY source_id),
 c AS (SELECT source_id, count(*) FILTER (error IS NULL) AS good, count(*) FILTER (error IS NOT NULL) AS bad FROM p GROUP BY source_id)"""


@query(f"""WITH {_PLACED} SELECT c.source_id, coalesce(ref, 'queue://source-sync/ssr_' || c.source_id) AS raw_blob_ref,
 CASE WHEN good = 0 THEN 'failed' WHEN bad > 0 THEN 'partial' ELSE 'success' END AS status, e.error FROM c LEFT JOIN u USING (source_id) LEFT JOIN e USING (source_id)""")
def run_snapshots(spark, sf_dir):
    """Snapshot rows: first URLs, first errors and status of each source's run."""
    bad = (F.col("page_id") % 4 == 0) | (F.col("page_id") % 12 == 6)
    p = D.read(spark, sf_dir, "pages").select(
        F.concat(F.lit("src"), (F.col("page_id") % 12).cast("string")).alias("source_id"), "url", F.col("page_id").alias("place"),
        F.when(bad, 500).otherwise(200).alias("status"), (~bad).alias("accepted"), F.lit(0).alias("removed_lines"),
        F.when(bad, F.concat(F.lit("HTTP 500 for "), "url")).alias("error"),
    )
    return I.run_snapshots(p, F.concat(F.lit("ssr_"), "source_id"))


@query(f"""WITH {_RUN}, ev AS (SELECT doc_id, count(*) AS n FROM run GROUP BY doc_id)
SELECT url AS canonical_url, CASE WHEN action IN ('insert', 'update') AND doc_id % 6 <> 0 THEN sha256(next) ELSE sha256(previous) END AS content_hash,
 CASE WHEN action = 'insert' THEN {D.AS_OF_SQL} ELSE TIMESTAMP '2024-01-02 00:00:00' END AS first_seen_at,
 CASE WHEN doc_id % 6 <> 0 THEN {D.AS_OF_SQL} ELSE TIMESTAMP '2024-01-02 00:00:00' END AS last_seen_at,
 CASE WHEN action IN ('insert', 'update') AND doc_id % 6 <> 0 THEN {D.AS_OF_SQL} ELSE TIMESTAMP '2024-01-02 00:00:00' END AS last_changed_at,
 (CASE WHEN action IN ('insert', 'update') AND doc_id % 6 <> 0 THEN n_chunks ELSE greatest(1, (size + 1799) // 1800) END)::BIGINT AS chunks,
 (CASE WHEN action = 'insert' THEN 1 WHEN action = 'update' AND doc_id % 6 <> 0 THEN 1 + ev.n ELSE 1 END)::BIGINT AS events
FROM counted LEFT JOIN ev USING (doc_id) WHERE action <> 'insert' OR doc_id % 6 <> 0""")
def sync_stream(spark, sf_dir):
    """Two syncs arrive as a stream and are stored batch by batch; the second is handed over twice, which changes nothing."""
    p = _pairs(spark, sf_dir)
    seen = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    inbox, checkpoint = new_folder(spark, "inbox"), new_folder(spark, "stream")
    store = P.create(spark, new_folder(spark, "store"), 16)
    syncs = (p.where(_KNOWN).withColumn("content", F.col("previous")), seen), (p.where("doc_id % 6 <> 0").withColumn("content", F.col("next")), D.as_of())
    for k, (rows, at) in enumerate(syncs):
        arrived = rows.select("source_id", F.col("url").alias("canonical_url"), "title", "content", at.alias("at"))
        arrived.write.option("compression", "zstd").parquet(f"{inbox}/{k}")
        P.sync_stream(store, "documents", spark.readStream.schema(P.FETCHED).parquet(f"{inbox}/*"), checkpoint, at).awaitTermination()
        # stored, so neither what arrived nor the version before is needed
        remove(spark, f"{inbox}/{k}")
        store.vacuum()
    again = rows.select("source_id", F.col("url").alias("canonical_url"), "title", F.lit("replayed").alias("content"), at.alias("at"))
    P.persist_batch(store, "documents", again, 1, at)
    count = lambda t: store.table(t).groupBy("document_id").agg(F.count(F.lit(1)).alias(t))
    out = store.table("documents").join(count("chunks"), "document_id", "left").join(count("events"), "document_id", "left")
    return out.select("canonical_url", "content_hash", "first_seen_at", "last_seen_at", "last_changed_at", "chunks", "events")


@query(f"WITH {_RUN} SELECT doc_id, event_type, severity FROM run")
def row_inserts(spark, sf_dir):
    """Change events appended to a table in two runs and read back."""
    e = I.run_events(_merged(spark, sf_dir), ["doc_id"]).select("doc_id", "event_type", "severity")
    path = f"{shared_dir(spark)}/folio/events-{uuid.uuid4().hex}"
    remember(spark, path)
    sinks.append(e.where("doc_id % 2 = 0"), path)
    sinks.append(e.where("doc_id % 2 = 1"), path)
    return spark.read.schema(e.schema).parquet(path)


@query(f"""WITH {D.SOURCES_SQL}, {D.SNAPSHOTS_SQL}, l AS (SELECT source_id, max(fetched_at) AS latest FROM snapshot GROUP BY source_id)
SELECT row_number() OVER (ORDER BY src.source_id) AS place, src.source_id, latest IS NOT NULL AS synced FROM src LEFT JOIN l USING (source_id)""")
def source_list(spark, sf_dir):
    """Sources by id, as the list of sources gives them."""
    from pyspark.sql import Window as W

    out = O.sources_by_id(O.source_freshness(D.sources(spark, sf_dir), D.snapshots(spark, sf_dir), D.as_of()))
    # a row for each source, as many as the registry has
    place = F.row_number().over(W.orderBy("source_id")).cast("long")
    return out.select(place.alias("place"), "source_id", F.col("last_status").isNotNull().alias("synced"))
