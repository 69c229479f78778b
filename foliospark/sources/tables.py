"""The engine's tables, derived from the testdata.

``documents`` and ``pages`` play documents and fetched pages, ``events`` plays
telemetry and snapshots.  Every derived value is an expression of the row, so
SQL can restate it.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import chunks as C
from foliospark.functions.text import normalize_whitespace

AS_OF = dt.datetime(2024, 1, 31)
AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of():
    return F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document: id, source, url, title (first line, 80 characters), language, last change."""
    d = read(spark, sf_dir, "documents")
    id_ = F.col("doc_id").cast("string")
    age = F.make_dt_interval(mins=F.pmod(F.col("doc_id") * 37, F.lit(4000)).cast("int"))
    return d.select(
        "doc_id",
        F.col("source").alias("source_id"),
        F.concat(F.lit("https://docs.example.org/"), F.col("source"), F.lit("/"), id_).alias("url"),
        F.substring(F.split(F.coalesce("text", F.lit("")), "\n", 2)[0], 1, 80).alias("title"),
        F.col("lang").alias("language"),
        F.when(F.pmod("doc_id", F.lit(5)) == 0, F.lit("v1")).alias("version_tag"),
        (as_of() - age).alias("last_changed_at"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


DOCUMENTS_SQL = """doc AS (
  SELECT doc_id, source AS source_id, 'https://docs.example.org/' || source || '/' || doc_id AS url,
         substr(string_split(coalesce(text, ''), chr(10))[1], 1, 80) AS title, lang AS language,
         CASE WHEN doc_id % 5 = 0 THEN 'v1' END AS version_tag,
         TIMESTAMP '2024-01-31 00:00:00' - to_minutes((doc_id * 37) % 4000) AS last_changed_at,
         coalesce(text, '') AS text
  FROM documents
)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk joined with its document's columns; chunk_id is document and index."""
    return chunked(documents(spark, sf_dir))


#: What an edit adds to a document.
EDIT = " Configured webhooks are enabled for payments."


def chunked(docs: DataFrame) -> DataFrame:
    cut = docs.select("*", F.posexplode(C.chunks(F.col("text"))).alias("chunk_index", "c")).drop("text")
    return cut.select(
        F.concat(F.col("doc_id").cast("string"), F.lit("#"), F.col("chunk_index").cast("string")).alias("chunk_id"),
        "doc_id", "source_id", "url", "title", "language", "version_tag", "last_changed_at",
        F.col("chunk_index").cast("long").alias("chunk_index"),
        F.col("c.text").alias("text"), F.col("c.heading_path").alias("heading_path"), F.col("c.code_lang").alias("code_lang"),
    )


_NORMAL = r"""trim(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13), ''), '[ \t]+\n', chr(10), 'g'),
  '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]{2,}', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12))"""

#: The testdata's documents have no headings and no blank lines, so sections and packing don't show here.
CHUNKS_SQL = (
    DOCUMENTS_SQL
    + f""", norm AS (SELECT * EXCLUDE (text), {_NORMAL} AS text FROM doc), chunk AS (
  SELECT doc_id || '#' || i AS chunk_id, doc_id, source_id, url, title, language, version_tag, last_changed_at,
         i AS chunk_index, substr(text, (i * 1800 + 1)::BIGINT, 1800) AS text
  FROM (SELECT *, unnest(range(0, greatest(1, ((length(text) + 1799) // 1800))::BIGINT)) AS i FROM norm)
)"""
)


def trust(source_id):
    """Trust of ``src<n>``: 1.00, 0.90, ... 0.60 by n modulo 5."""
    n = F.regexp_extract(source_id, "([0-9]+)$", 1)
    n = F.coalesce(F.nullif(n, F.lit("")).cast("int"), F.lit(0))
    return (F.lit(1.0) - F.lit(0.1) * (n % 5)).cast("decimal(3,2)")


TRUST_SQL = "(1.0 - 0.1 * (coalesce(try_cast(regexp_extract(source_id, '([0-9]+)$', 1) AS INT), 0) % 5))::DECIMAL(3,2)"


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    status = (
        F.when(F.col("event_type") == "error", "insufficient_sources")
        .when(F.col("event_type") == "purchase", "grounded")
        .when(F.col("event_type") == "signup", "policy_blocked")
        .when(F.col("event_type") == "click", "stale_sources")
    )
    return e.select(
        F.concat(F.lit("tel_"), F.col("event_id").cast("string")).alias("id"),
        F.concat(F.lit("tenant_"), (F.col("user_id") % 10).cast("string")).alias("tenant_id"),
        F.concat(F.lit("/v1/"), F.col("event_type")).alias("endpoint"),
        F.floor(F.abs("value")).cast("long").alias("latency_ms"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("http_status"),
        status.alias("decision_status"),
        F.col("ts").alias("created_at"),
    )


TELEMETRY_SQL = """telemetry AS (
  SELECT 'tel_' || event_id AS id, 'tenant_' || (user_id % 10) AS tenant_id, '/v1/' || event_type AS endpoint,
         floor(abs(value))::BIGINT AS latency_ms, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS http_status,
         CASE event_type WHEN 'error' THEN 'insufficient_sources' WHEN 'purchase' THEN 'grounded'
              WHEN 'signup' THEN 'policy_blocked' WHEN 'click' THEN 'stale_sources' END AS decision_status,
         ts AS created_at
  FROM events
)"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").where("event_type <> 'signup'")
    return e.select(
        F.concat(F.lit("snap_"), F.col("event_id").cast("string")).alias("id"),
        F.concat(F.lit("src"), (F.col("user_id") % 25).cast("string")).alias("source_id"),
        F.col("ts").alias("fetched_at"),
        F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "partial")
        .otherwise("success").alias("status"),
        F.when(F.col("event_type") == "error", "fetch failed").alias("error"),
    )


SNAPSHOTS_SQL = """snapshot AS (
  SELECT 'snap_' || event_id AS id, 'src' || (user_id % 25) AS source_id, ts AS fetched_at,
         CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'partial' ELSE 'success' END AS status,
         CASE WHEN event_type = 'error' THEN 'fetch failed' END AS error
  FROM events WHERE event_type <> 'signup'
)"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty sources, src0 to src29; the last ones never had a snapshot."""
    ids = spark.range(30).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("source_id"))
    return ids.select("source_id", trust(F.col("source_id")).alias("trust_score"))


SOURCES_SQL = f"src AS (SELECT source_id, {TRUST_SQL} AS trust_score FROM (SELECT 'src' || unnest(range(30)) AS source_id))"


def document_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Previous and next text of each document: a line was edited, deprecated, withdrawn, or nothing happened."""
    d = documents(spark, sf_dir)
    k = F.pmod("doc_id", F.lit(5))
    added = (
        F.when(k == 1, F.lit("\n## Notes\nOne more remark."))
        .when(k == 2, F.lit("\n## Notes\nThis field is deprecated and will be removed."))
        .when(k == 3, F.lit("\n## Support\nA breaking change: the old call is no longer supported."))
        .when(k == 4, F.lit("\n## Support\nThe call is deprecated. Its sunset comes with a breaking change."))
        .otherwise(F.lit(""))
    )
    return d.select("doc_id", "source_id", "url", "title", F.col("text").alias("previous"), F.concat("text", added).alias("next"))


PAIRS_SQL = (
    DOCUMENTS_SQL
    + """, pair AS (
  SELECT doc_id, source_id, url, title, text AS previous, text || CASE doc_id % 5
    WHEN 1 THEN chr(10) || '## Notes' || chr(10) || 'One more remark.'
    WHEN 2 THEN chr(10) || '## Notes' || chr(10) || 'This field is deprecated and will be removed.'
    WHEN 3 THEN chr(10) || '## Support' || chr(10) || 'A breaking change: the old call is no longer supported.'
    WHEN 4 THEN chr(10) || '## Support' || chr(10) || 'The call is deprecated. Its sunset comes with a breaking change.'
    ELSE '' END AS next
  FROM doc
)"""
)


ACTING = "configure webhook "


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each benchmark item, in one of five forms by item.

    The whole text; four of its words; those after words that ask for an action; those with % and with _
    as wildcards.  People's requests are short, so most are four words.
    """
    b = read(spark, sf_dir, "benchmark")
    k = F.pmod("item_id", F.lit(10))
    four = F.array_join(F.slice(F.split("text", " ", -1), 2, 4), " ")
    form = (
        F.when(k == 9, F.col("text")).when(k.isin(1, 4), F.concat(F.lit(ACTING), four))
        .when(k == 2, F.replace(four, F.lit(" "), F.lit("%"))).when(k == 6, F.replace(four, F.lit("e"), F.lit("_")))
        .otherwise(four)
    )
    return b.select(F.col("item_id").alias("query_id"), F.lower(form).alias("query"))


_FOUR = "array_to_string(string_split(text, ' ')[2:5], ' ')"
QUERIES_SQL = f"""q AS (
  SELECT item_id AS query_id, lower(CASE WHEN item_id % 10 = 9 THEN text WHEN item_id % 10 IN (1, 4) THEN '{ACTING}' || {_FOUR}
    WHEN item_id % 10 = 2 THEN replace({_FOUR}, ' ', '%') WHEN item_id % 10 = 6 THEN replace({_FOUR}, 'e', '_')
    ELSE {_FOUR} END) AS query
  FROM benchmark
)"""

MODEL = "hashed-64"


def chunk_vectors(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """chunk_embedding: two chunks of five have no vector of the current model."""
    kind = F.pmod(F.col("doc_id") + F.col("chunk_index"), F.lit(5))
    rows = chunks.where(kind > 0).select(
        "chunk_id", F.when(kind == 1, "older").otherwise(MODEL).alias("model"),
        F.pmod(F.col("doc_id") * 31 + F.col("chunk_index") * 7, F.lit(500)).alias("vec_id"),
    )
    v = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    return rows.join(v, "vec_id").select("chunk_id", "model", "vector")


def query_vectors(queries: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Vectors of requests; every seventh has none."""
    q = queries.where("query_id % 7 <> 0").select("query_id", F.pmod(F.col("query_id") * 13, F.lit(500)).alias("vec_id"))
    return q.join(embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("vector")), "vec_id").select("query_id", "vector")


VECTORS_SQL = """unit AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v
  FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)),
qvec AS (SELECT query_id, v AS qv FROM q JOIN unit ON unit.vec_id = (query_id * 13) % 500 WHERE query_id % 7 <> 0),
cvec AS (SELECT chunk_id, v AS cv FROM chunk JOIN unit ON unit.vec_id = (doc_id * 31 + chunk_index * 7) % 500 WHERE (doc_id + chunk_index) % 5 NOT IN (0, 1))"""
