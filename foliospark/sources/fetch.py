"""Fetch source: pages by URL through a transport, with retries and conditional requests.

A transport is a function of (url, headers, timeout, attempt) that returns
(status, text, headers) or raises.  :func:`http` asks the network; tests and
closed clusters hand in another one.  Every URL is tried by the task that holds
its row, so a lost task asks again and nothing else is kept.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.session import ship

Transport = Callable[[str, dict[str, str], float, int], tuple[int, str, dict[str, str]]]
FETCHED = (
    "source_id string, url string, status int, html string, etag string, last_modified string, "
    "not_modified boolean, attempts int, error string"
)


def http(url: str, headers: dict[str, str], timeout: float, attempt: int) -> tuple[int, str, dict[str, str]]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as answer:
            body = answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")
            return answer.status, body, {k.lower(): v for k, v in answer.headers.items()}
    except urllib.error.HTTPError as e:
        return e.code, "", {k.lower(): v for k, v in e.headers.items()}


def fetch_one(
    url: str, etag: str | None, last_modified: str | None, transport: Transport, timeout: float, retries: int,
    backoff: float, agent: str, sleep: Callable[[float], None],
) -> tuple:
    """(status, text, etag, last_modified, not_modified, attempts, error) of one URL."""
    headers = {"user-agent": agent}
    if etag:
        headers["if-none-match"] = etag
    if last_modified:
        headers["if-modified-since"] = last_modified
    error = status = None
    for attempt in range(retries + 1):
        try:
            status, text, got = transport(url, headers, timeout, attempt)
            if status == 304:
                return 304, "", got.get("etag"), got.get("last-modified"), True, attempt + 1, None
            if 200 <= status < 300:
                return status, text, got.get("etag"), got.get("last-modified"), False, attempt + 1, None
            error = f"HTTP {status} for {url}"
        except Exception as e:  # whatever a transport raises is an attempt that failed, and is reported
            status, error = None, f"{type(e).__name__}: {e}"
        if attempt < retries:
            sleep(backoff * (attempt + 1))
    return status, None, None, None, False, retries + 1, error


def from_mirror(requests: DataFrame, mirror: DataFrame) -> DataFrame:
    """The same rows from a stored mirror (url, html, etag, last_modified), where the network is closed or a crawl is repeated.

    A request whose etag, or else whose date, is the stored one gets 304; a URL that isn't stored gets 404.  One equi-join.
    """
    m = mirror.select("url", F.lit(True).alias("__here"), "html", F.col("etag").alias("__etag"), F.col("last_modified").alias("__modified"))
    both = requests.select("source_id", "url", "etag", "last_modified").join(m, "url", "left")
    here = F.col("__here").isNotNull()
    same = F.when(F.col("etag").isNotNull(), F.col("etag") == F.col("__etag")).otherwise(F.col("last_modified") == F.col("__modified"))
    same = here & F.coalesce(same, F.lit(False))
    return both.select(
        "source_id", "url", F.when(~here, 404).when(same, 304).otherwise(200).alias("status"),
        F.when(here, F.when(same, F.lit("")).otherwise(F.col("html"))).alias("html"), F.col("__etag").alias("etag"),
        F.col("__modified").alias("last_modified"), same.alias("not_modified"), F.lit(1).alias("attempts"),
        F.when(~here, F.concat(F.lit("HTTP 404 for "), "url")).alias("error"),
    )


def fetch_pages(
    requests: DataFrame, transport: Transport = http, timeout: float = 10.0, retries: int = 2, backoff: float = 0.5,
    agent: str = "foliospark", sleep: Callable[[float], None] = time.sleep, pause: float = 0.0,
) -> DataFrame:
    """A row for each request (source_id, url, etag, last_modified); a failed one has an error and no text.

    With a ``pause`` all requests to one host are made by one task, one after another, that many seconds apart; hosts
    are fetched side by side.
    """
    ship(requests.sparkSession)
    schema = pa.schema(
        [("source_id", pa.string()), ("url", pa.string()), ("status", pa.int32()), ("html", pa.string()), ("etag", pa.string()),
         ("last_modified", pa.string()), ("not_modified", pa.bool_()), ("attempts", pa.int32()), ("error", pa.string())]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                made = []
                for r in batch.slice(at, 64).to_pylist():
                    if pause and r["host"] == last:
                        sleep(pause)
                    last = r.get("host")
                    made.append((r["source_id"], r["url"], *fetch_one(r["url"], r["etag"], r["last_modified"], transport, timeout, retries, backoff, agent, sleep)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)

    rows = requests.select("source_id", "url", "etag", "last_modified")
    if pause:
        rows = rows.withColumn("host", F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)))
        rows = rows.repartition("host").sortWithinPartitions("host", "url")
    return rows.mapInArrow(run, FETCHED)


def conditions(documents: DataFrame) -> DataFrame:
    """What is known of each URL's last fetch, for the next conditional request."""
    return documents.where(F.coalesce("canonical_url", F.lit("")) != "").select(
        "source_id", F.col("canonical_url").alias("url"), F.nullif("fetch_etag", F.lit("")).alias("etag"),
        F.nullif("fetch_last_modified", F.lit("")).alias("last_modified"),
    )
