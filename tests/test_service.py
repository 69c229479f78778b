"""Fixed cases of fetches, requests, jobs and settings."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from foliospark.functions import settings
from foliospark.operators import ingest as I
from foliospark.operators import ops as O
from foliospark.operators import requests as Q
from foliospark.sources import fetch
from foliospark.streaming import queue


def _fetched(answers, etag=None, retries=2):
    """Result, headers of each attempt and pauses of a fetch whose attempts give ``answers``."""
    asked, slept = [], []

    def transport(url, headers, timeout, attempt):
        asked.append(headers)
        got = answers[attempt]
        if isinstance(got, Exception):
            raise got
        return got

    return fetch.fetch_one("u", etag, None, transport, 10.0, retries, 0.5, "agent", slept.append), asked, slept


def test_fetch_retries_with_growing_pauses():
    out, asked, slept = _fetched([TimeoutError("late"), (503, "", {}), (200, "text", {"etag": "e"})], etag="old")
    assert out == (200, "text", "e", None, False, 3, None) and slept == [0.5, 1.0]
    assert asked[0] == {"user-agent": "agent", "if-none-match": "old"}
    out, _, slept = _fetched([(500, "", {})] * 3)
    assert out == (500, None, None, None, False, 3, "HTTP 500 for u") and slept == [0.5, 1.0]
    assert _fetched([OSError("gone")], retries=0)[0] == (None, None, None, None, False, 1, "OSError: gone")
    assert _fetched([(304, "", {"last-modified": "then"})], etag="old")[0] == (304, "", None, "then", True, 1, None)


def test_fetch_of_no_requests(spark):
    none = spark.createDataFrame([], "source_id string, url string, etag string, last_modified string")
    assert fetch.fetch_pages(none).count() == 0


def test_waits_double_and_end(spark):
    rows = spark.range(6).select(queue.waits(F.col("id")).alias("w")).collect()
    assert [r["w"] for r in rows] == [[], [3000], [3000, 6000], [3000, 6000], [3000, 6000], [3000, 6000]]


def test_jobs_by_request_id(spark):
    asked = spark.createDataFrame([("a", "s1", "2024-01-01"), ("a", "s1", "2024-01-02"), ("b", "s2", "2024-01-01"), ("c", None, "2024-01-01")], "request_id string, source_id string, requested_at string")
    jobs = queue.enqueue(asked, O.TenantPolicy(deny_sources=("s2",)).sync_column(F.col("source_id")))
    made = spark.createDataFrame([("a", False), ("a", False), ("a", False)], "job_id string, ok boolean")
    out = {r["job_id"]: (r["state"], r["attempts_made"], r["waits"]) for r in queue.job_states(jobs, made).collect()}
    assert out == {"a": ("failed", 3, [3000, 6000]), "b": ("failed", 0, []), "c": ("failed", 0, [])}


def test_first_arrival_of_equal_times(spark):
    """Of requests with one time the one that came first makes the job, whatever its source is called."""
    rows = [(1, "a", "s9", "2024-01-01"), (2, "a", "s1", "2024-01-01"), (3, "b", "s1", "2024-01-02"), (4, "b", "s9", "2024-01-01")]
    asked = spark.createDataFrame(rows, "event_id long, request_id string, source_id string, requested_at string")
    jobs = queue.enqueue(asked, O.TenantPolicy().sync_column(F.col("source_id")), ("event_id",))
    assert {r["job_id"]: r["source_id"] for r in jobs.collect()} == {"a": "s9", "b": "s9"}


@pytest.mark.parametrize("text", ["", "  ", "help", " HELP ", "search  a b ", "Search ", "search", "searching x", "changes", "changes src1 more", "CHANGES  x", "changeset y", "how do I?", " what "])
def test_commands_same_as_command(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(Q.commands(F.col("t")).alias("c")).first()["c"]
    assert (row["verb"], row["argument"]) == Q.command(text)


def test_signature_same_as_library(spark):
    rows = []
    for key in ("s", "k" * 64, "long " * 40):
        for body in ("", "é body", "x" * 500):
            digest = "v0=" + hmac.new(key.encode(), f"v0:100:{body}".encode(), hashlib.sha256).hexdigest()
            df = spark.createDataFrame([(100, body, digest), (100, body + "!", digest), (900, body, digest), (100, body, None)], "at long, body string, sig string")
            ok = Q.signature_ok(key, F.col("at"), F.col("body"), F.col("sig"), F.lit(350))
            rows.append([r["ok"] for r in df.select(ok.alias("ok")).collect()])
    assert rows == [[True, False, False, False]] * 9


def test_settings(spark):
    df = spark.createDataFrame([(x,) for x in (None, "", "Yes", "no", "nan", "7", "CRITICAL")], "x string")
    x = F.col("x")
    got = df.select(settings.as_flag(x, True).alias("f"), settings.as_severity(x).alias("s"), settings.as_number(x, 3, 5).alias("n")).collect()
    assert [r["f"] for r in got] == [True, True, True, False, False, False, False]
    assert [r["s"] for r in got] == ["medium"] * 6 + ["critical"] and [r["n"] for r in got] == [5.0, 5.0, 5.0, 5.0, 5.0, 7.0, 5.0]


def test_no_alerts_no_message(spark):
    e = spark.createDataFrame([("1", "s", "u", "t", "updated", "critical", "x", "2024-01-01")], "id string, source_id string, url string, title string, event_type string, severity string, summary string, detected_at string")
    assert O.alert_messages(e).count() == 0
    assert O.alert_messages(e, include_updated=True).first()["message"].startswith("s: 1 change\n- [CRITICAL] updated: t")


def test_snapshot_without_fetches_names_its_request(spark):
    p = spark.createDataFrame([("s", "u1", 500, False, 0, "bad", 1)], "source_id string, url string, status int, accepted boolean, removed_lines int, error string, place int")
    row = I.run_snapshots(p, F.lit("r1")).first()
    assert (row["raw_blob_ref"], row["status"], row["error"]) == ("queue://source-sync/r1", "failed", "bad")


def test_defaults_and_limits(spark):
    df = spark.createDataFrame([("q", None, None), ("query", 51, "odd"), (None, 3, "concise")], "query string, top_k int, style string")
    got = [(r["top_k"], r["style"], r["violations"]) for r in Q.violations(Q.defaulted(df)).collect()]
    assert got == [(10, "concise", ["query"]), (51, "odd", ["top_k", "style"]), (3, "concise", ["query"])]


def test_fetches_by_host(spark, tmp_path):
    """Three attempts for each URL, conditional requests, and a pause between requests to one host."""

    def server(url, headers, timeout, attempt):
        """Answers by the number at the end of a URL: some always fail, some at first, some know their state."""
        n = int(url.rsplit("/", 1)[1])
        if n % 11 == 0:
            return 500, "", {}
        if n % 7 == 0 and attempt < 1 + n % 3:
            raise TimeoutError("slow")
        if headers.get("if-none-match") == f'"e{n}"':
            return 304, "", {"etag": f'"e{n}"'}
        return 200, f"page {n} for {headers['user-agent']}", {"etag": f'"e{n}"', "last-modified": "then"}

    rows = [(f"s{n}", f"https://h{n % 3}.org/p/{n}", f'"e{n}"' if n % 5 == 0 else None, None) for n in range(1, 60)]
    asked = spark.createDataFrame(rows, "source_id string, url string, etag string, last_modified string").repartition(7)
    slept = spark.sparkContext.accumulator(0.0)
    out = fetch.fetch_pages(asked, server, backoff=0.0, pause=2.0, sleep=lambda x: slept.add(x)).collect()
    by = {int(r["source_id"][1:]): r for r in out}
    assert len(out) == 59 and slept.value == 2.0 * (59 - 3)
    for n, r in by.items():
        lost = n % 11 == 0 or (n % 7 == 0 and n % 3 == 2)
        assert r["attempts"] == (3 if lost else 2 + n % 3 if n % 7 == 0 else 1) and (r["error"] is not None) == lost
        assert r["status"] == (500 if n % 11 == 0 else None if lost else 304 if n % 5 == 0 else 200)
        assert r["html"] == (None if lost else "" if n % 5 == 0 else f"page {n} for foliospark")


def test_fetches_from_a_mirror(spark):
    mirror = spark.createDataFrame([("u", "text", "e", None), ("v", None, None, "then")], "url string, html string, etag string, last_modified string")
    rows = [("1", "u", None, None), ("2", "u", "e", None), ("3", "u", "old", "then"), ("4", "v", None, "then"), ("5", "w", "e", None), ("6", None, None, None)]
    asked = spark.createDataFrame(rows, "source_id string, url string, etag string, last_modified string")
    got = {r["source_id"]: (r["status"], r["html"], r["not_modified"]) for r in fetch.from_mirror(asked, mirror).collect()}
    assert got == {"1": (200, "text", False), "2": (304, "", True), "3": (200, "text", False), "4": (304, "", True), "5": (404, None, False), "6": (404, None, False)}
