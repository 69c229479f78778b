"""Bucketed tables, commits, and exactly-once persistence."""

import os

import pytest
from pyspark.sql import functions as F

from foliospark.plans import registry
from foliospark.session import listing, shared_dir
from foliospark.sources import sinks
from foliospark.sources.store import Store
from foliospark.streaming import persist


def files(root):
    return {os.path.join(d, n) for d, _, names in os.walk(os.path.join(root, "data")) for n in names if n.endswith(".parquet")}


def rows(df):
    return sorted(map(str, df.collect()))


def test_upsert_leaves_untouched_buckets(spark, tmp_path):
    store = Store(spark, str(tmp_path), 8)
    table = spark.range(200).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("v"), F.lit("x").alias("w"))
    build = store.begin()
    build.overwrite("t", table, "k")
    build.commit()
    before = files(tmp_path)
    known = {(r["k"], r["v"]) for r in store.table("t").collect()}
    assert len(known) == 200
    new = spark.createDataFrame([("3", 7, "y"), ("new", 8, "z"), (None, 9, "null key")], "k string, v int, w string")
    change = store.begin()
    only = change.merge("t", new, "k", lambda old, inc: sinks.upsert(old, inc, ["k"], ["v"]))
    assert rows(store.table("t")) == rows(table)  # nothing holds before the commit
    change.commit()
    got = {r["k"]: (r["v"], r["w"]) for r in store.table("t").collect()}
    assert got["3"] == (7, "x") and got["new"] == (8, "z") and got[None] == (9, "null key") and len(got) == 202
    # new files only in the touched buckets, and all earlier ones are still there
    added = files(tmp_path) - before
    assert before <= files(tmp_path) and {int(p.split("bucket=")[1].split("/")[0]) for p in added} == only and len(only) < 4
    # of the other buckets no file is opened
    plan = store.begin().table("t", only).inputFiles()
    assert plan and all(int(p.split("bucket=")[1].split("/")[0]) in only for p in plan)


def test_commits(spark, tmp_path):
    store = Store(spark, str(tmp_path), 4)
    t = spark.range(20).select(F.col("id").cast("string").alias("k"))
    first = store.begin()
    first.overwrite("a", t, "k")
    first.append("b", t.limit(5), "k")
    first.commit()
    one, other = store.begin(), store.begin()
    one.append("b", t.limit(3), "k")
    other.overwrite("a", t.limit(1), "k")
    one.commit()
    with pytest.raises(RuntimeError):
        other.commit()
    assert store.table("a").count() == 20 and store.table("b").count() == 8
    # a bucket that loses its rows, a table that loses all
    change = store.begin()
    change.merge("a", t, "k", lambda old, new: old.limit(0))
    change.commit()
    assert store.table("a").count() == 0 and store.table("a").columns == ["k"]
    # a writer that was lost leaves a manifest without its marker
    os.makedirs(tmp_path / "manifest" / "00000004")
    assert store.table("b").count() == 8 and store.vacuum() and store.table("b").count() == 8 and not store.vacuum()


def _fetched(spark, rows_):
    return spark.createDataFrame(rows_, "source_id string, canonical_url string, title string, content string, t string").select(
        "source_id", "canonical_url", "title", "content", F.col("t").cast("timestamp_ntz").alias("at")
    )


def test_stream_is_stored_once(spark, tmp_path):
    """A batch replayed on purpose, one that failed half way, and a restarted stream leave equal tables."""
    at = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    store = persist.create(spark, str(tmp_path / "store"), 4)
    inbox, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    first = [("s", f"u{i}", f"t{i}", f"text {i}", "2024-01-01 00:00:00") for i in range(9)] + [("s", "u0", "late", "later text", "2024-01-01 01:00:00"), ("s", "u8", None, None, "2024-01-02 00:00:00")]
    _fetched(spark, first).write.parquet(inbox)
    stream = lambda: persist.sync_stream(store, "docs", spark.readStream.schema(persist.FETCHED).parquet(inbox), checkpoint, at)
    stream().awaitTermination()
    tables = {t: rows(store.table(t)) for t in persist.TABLES}
    assert [len(tables[t]) for t in ("documents", "chunks", "events")] == [9, 9, 9]
    assert {r["title"] for r in store.table("documents").collect()} >= {"late", "t1"}
    version = store.manifests.version()
    stream().awaitTermination()  # nothing new arrived
    assert not persist.persist_batch(store, "docs", _fetched(spark, first[:3]), 0, at)
    assert store.manifests.version() == version and {t: rows(store.table(t)) for t in persist.TABLES} == tables
    second = [("s", "u1", "t1", "text 1 is deprecated", "2024-01-03 00:00:00"), ("s", "u2", "t2", "text 2", "2024-01-03 00:00:00"), ("s", "new", "n", "text", "2024-01-03 00:00:00")]
    # a batch that dies before its commit is not there, and its repetition is stored whole
    whole = persist.I.replace_chunks
    persist.I.replace_chunks = None
    with pytest.raises(TypeError):
        persist.persist_batch(store, "docs", _fetched(spark, second), 1, at)
    persist.I.replace_chunks = whole
    assert store.manifests.version() == version and {t: rows(store.table(t)) for t in persist.TABLES} == tables
    for _ in range(2):
        persist.persist_batch(store, "docs", _fetched(spark, second), 1, at)
    assert [store.table(t).count() for t in ("documents", "chunks", "events")] == [10, 10, 11]
    assert sorted(r["event_type"] for r in store.table("events").collect()).count("deprecation") == 1


def test_batch_in_passes(spark, tmp_path, monkeypatch):
    """A batch merged in passes gives what one pass gives; its copies and shuffle files are gone afterwards, by one commit."""
    at = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    first = [("s", f"u{i}", f"t{i}", f"text {i}\n## A\nb", "2024-01-01 00:00:00") for i in range(40)]
    second = [("s", f"u{i}", f"t{i}", f"text {i}" + "\n## B\nis deprecated" * (i % 3), "2024-01-02 00:00:00") for i in range(20, 60)] + [("s", "u20", "late", None, "2024-01-03 00:00:00")]
    folder = f"{shared_dir(spark)}/folio"
    before, tables, parts = set(listing(spark, folder)), [], []
    merge = persist._pass
    monkeypatch.setattr(persist, "_pass", lambda change, incoming, only, *rest: parts[-1].append(only) or merge(change, incoming, only, *rest))
    for size in (1 << 40, 1):
        monkeypatch.setattr(persist, "PASS", size)
        store = persist.create(spark, str(tmp_path / str(size)), 4)
        for number, batch in enumerate((first, second)):
            parts.append([])
            assert persist.persist_batch(store, "docs", _fetched(spark, batch), number, at) and store.manifests.version() == number + 2
        tables.append({t: rows(store.table(t)) for t in persist.TABLES})
    assert tables[0] == tables[1] and [len(tables[0][t]) for t in ("documents", "events")] == [60, 80]
    assert list(map(len, parts)) == [1, 1, 4, 4] and all(sorted(b for p in found for b in p) == [0, 1, 2, 3] for found in parts)
    assert set(listing(spark, folder)) == before


def test_sync_keeps_one_version(spark, sf_dir):
    """What arrived and the version before a sync go with it."""
    folder = f"{shared_dir(spark)}/folio"
    before = set(listing(spark, folder))
    assert registry.QUERIES["sync_stream"](spark, sf_dir).count() > 0
    new = {n.rsplit("-", 1)[0]: n for n in set(listing(spark, folder)) - before}
    assert set(new) == {"inbox", "store", "stream"} and not listing(spark, f"{folder}/{new['inbox']}")
    assert not Store(spark, f"{folder}/{new['store']}").vacuum()
