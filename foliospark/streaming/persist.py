"""Exactly-once persistence of a stream of fetched documents.

Every micro-batch is merged into the stored tables (documents, chunks, change
events) by one commit that also notes the batch's number.  Spark hands a batch
over again, with the same number, if it failed before its offsets were written;
such a batch, or one replayed on purpose, finds its number and changes nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliospark.functions import chunks as C
from foliospark.functions import text as T
from foliospark.operators import ingest as I
from foliospark.session import listing, remove, scratch, tidy, version
from foliospark.sources.store import Change, Store

FETCHED = "source_id string, canonical_url string, title string, content string, at timestamp_ntz"
_DOCUMENTS = """document_id string, source_id string, canonical_url string, version_tag string, title string, content string,
 content_hash string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, last_changed_at timestamp_ntz"""
_CHUNKS = """id string, document_id string, chunk_index int, text string, token_count long, heading_path string, code_lang string,
 valid_from timestamp_ntz, valid_to timestamp"""
_EVENTS = """document_id string, event_type string, severity string, detector string, keyword_family string, summary string,
 changed_sections array<string>, changed_section_count long"""
#: A batch is merged in passes of so many bytes, as it lies on disk, but in no more passes than these.
PASS, PASSES = 32 << 20, 8
#: Parts of a bucket's incoming rows.
SPREAD = 64
TABLES = {"documents": _DOCUMENTS, "chunks": _CHUNKS, "events": _EVENTS}


def create(spark: SparkSession, root: str, buckets: int = 64) -> Store:
    """A store with empty tables."""
    store = Store(spark, root, buckets)
    change = store.begin()
    for name, schema in TABLES.items():
        change.overwrite(name, spark.createDataFrame([], schema), "document_id")
    change.commit()
    return store


def document_id(source: Column, url: Column) -> Column:
    return F.concat(F.lit("doc_"), F.sha2(F.concat_ws("\n", source, url), 256))


def _incoming(store: Store, batch: DataFrame, path: str) -> StructType:
    """Writes what a batch brings by bucket: of several fetches of one document the latest.

    Rows are dealt by bucket before they are grouped, so that a text is sent once.
    """
    keys = ["bucket", "__part", "document_id", "source_id", "canonical_url"]
    rows = batch.withColumn("document_id", document_id(F.col("source_id"), F.col("canonical_url")))
    rows = rows.withColumns({"bucket": store.bucket(F.col("document_id")), "__part": F.pmod(F.hash("document_id"), F.lit(SPREAD))})
    one = rows.repartition("bucket", "__part").groupBy(*keys).agg(F.max(F.struct("at", "content", "title")).alias("d"))
    out = one.select(
        "document_id", "source_id", "canonical_url", F.lit(None).cast("string").alias("version_tag"), "d.title",
        F.coalesce("d.content", F.lit("")).alias("content"), "bucket",
    ).withColumn("content_hash", T.content_hash(F.col("content")))
    out.write.option("compression", "zstd").partitionBy("bucket").parquet(path)
    return out.drop("bucket").schema


def _pass(change: Change, incoming: DataFrame, only: set[int], at: Column, path: str) -> None:
    """Merges the incoming documents of some buckets into the three tables."""
    old = change.table("documents", only)
    before = old.select("document_id", F.col("content").alias("previous"), F.col("content_hash").alias("__hash"))
    action = F.when(F.col("__hash").isNull(), "insert").when(F.col("__hash") != F.col("content_hash"), "update").otherwise("touch")
    merged = incoming.join(before, "document_id", "left").select("document_id", "title", "previous", F.col("content").alias("next"), action.alias("action"))
    merged = merged.where("action <> 'touch'")
    # read for two tables, so it is written once
    merged.write.option("compression", "zstd").parquet(path)
    merged = change.spark.read.schema(merged.schema).parquet(path)
    change.append("events", I.run_events(merged, ["document_id"]).select(*change.table("events", set()).columns), "document_id")
    cut = merged.select("document_id", C.chunks(F.col("next")).alias("chunks"))
    change.merge("chunks", cut, "document_id", lambda kept, new: I.replace_chunks(kept, new, at))
    change.merge("documents", incoming, "document_id", lambda kept, new: I.merged_documents(kept, new, at), only)


def persist_batch(store: Store, stream: str, batch: DataFrame, number: int, at: Column) -> bool:
    """Stores a batch of fetched documents (FETCHED), of several fetches of one document the latest; False if it is stored already.

    Only the buckets of the batch's documents are read and written, some of them at a time: besides the store, its next
    version and a copy of the batch, disk holds what one pass needs.
    """
    change = store.begin()
    if change.seen(stream, number):
        return False
    with tidy(batch.sparkSession, store.spark), scratch(store.spark, "batch") as path:
        schema = _incoming(store, batch, path)
        touched = [int(n.removeprefix("bucket=")) for n in listing(store.spark, path) if n.startswith("bucket=")]
        passes = min(len(touched), PASSES, math.ceil(version(store.spark, path)[0] / PASS))
        for k in range(passes):
            only = touched[k::passes]
            parts = [f"{path}/bucket={b}" for b in only]
            with scratch(store.spark, "changed") as changed:
                _pass(change, store.spark.read.schema(schema).parquet(*parts), set(only), at, changed)
            for part in parts:
                remove(store.spark, part)
        change.mark(stream, number)
        change.commit()
    return True


def sync_stream(store: Store, stream: str, fetched: DataFrame, checkpoint: str, at: Column):
    """Starts persisting a stream of fetched documents; what has arrived is stored, then the query ends."""
    handle = lambda batch, number: persist_batch(store, stream, batch, number, at)
    writer = fetched.writeStream.foreachBatch(lambda batch, number: handle(batch, number) and None)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
