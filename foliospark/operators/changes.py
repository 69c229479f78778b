"""Change detection against stored section digests.

A document is stored with a digest of each section's text (of equal headings
the last one's), the hash of its text, and whether it already has wording of
breaking changes and of deprecations.  A sync cuts what it fetched into sections
where it is read and joins their digests by document and heading: narrow rows,
one hash join, however many sections a document has.  Text is looked at again
only for documents with a digest that differs, and of them only those sections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import chunks as C
from foliospark.functions import text as T
from foliospark.operators.ingest import events_of, wording

def _digest(body: Column) -> Column:
    """Two hashes, 128 bits."""
    return F.struct(F.xxhash64(body).alias("a"), F.xxhash64(F.lit(1), body).alias("b"))


def section_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, place, heading, digest) of each section; no text."""
    cut = F.transform(C.diff_sections(docs[text]), lambda s: F.struct(s["heading"].alias("heading"), _digest(s["body"]).alias("digest")))
    return docs.select(docs[key].alias(key), F.posexplode(cut).alias("place", "s")).select(key, "place", "s.heading", "s.digest")


def section_digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, heading, digest) to be stored with each document; of equal headings the last section counts."""
    rows = section_rows(docs, key, text).groupBy(key, "heading").agg(F.max_by("digest", "place").alias("digest"))
    return rows.select(key, "heading", "digest")


def document_states(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, content_hash, before) to be stored with each document: the hash of its text and the wording it has."""
    return docs.select(key, T.content_hash(F.col(text)).alias("content_hash"), wording(F.col(text)).alias("before"))


def differing_sections(digests: DataFrame, incoming: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, places) of incoming documents with sections whose text, as it stands, isn't the stored one."""
    known = digests.select(F.col(key).alias("__key"), F.col("heading").alias("__heading"), F.col("digest").alias("__digest"))
    rows = section_rows(incoming, key, text)
    both = rows.join(known, (rows[key] == known["__key"]) & (rows["heading"] == known["__heading"]), "left")
    moved = both.where(F.col("__digest").isNull() | (F.col("digest") != F.col("__digest")))
    return moved.groupBy(key).agg(F.collect_set("place").alias("places"))


def change_events(stored: DataFrame, digests: DataFrame, states: DataFrame, incoming: DataFrame, key: str = "doc_id") -> DataFrame:
    """Events of changed documents by key, as ``ingest.change_events`` gives them.

    ``stored`` (key, text) is read for documents with a differing section, to compare normal forms; ``incoming``
    has key, title and text; documents that aren't stored, or whose text is the stored one, give none.
    """
    known = incoming.join(states, key).where(T.content_hash(F.col("text")) != F.col("content_hash")).drop("content_hash")
    places = differing_sections(digests, known, key)
    rows = known.join(places, key, "left").withColumn("places", F.coalesce("places", F.array().cast("array<int>")))
    rows = rows.join(stored.select(key, F.col("text").alias("__old")), key)

    def moved(before: Column) -> Column:
        def differs(s: Column) -> Column:
            was = F.coalesce(F.try_element_at(F.filter(before, lambda p: p["heading"] == s["heading"]), F.lit(-1))["body"], F.lit(""))
            return T.diff_form(was) != T.diff_form(s["body"])

        picked = F.filter(C.diff_sections(F.col("text")), lambda s, i: F.array_contains("places", i))
        return F.filter(picked, differs)

    changed = T.let(C.diff_sections(F.col("__old")), moved)
    seen = T.let(changed, lambda c: F.struct(wording(F.array_join(F.transform(c, lambda s: s["body"]), "\n")).alias("now"), c.alias("c")))
    rows = rows.select(key, "title", "before", F.explode(F.array(seen)).alias("j"))
    both = F.struct(*((F.col("j.now")[k] & ~F.col("before")[k]).alias(k) for k in ("breaking", "deprecated")))
    judged = rows.select(key, "title", both.alias("flags"), F.transform("j.c", lambda s: s["heading"]).alias("headings"))
    return events_of(judged, [key])
