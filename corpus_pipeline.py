"""A training corpus from ``documents``: filter, deduplicate, redact, mix, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  Stages 1 to 4
return the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import mixing, near_dedup, packing, quality, secrets
from foliospark.llm.shared import documents, materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines above the limit go from those that stay.

    Exact copies count as one document here: the next stage keeps one of them.
    """
    return quality.clean_documents(docs, copies_once=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id.

    Text is shuffled once, by two hashes of id and text, and repeated rows go within their partition: of rows with
    the same id and text any one stays, whatever their other columns.
    """
    groups = near_dedup.near_duplicates(docs, words_in=5, text_hash=True).where("kept")
    known = lambda i, h: (F.xxhash64(i, h).alias("__a"), F.xxhash64(h, i, F.lit(1)).alias("__b"))
    kept = groups.select(*known(F.col("doc_id"), F.col("text_hash")))
    marked = docs.select("*", *known(F.col("doc_id"), F.xxhash64(F.coalesce(docs["text"], F.lit("")))))
    return marked.join(kept, ["__a", "__b"], "left_semi").dropDuplicates(["__a", "__b"]).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text."""
    return secrets.redact_secrets(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the schedule, which the files keep; the next stage packs in that order."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences that follow the schedule.

    Spark reads files by size, so rows are put back into the order in which they were written: by the number of
    the file, its name, and the place in it.  Docs that come from no file keep the order of their partitions.
    """
    import public_tokenizers

    written = ()
    if docs.inputFiles():
        name = F.col("_metadata.file_name")
        number = F.try_to_number(F.regexp_extract(name, r"^part-(\d+)", 1), F.lit("999999999")).cast("long")
        written = (number, name, F.col("_metadata.row_index"))
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), order=written)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("secret scan", secret_scan),
    ("source mix", source_mix),
    ("packing", pack),
]

#: Not expressible in SQL: minhash rounds, the random field and the tokenizer; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``; what a stage returns is written and read again."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
