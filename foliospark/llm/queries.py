"""Queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from foliospark.llm import merkle, mixing, near_dedup, ogg, packing, pii, preference, quality, secrets, sharding, substring_dedup, url_cascade, whitening
from foliospark.llm.shared import documents


def op1_quality_rules(spark, sf_dir):
    return quality.quality_query(documents(spark, sf_dir))


def op2_source_mixing(spark, sf_dir):
    """Target weights in proportion to the square root of a source's bytes."""
    return mixing.mix_sources(documents(spark, sf_dir)).drop("text_hash")


def op3_secret_scan(spark, sf_dir):
    return secrets.secret_columns(documents(spark, sf_dir))


def op4_substring_dedup(spark, sf_dir):
    return substring_dedup.remove_repeats(documents(spark, sf_dir))


def op5_ogg_media(spark, sf_dir):
    return ogg.media_columns(documents(spark, sf_dir))


def op6_packing(spark, sf_dir):
    import public_tokenizers

    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op7_preference_pairs(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return preference.format_pairs(preference.neighbours(turns))


def op8_personal_data(spark, sf_dir):
    return pii.pii_columns(documents(spark, sf_dir))


def op9_near_duplicates(spark, sf_dir):
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op10_virtual_slots(spark, sf_dir):
    """Law ``bytes``: slots are dealt so that shards hold nearly equal bytes; the map is then edited for 25 shards."""
    from pyspark.sql import functions as F

    placed = sharding.shard_documents(documents(spark, sf_dir), n_shards=24, grown=25)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version", "next_version", "next_shard",
    )


def op11_merkle_manifest(spark, sf_dir):
    return merkle.manifest_query(documents(spark, sf_dir))


def op12_embedding_whitening(spark, sf_dir):
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_url_filter(spark, sf_dir):
    return url_cascade.filter_query(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_source_mixing,
        op3_secret_scan,
        op4_substring_dedup,
        op5_ogg_media,
        op6_packing,
        op7_preference_pairs,
        op8_personal_data,
        op9_near_duplicates,
        op10_virtual_slots,
        op11_merkle_manifest,
        op12_embedding_whitening,
        op13_url_filter,
    )
}
SQL = {
    "op1_quality_rules": quality.SQL,
    "op7_preference_pairs": preference.SQL,
    "op10_virtual_slots": sharding.sql(),
    "op11_merkle_manifest": merkle.sql(),
    "op13_url_filter": url_cascade.SQL,
}
