"""Stored vectors by text and model: a text is embedded once, however often it is asked for.

Texts are known by the digest of what the provider would see.  Digests without
a stored vector go to the provider, once each; vectors, and the round in which
they were last used, are merged into the buckets they touch.  The memo keeps
the rounds used last: whole rounds leave, the oldest first, until at most
``capacity`` vectors are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.session import materialize
from foliospark.sources.embedding import MAX_CHARS, Provider, embed_column
from foliospark.sources.store import Store

_VECTORS = "digest string, model string, vector array<double>, used long"


class EmbeddingMemo:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.store = Store(spark, root, buckets)
        if not self.store.manifests.version():
            change = self.store.begin()
            change.overwrite("vectors", spark.createDataFrame([], _VECTORS), "digest")
            change.commit()

    def vectors(self) -> DataFrame:
        return self.store.table("vectors")

    def embed(self, texts: DataFrame, provider: Provider, model: str, key: str = "chunk_id", failures=None) -> DataFrame:
        """(key, model, vector) of texts that have one; what a provider failed on is asked for again the next time."""
        trimmed = F.substring(F.trim(F.coalesce("text", F.lit(""))), 1, MAX_CHARS)
        rows = texts.select(key, trimmed.alias("text")).withColumn("digest", F.sha2(F.concat_ws("\n", F.lit(model), "text"), 256))
        asked = materialize(rows.groupBy("digest").agg(F.first("text").alias("text")), "asked")
        change = self.store.begin()
        only = change.touched(asked, "digest")
        known = change.table("vectors", only).select("digest")
        fresh = asked.join(known, "digest", "left_anti")
        made = fresh.select("digest", F.lit(model).alias("model"), embed_column(F.col("text"), provider, failures=failures).alias("vector"))
        # written, so that the provider isn't asked again by whatever reads it
        made = materialize(made.where("vector is not null"), "made")
        latest = change.table("vectors").agg(F.max("used")).first()[0]
        turn = F.lit((latest or 0) + 1).cast("long")
        used = asked.select("digest").join(made, "digest", "left").select("digest", F.col("model").alias("__model"), F.col("vector").alias("__vector"))

        def merged(old: DataFrame, new: DataFrame) -> DataFrame:
            both = old.join(new.withColumn("__asked", F.lit(True)), "digest", "full")
            vector = F.coalesce("vector", "__vector")
            out = both.select(
                "digest", F.coalesce("model", "__model").alias("model"), vector.alias("vector"), F.when(F.col("__asked"), turn).otherwise(F.col("used")).alias("used")
            )
            return out.where("vector is not null")

        change.merge("vectors", used, "digest", merged)
        change.commit()
        stored = self.store.begin().table("vectors", only).select("digest", "model", "vector")
        return rows.select(key, "digest").join(stored, "digest").select(key, "model", "vector")

    def evict(self, capacity: int) -> int:
        """Drops the rounds used longest ago until at most ``capacity`` vectors are left; returns how many are left."""
        rounds = sorted(((r["used"], r["count"]) for r in self.vectors().groupBy("used").count().collect()), reverse=True)
        left, oldest = 0, None
        for used, n in rounds:
            if left + n > capacity:
                break
            left, oldest = left + n, used
        if left < sum(n for _, n in rounds):
            change = self.store.begin()
            kept = self.vectors().where(F.col("used") >= F.lit(oldest)) if oldest is not None else self.vectors().limit(0)
            change.overwrite("vectors", kept, "digest")
            change.commit()
        return left
