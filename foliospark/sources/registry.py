"""Source registry: a JSON array of sources; of equal ids the last one wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

REGISTRY = (
    "id string, name string, kind string, base_url string, trust_score double, poll_interval_minutes int, "
    "sitemap_url string, seed_urls array<string>"
)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(REGISTRY).json(path, multiLine=True)
    placed = rows.withColumn("__at", F.monotonically_increasing_id())
    last = W.partitionBy("id").orderBy(F.col("__at").desc())
    kept = placed.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__at", "__n")
    return kept.select(
        "id", "name", "kind", "base_url",
        F.coalesce("trust_score", F.lit(1.0)).cast("decimal(3,2)").alias("trust_score"),
        F.coalesce("poll_interval_minutes", F.lit(60)).alias("poll_interval_minutes"),
        "sitemap_url", "seed_urls",
    )
