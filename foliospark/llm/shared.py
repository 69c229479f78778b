"""What the queries of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliospark.session import materialize, shared_dir

__all__ = ["documents", "materialize", "shared_dir"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
