"""Sinks: appends, versioned upserts, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], update: list[str]) -> DataFrame:
    """Rows of both by key: ``update`` columns of a known key come from ``incoming``, the rest stay.

    One full outer join; of several incoming rows of a key one is taken, as a grouped maximum.
    """
    cols = [c for c in current.columns if c not in keys]
    one = incoming.groupBy(*keys).agg(F.max(F.struct(*cols)).alias("__new"))
    both = current.withColumn("__old", F.lit(True)).join(one, keys, "full")
    new = F.col("__new").isNotNull()
    known = F.col("__old").isNotNull()
    values = [
        F.when(new & ~known | (new & F.lit(c in update)), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) for c in cols
    ]
    return both.select(*keys, *values)


def _files(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def write_version(df: DataFrame, path: str) -> int:
    """Writes the next version of a table beside the others; it counts once its marker is there."""
    latest = latest_version(df.sparkSession, path)
    df.write.parquet(f"{path}/v={latest + 1}")
    return latest + 1


def latest_version(spark: SparkSession, path: str) -> int:
    """Highest version whose write was committed; 0 without one."""
    fs, target = _files(spark, path)
    found = [0]
    for s in fs.listStatus(target) if fs.exists(target) else []:
        name = s.getPath().getName()
        if name.startswith("v=") and fs.exists(_files(spark, f"{path}/{name}/_SUCCESS")[1]):
            found.append(int(name[2:]))
    return max(found)


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/v={latest_version(spark, path)}")


def export_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def json_lines(df: DataFrame) -> DataFrame:
    """A JSON document for each row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("line"))
