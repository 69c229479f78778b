"""Tables in hash buckets under one manifest: copy on write, several tables in one commit.

A row lies in the bucket of its key.  A change writes new folders for the
buckets it touches and leaves all others as they are; then it writes the next
manifest, which says for each table and bucket which folders hold it.  A
manifest counts once it is complete, so readers see all tables of a change or
none, and a writer that is lost leaves only folders that :meth:`Store.vacuum`
removes.  Two writers that start from one version can't both commit.

The manifest also keeps the last batch of each stream that was stored, in the
same commit as the batch's rows: a batch that comes again changes nothing.

Choose the number of buckets so that one holds a few GB; buckets that grow
beyond a task's share are written by several tasks.  The driver sees at most
that many bucket numbers.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliospark.session import listing, remove

_ROW = "kind string, name string, bucket int, value string"


class Manifests:
    """Numbered tables of (kind, name, bucket, value) in a folder; the latest complete one is in force."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def version(self) -> int:
        done = (int(n) for n in listing(self.spark, self.path) if n.isdigit() and "_SUCCESS" in listing(self.spark, f"{self.path}/{n}"))
        return max(done, default=0)

    def read(self, version: int) -> list[tuple]:
        if not version:
            return []
        return [tuple(r) for r in self.spark.read.schema(_ROW).parquet(f"{self.path}/{version:08d}").collect()]

    def commit(self, after: int, rows: list[tuple]) -> int:
        """Writes the version behind ``after``; fails if another writer was faster."""
        try:
            self.spark.createDataFrame(rows, _ROW).coalesce(1).write.parquet(f"{self.path}/{after + 1:08d}")
        except AnalysisException as e:
            raise RuntimeError(f"version {after + 1} was written by another change") from e
        return after + 1


class Store:
    """Bucketed tables under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.manifests = Manifests(spark, f"{self.root}/manifest")

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.buckets)).cast("int")

    def begin(self) -> Change:
        return Change(self)

    def table(self, name: str) -> DataFrame:
        """The table as the latest commit left it."""
        return self.begin().table(name)

    def vacuum(self) -> list[str]:
        """Removes folders that the latest manifest doesn't name; returns their names."""
        kept = {v.split("/")[-1] for k, _, _, v in self.manifests.read(self.manifests.version()) if k == "data"}
        old = [n for n in listing(self.spark, f"{self.root}/data") if n not in kept]
        for name in old:
            remove(self.spark, f"{self.root}/data/{name}")
        return old


class Change:
    """What is to become the next version; nothing holds before :meth:`commit`."""

    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark
        self.version = store.manifests.version()
        self.rows = store.manifests.read(self.version)

    def seen(self, stream: str, batch: int) -> bool:
        """Whether a batch of a stream is stored."""
        return any(k == "batch" and n == stream and int(v) >= batch for k, n, _, v in self.rows)

    def mark(self, stream: str, batch: int) -> None:
        self.rows = [r for r in self.rows if r[:2] != ("batch", stream)] + [("batch", stream, -1, str(batch))]

    def folders(self, name: str) -> list[tuple[int, str]]:
        return [(b, v) for k, n, b, v in self.rows if k == "data" and n == name]

    def table(self, name: str, only: set[int] | None = None) -> DataFrame:
        """The table, or ``only`` some of its buckets: no file of another one is opened."""
        schema = next(StructType.fromJson(json.loads(v)) for k, n, _, v in self.rows if k == "schema" and n == name)
        paths = [f"{self.store.root}/data/{v}/bucket={b}" for b, v in self.folders(name) if only is None or b in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, name: str, rows: DataFrame, key: str) -> list[tuple]:
        folder = f"{name}-{uuid.uuid4().hex}"
        dealt = rows.withColumn("bucket", self.store.bucket(F.col(key))).hint("rebalance", F.col("bucket"))
        dealt.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.store.root}/data/{folder}")
        names = listing(self.spark, f"{self.store.root}/data/{folder}")
        return [("data", name, int(n.removeprefix("bucket=")), folder) for n in names if n.startswith("bucket=")]

    def _schema(self, name: str, rows: DataFrame) -> None:
        if not any(r[:2] == ("schema", name) for r in self.rows):
            self.rows.append(("schema", name, -1, rows.schema.json()))

    def overwrite(self, name: str, rows: DataFrame, key: str) -> None:
        new = self._write(name, rows, key)
        self.rows = [r for r in self.rows if r[:2] not in (("data", name), ("schema", name))] + new
        self._schema(name, rows)

    def append(self, name: str, rows: DataFrame, key: str) -> None:
        self._schema(name, rows)
        self.rows += self._write(name, rows, key)

    def touched(self, incoming: DataFrame, key: str) -> set[int]:
        """Buckets of the given keys: at most as many numbers as there are buckets."""
        return {r[0] for r in incoming.select(self.store.bucket(F.col(key))).distinct().collect()}

    def merge(
        self, name: str, incoming: DataFrame, key: str, merged: Callable[[DataFrame, DataFrame], DataFrame], only: set[int] | None = None
    ) -> set[int]:
        """Rewrites the buckets that ``incoming`` touches as ``merged(their rows, incoming)``; returns their numbers.

        Give ``only`` if they are known.
        """
        only = self.touched(incoming, key) if only is None else only
        old = self.table(name, only)
        new = self._write(name, merged(old, incoming).select(*old.columns), key)
        self.rows = [r for r in self.rows if not (r[:2] == ("data", name) and r[2] in only)] + new
        return only

    def commit(self) -> int:
        self.version = self.store.manifests.commit(self.version, self.rows)
        return self.version
