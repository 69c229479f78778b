"""Session helpers: shipping the package, tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import ExitStack, contextmanager

from pyspark.sql import DataFrame, SparkSession

_ATTR = "_foliospark_shipped"


def ship(spark: SparkSession) -> None:
    """Makes this package importable on executors; once for each context.

    Spark serves the archive to executors itself, so it may lie in a folder of the driver.
    """
    sc = spark.sparkContext
    if getattr(sc, _ATTR, False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    place = os.path.join(tempfile.mkdtemp(prefix="folio-ship-"), "foliospark.zip")
    with zipfile.ZipFile(place, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.join("foliospark", os.path.relpath(path, root)))
    sc.addPyFile(place)
    setattr(sc, _ATTR, True)


def local(cores: int = 8, partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary one is set only in local mode, where it is unset (tests).

    On a cluster executors don't see the driver's temporary folders, so a session without one is refused.
    """
    sc = spark.sparkContext
    place = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        place = tempfile.mkdtemp(prefix="folio-shared-")
        sc.setCheckpointDir(place)
    return place


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session may have ended first; the folder is then the cluster's to clean
        pass


def listing(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(target)) if fs.exists(target) else []


def version(spark: SparkSession, path: str) -> tuple[int, int]:
    """Bytes and latest change of a table's files: differs once the table was written anew."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(target, True)
    size = last = 0
    while files.hasNext():
        status = files.next()
        size, last = size + status.getLen(), max(last, status.getModificationTime())
    return size, last


_written: list[tuple[SparkSession, str]] = []
_caches: list[dict] = []


def cache() -> dict:
    """A dictionary of tables that are written once and read again; :func:`drop_tables` empties it."""
    _caches.append({})
    return _caches[-1]


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed with the intermediate tables."""
    path = f"{shared_dir(spark)}/folio/{name}-{uuid.uuid4().hex}"
    remember(spark, path)
    return path


def remember(spark: SparkSession, path: str) -> None:
    """Has a folder removed by :func:`drop_tables`, or else when the driver's interpreter ends."""
    _written.append((spark, path))


@atexit.register
def drop_tables() -> None:
    """Removes all intermediate tables written so far; call it once the results that read them are stored."""
    for known in _caches:
        known.clear()
    while _written:
        _forget(*_written.pop())


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back.

    Cuts the lineage: a lost executor costs a reread, not a recomputation.
    The table lives until :func:`drop_tables` or the end of the driver's interpreter.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """A new path in the shared folder that is removed at the end of the block."""
    path = new_folder(spark, name)
    try:
        yield path
    finally:
        _forget(spark, path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(*sessions: SparkSession) -> Iterator[None]:
    """Within the block shuffle files go when the job that wrote them ends, not when the driver happens to collect its garbage."""
    with ExitStack() as after:
        for spark in sessions:
            before = spark.conf.get(_CLEANUP, None)
            after.callback(*(spark.conf.unset, _CLEANUP) if before is None else (spark.conf.set, _CLEANUP, before))
            spark.conf.set(_CLEANUP, "true")
        yield
