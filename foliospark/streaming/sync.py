"""Streams of sync requests: deduplication, state folding, and a fixed-window rate counter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliospark.session import ship

REQUEST = "request_id string, source_id string, status string, at timestamp"


def request_stream(spark: SparkSession, path: str) -> DataFrame:
    """Requests as they arrive in a folder of JSON lines, once for each id and status."""
    rows = spark.readStream.schema(REQUEST).json(path)
    return rows.withWatermark("at", "1 hour").dropDuplicatesWithinWatermark(["request_id", "status"])


def request_state(events: DataFrame) -> DataFrame:
    """Latest status of each request: queued, processing, completed or failed."""
    latest = events.groupBy("request_id").agg(
        F.max(F.struct("at", "status")).alias("last"), F.min("at").alias("requested_at"), F.count(F.lit(1)).alias("events")
    )
    done = F.col("last.status").isin("completed", "failed")
    return latest.select(
        "request_id", F.col("last.status").alias("status"), "requested_at",
        F.when(done, F.col("last.at")).alias("processed_at"), "events",
    )


def start(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands every micro-batch to ``handle``; a batch that failed is handed over again with the same number."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_DECISION = "key string, at timestamp, allowed boolean, retry_after int"


def decide(times: np.ndarray, start: float | None, count: int, window: float, limit: int) -> tuple[np.ndarray, np.ndarray, float | None, int]:
    """Verdicts on ascending times: allowed, seconds to wait, and the state after them.

    One step for each window, not for each request.
    """
    allowed, retry = np.zeros(len(times), dtype=bool), np.zeros(len(times), dtype=np.int64)
    at = 0
    while at < len(times):
        if start is None or times[at] >= start + window:
            start, count = float(times[at]), 0
        end = int(np.searchsorted(times, start + window))
        some = min(max(0, limit - count), end - at)
        allowed[at : at + some] = True
        retry[at + some : end] = np.ceil(start + window - times[at + some : end])
        count += some
        at = end
    return allowed, retry, start, count


def rate_limit_stream(requests: DataFrame, window_seconds: int, limit: int) -> DataFrame:
    """Verdict on each request (key, at): a window opens with a key's first request and lasts ``window_seconds``.

    The state of a key is two numbers and is dropped once its window is over.
    """

    ship(requests.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start_, count = state.get if state.exists else (None, 0)
        at = np.sort(np.concatenate([part["at"].to_numpy(dtype="datetime64[ns]") for part in batches]))  # 8 bytes a request
        ok, retry, start_, count = decide(at.astype(np.int64) / 1e9, start_, count, window_seconds, limit)
        state.update((start_, count))
        state.setTimeoutDuration(window_seconds * 1000)
        for k in range(0, len(at), 8192):
            part = slice(k, k + 8192)
            yield pd.DataFrame({"key": key[0], "at": at[part], "allowed": ok[part], "retry_after": retry[part]})

    return requests.groupBy("key").applyInPandasWithState(
        step, _DECISION, "start double, count long", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def rate_limit(requests: DataFrame, window_seconds: int, limit: int) -> DataFrame:
    """The same verdicts over a table (key, id, at).

    Windows open at a key's first request after the last one ended, which is
    sequential within a key, so keys are sorted and streamed through a task;
    the state carried from batch to batch is a key and two numbers.
    """

    ship(requests.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, start_, count = None, None, 0
        for part in batches:
            if not len(part):
                continue
            keys, times = part["key"].to_numpy(), part["at"].to_numpy(dtype="datetime64[ns]").astype(np.int64) / 1e9
            firsts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            allowed, retry = np.zeros(len(part), dtype=bool), np.zeros(len(part), dtype=np.int64)
            for a, b in zip(firsts, np.append(firsts[1:], len(part)), strict=True):
                if keys[a] != key:
                    key, start_, count = keys[a], None, 0
                allowed[a:b], retry[a:b], start_, count = decide(times[a:b], start_, count, window_seconds, limit)
            yield part.assign(allowed=allowed, retry_after=retry)

    ordered = requests.select("key", "id", "at").repartition("key").sortWithinPartitions("key", "at", "id")
    return ordered.mapInPandas(run, "key string, id long, at timestamp_ntz, allowed boolean, retry_after long")
