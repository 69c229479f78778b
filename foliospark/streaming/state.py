"""State that outlives a micro-batch: rate windows with event-time timers, request states with a time to live.

State lies in RocksDB beside the executors and in the query's checkpoint, so a
lost executor or a restarted query goes on where the last batch ended.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foliospark.session import ship
from foliospark.streaming.sync import decide

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
VERDICT = "key string, id long, at timestamp, allowed boolean, retry_after long"


def prepare(spark: SparkSession) -> None:
    """Streams started from now on keep their state in RocksDB.

    Processors are pickled whole: the worker that reads their state's layout on the driver doesn't see shipped files.
    """
    ship(spark)
    spark.conf.set(_PROVIDER, ROCKS)
    for module in (__name__, decide.__module__):
        cloudpickle.register_pickle_by_value(sys.modules[module])


class RateWindows(StatefulProcessor):
    """Verdicts on requests in the order of their times, whatever order they arrive in.

    Requests wait until the watermark has passed their time, so none before them can still come; then a timer hands
    them to :func:`decide`.  A key's state is what waits and two numbers; once its window is over and nothing waits
    it has none.
    """

    def __init__(self, window_seconds: int, limit: int):
        self.window, self.limit = window_seconds, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, id long")
        self.state = handle.getValueState("window", "start double, count long")

    def _wake(self, at: int | None) -> None:
        """One timer for a key: at the first request that waits, or when its window is over."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if at is not None:
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        new = [(int(t), int(i)) for part in rows for t, i in zip(part["at"].astype("datetime64[us]").astype("int64"), part["id"], strict=True)]
        self.waiting.appendList(new)
        first = min(t for t, _ in new)
        timers = list(self.handle.listTimers())
        at = first // 1000 + 1
        if not timers or at < min(timers):
            self._wake(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get())
        ready, left = [r for r in rows if r[0] < mark], [r for r in rows if r[0] >= mark]
        start, count = self.state.get() or (None, 0)
        if ready:
            times = np.array([t for t, _ in ready], dtype=np.int64)
            ok, retry, start, count = decide(times / 1e6, start, count, self.window, self.limit)
            self.state.update((start, count))
            yield pd.DataFrame({"key": key[0], "id": [i for _, i in ready], "at": times.astype("datetime64[us]"), "allowed": ok, "retry_after": retry})
        if left:
            self.waiting.put(left)
            self._wake(left[0][0] // 1000 + 1)
            return
        self.waiting.clear()
        over = int((start + self.window) * 1000) + 1 if start is not None else 0
        if over * 1000 < mark:
            self.state.clear()
            self._wake(None)
        else:
            self._wake(over)

    def close(self) -> None:
        pass


def rate_limit_stream(requests: DataFrame, window_seconds: int, limit: int, late: str = "10 minutes") -> DataFrame:
    """Verdict on each request (key, id, at): a window opens with a key's first request after the last one ended.

    The same rows as ``sync.rate_limit`` gives for a table, as the watermark passes them; requests later than ``late`` are
    dropped.  A key's requests are decided one after another, so a hot key is one task's.
    """
    prepare(requests.sparkSession)
    rows = requests.select("key", "id", F.col("at").cast("timestamp").alias("at")).withWatermark("at", late)
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=RateWindows(window_seconds, limit), outputStructType=VERDICT, outputMode="Append", timeMode="EventTime"
    )


class RequestStates(StatefulProcessor):
    """Latest status of each request: a change that is older than the stored one only counts.

    A state is forgotten once the watermark is ``kept_ms`` past its last change.
    """

    def __init__(self, kept_ms: int):
        self.kept_ms = kept_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("request", "at long, status string, requested_at long, events long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        at, status, first, n = before = self.state.get() or (-(2**62), "", 2**62, 0)
        for part in rows:
            times = part["at"].astype("datetime64[us]").astype("int64")
            at, status = max((at, status), *zip(times.tolist(), part["status"], strict=True))
            first, n = min(first, int(times.min())), n + len(part)
        self.state.update((at, status, first, n))
        if at > before[0]:
            if before[3]:
                self.handle.deleteTimer(before[0] // 1000 + self.kept_ms)
            self.handle.registerTimer(at // 1000 + self.kept_ms)
        done = status in ("completed", "failed")
        as_time = lambda v: pd.to_datetime([v], unit="us")
        yield pd.DataFrame({
            "request_id": key[0], "status": [status], "requested_at": as_time(first),
            "processed_at": as_time(at if done else None), "events": [n],
        })

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


STATE = "request_id string, status string, requested_at timestamp, processed_at timestamp, events long"


def request_state_stream(changes: DataFrame, kept_hours: int = 24 * 30) -> DataFrame:
    """A request's state whenever it changed (request_id, at, status).

    States live until the latest time of the stream is twice ``kept_hours`` past their last change; changes that come more than
    ``kept_hours`` late are dropped.
    """
    prepare(changes.sparkSession)
    rows = changes.select("request_id", F.col("at").cast("timestamp").alias("at"), "status").withWatermark("at", f"{kept_hours} hours")
    return rows.groupBy("request_id").transformWithStateInPandas(
        statefulProcessor=RequestStates(kept_hours * 3_600_000), outputStructType=STATE, outputMode="Update", timeMode="EventTime"
    )
