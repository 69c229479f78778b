"""Queue of sync jobs: requests in, jobs with attempts and growing waits out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ATTEMPTS = 3
DELAY_MS = 3000
KEPT = 1000


def enqueue(requests: DataFrame, allowed: Column, arrival: Sequence[str] = ()) -> DataFrame:
    """A job for each request id, however often it arrives; what the policy doesn't allow fails at once.

    ``requests`` has request_id, source_id and requested_at.  The first request counts; of those
    with the same time the first by the columns ``arrival``.
    """
    one = requests.groupBy("request_id").agg(F.min(F.struct("requested_at", *arrival, "source_id")).alias("r"))
    rows = one.select(F.col("request_id").alias("job_id"), "r.source_id", "r.requested_at")
    ok = F.coalesce(allowed, F.lit(False))
    return rows.select(
        "job_id", "source_id", "requested_at", F.when(ok, "queued").otherwise("failed").alias("status"),
        F.when(~ok, "policy_blocked_for_source_sync").alias("error"), F.lit(ATTEMPTS).alias("attempts"),
    )


def waits(failures: Column) -> Column:
    """Milliseconds before each retry: doubled every time, none after the last attempt."""
    n = F.least(failures.cast("int"), F.lit(ATTEMPTS - 1))
    steps = F.sequence(F.lit(1), n)
    none = F.array().cast("array<bigint>")
    return F.when(n > 0, F.transform(steps, lambda k: (F.lit(DELAY_MS) * F.pow(F.lit(2.0), k - 1)).cast("long"))).otherwise(none)


def job_states(jobs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """State of each job after its attempts: ``outcomes`` has job_id and ok, a row for each attempt made."""
    counted = outcomes.groupBy("job_id").agg(F.count_if(~F.col("ok")).alias("failures"))
    both = jobs.join(counted, "job_id", "left").withColumn("failures", F.coalesce("failures", F.lit(0)))
    gone = (F.col("status") == "failed") | (F.col("failures") >= F.col("attempts"))
    made = F.when(F.col("status") == "failed", 0).otherwise(F.least(F.col("failures") + 1, F.col("attempts"))).cast("long")
    return both.select(
        "job_id", "source_id", "requested_at", F.when(gone, "failed").otherwise("completed").alias("state"),
        made.alias("attempts_made"), F.when(F.col("status") == "failed", F.array().cast("array<bigint>")).otherwise(waits(F.col("failures"))).alias("waits"),
    )


def retained(states: DataFrame, most: int = KEPT) -> DataFrame:
    """Of finished jobs the newest ``most`` completed and the newest ``most`` failed ones are kept."""
    newest = lambda s: states.where(F.col("state") == s).orderBy(F.desc("requested_at"), "job_id").limit(most)
    return newest("completed").union(newest("failed"))
