"""Streams with state against the same fold over a table."""

from pyspark.sql import functions as F

from foliospark.streaming import state, sync


def _run(out, checkpoint, mode):
    got = []
    q = out.writeStream.outputMode(mode).foreachBatch(lambda df, n: got.extend((n, *r) for r in df.collect()))
    q.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return got


def test_rate_windows_over_batches(spark, tmp_path):
    """Requests in several batches, out of order within the watermark, and a restart in between."""
    rows = spark.range(300).select(
        F.concat(F.lit("k"), (F.col("id") % 4).cast("string")).alias("key"), "id",
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=(F.col("id") * 7 + F.pmod(F.xxhash64("id"), F.lit(40))).cast("int"))).alias("at"),
    )
    folder, got = str(tmp_path / "in"), []
    for k in range(3):
        rows.where(f"id >= {k * 100} and id < {k * 100 + 100}").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(rows.schema).parquet(folder)
        got += _run(state.rate_limit_stream(stream, 60, 3, "1 minute"), str(tmp_path / "cp"), "append")
    last = spark.createDataFrame([("end", 10**6)], "key string, id long").withColumn("at", F.lit("2024-02-01").cast("timestamp"))
    last.select(*rows.columns).write.mode("append").parquet(folder)
    got += _run(state.rate_limit_stream(spark.readStream.schema(rows.schema).parquet(folder), 60, 3, "1 minute"), str(tmp_path / "cp"), "append")
    table = rows.withColumn("at", F.col("at").cast("timestamp_ntz"))
    want = sorted((r["key"], r["id"], r["allowed"], r["retry_after"]) for r in sync.rate_limit(table, 60, 3).collect())
    assert sorted((r[1], r[2], r[4], r[5]) for r in got) == want and {r[3] for r in want} > {0} and len({r[0] for r in got}) > 2


def test_request_states_over_batches(spark, tmp_path):
    steps = spark.range(200).select(
        F.concat(F.lit("r"), (F.col("id") % 60).cast("string")).alias("request_id"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=F.pmod(F.xxhash64("id"), F.lit(9999)).cast("int"))).alias("at"),
        F.element_at(F.array(*map(F.lit, ("queued", "processing", "completed", "failed"))), (F.pmod(F.xxhash64("id"), F.lit(4)) + 1).cast("int")).alias("status"),
    )
    folder, last = str(tmp_path / "in"), {}
    for k in range(2):
        steps.where(F.col("at") < "2024-01-01 01:20:00" if k else F.col("at") >= "2024-01-01 01:20:00").coalesce(1).write.mode("append").parquet(folder)
        out = state.request_state_stream(spark.readStream.schema(steps.schema).parquet(folder))
        last |= {r[1]: r[2:] for r in _run(out, str(tmp_path / "cp"), "update")}
    want = {r["request_id"]: tuple(r)[1:] for r in sync.request_state(steps).select("request_id", "status", "requested_at", "processed_at", "events").collect()}
    assert last == want and {r[0] for r in want.values()} == {"queued", "processing", "completed", "failed"}


def test_request_states_are_forgotten(spark, tmp_path):
    """A state lives on from batch to batch, and is gone once the stream's time has passed it."""
    folder, out = str(tmp_path / "in"), []
    for k, (hour, status) in enumerate(((0, "queued"), (1, "processing"), (30, "other"), (60, "completed"))):
        row = (("other" if status == "other" else "r"), f"2024-01-0{1 + hour // 24} {hour % 24:02d}:00:00", status)
        df = spark.createDataFrame([row], "request_id string, t string, status string").select("request_id", F.col("t").cast("timestamp").alias("at"), "status")
        df.coalesce(1).write.mode("append").parquet(folder)
        out += _run(state.request_state_stream(spark.readStream.schema(df.schema).parquet(folder), 10), str(tmp_path / "cp"), "update")
    assert [(r[1], r[2], r[5]) for r in out] == [("r", "queued", 1), ("r", "processing", 2), ("other", "other", 1), ("r", "completed", 1)]
