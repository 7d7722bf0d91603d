"""Streaming queries: the events table as a stream of files, run until it is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakework.operators.relational import cast_kv, records_to_json
from lakework.plans.registry import query, table
from lakework.session import scratch_dir
from lakework.sources import replay
from lakework.streaming import jobs


def _event_stream(spark: SparkSession, sf_dir: str, root: str, per_trigger: int | None = None) -> DataFrame:
    """Keys and values as bytes, in several files, as a topic would give them."""
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").cast("binary").alias("key"), F.col("props").cast("binary").alias("value")
    )
    events.repartition(4).write.parquet(f"{root}/topic")
    options = {"maxFilesPerTrigger": str(per_trigger)} if per_trigger else {}
    return jobs.read_stream(spark, "parquet", f"{root}/topic", events.schema, **options)


@query("stream_key_value", "SELECT CAST(event_id AS VARCHAR) AS key, props AS value FROM events")
def _(spark, sf_dir):
    root = scratch_dir(spark, "stream")
    stream = jobs.kv_stream(_event_stream(spark, sf_dir, root))
    jobs.append_to(stream, "parquet", f"{root}/checkpoint", f"{root}/out").awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query("stream_records_to_json", "SELECT '{\"key\":\"' || event_id || '\"}' AS value FROM events")
def _(spark, sf_dir):
    root = scratch_dir(spark, "stream")
    stream = records_to_json(jobs.kv_stream(_event_stream(spark, sf_dir, root)).select("key"))
    jobs.append_to(stream, "parquet", f"{root}/checkpoint", f"{root}/out").awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query("stream_batch_counts", "SELECT 4::BIGINT AS batches, count(*) AS records FROM events")
def _(spark, sf_dir):
    root = scratch_dir(spark, "stream")
    stream = _event_stream(spark, sf_dir, root, per_trigger=1)
    jobs.batch_counts(stream, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    counts = spark.read.parquet(f"{root}/out")
    return counts.agg(F.count_distinct("batch_id").alias("batches"), F.sum("n").alias("records"))


@query("stream_distinct_lengths", "SELECT count(DISTINCT strlen(props)) AS n_lengths FROM events")
def _(spark, sf_dir):
    root = scratch_dir(spark, "stream")
    stream = jobs.kv_stream(_event_stream(spark, sf_dir, root))
    jobs.batch_distinct_lengths(stream, "value", f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("n_lengths")


@query("stream_resumed", "SELECT 2 * count(*) AS records FROM events")
def _(spark, sf_dir):
    """Run, add the same events again, resume: the first files do not count twice."""
    root = scratch_dir(spark, "stream")
    stream = _event_stream(spark, sf_dir, root)
    jobs.batch_counts(stream, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    spark.read.parquet(f"{root}/topic").repartition(2).write.mode("append").parquet(f"{root}/topic")
    jobs.batch_counts(stream, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out").agg(F.sum("n").alias("records"))


def _log(spark: SparkSession, sf_dir: str, root: str, segment_records: int = 500) -> str:
    """The events as a log of four partitions."""
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").cast("binary").alias("key"), F.col("props").cast("binary").alias("value"), F.col("ts").cast("timestamp").alias("timestamp"),
        "event_id",
    )
    replay.write_log(events, f"{root}/log", F.col("event_id") % 4, F.col("event_id"), segment_records)
    return f"{root}/log"


@query(
    "stream_replayed_log",
    "SELECT CAST(event_id AS VARCHAR) AS key, props AS value, CAST(event_id % 4 AS INTEGER) AS partition, event_id // 4 AS offset FROM events WHERE event_id // 4 >= (event_id % 4) * 300",
)
def _(spark, sf_dir):
    """From a start position in every partition, in two runs: the second goes on where the first has stopped."""
    root = scratch_dir(spark, "replay")
    path = _log(spark, sf_dir, root)
    for _ in range(2):
        stream = cast_kv(replay.read_log(spark, path, startingOffsets='{"0": 0, "1": 300, "2": 600, "3": 900}'))
        jobs.append_to(stream.drop("timestamp"), "parquet", f"{root}/checkpoint", f"{root}/out").awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query(
    "stream_from_expired_offset",
    """
WITH n AS (SELECT count(*) AS n FROM events), kept AS (SELECT (n // 8) // greatest(20, n // 100) * greatest(20, n // 100) AS first_offset FROM n)
SELECT CAST(event_id % 4 AS INTEGER) AS partition, count(*) AS records, min(event_id // 4) AS first FROM events, kept WHERE event_id // 4 >= first_offset GROUP BY event_id % 4
""",
)
def _(spark, sf_dir):
    """The start position is gone when the stream asks for it: the job begins anew at the earliest record that is left."""
    root = scratch_dir(spark, "replay")
    n = table(spark, sf_dir, "events").count()
    path = _log(spark, sf_dir, root, max(20, n // 100))
    for partition in range(4):
        replay.drop_segments(spark, path, partition, n // 8)

    def start(offset):
        stream = replay.read_log(spark, path, startingOffsets=offset or '{"0": 0, "1": 10, "2": 20, "3": 30}')
        return jobs.append_to(stream.select("partition", "offset"), "parquet", f"{root}/checkpoint-{offset}", f"{root}/out-{offset}")

    jobs.run_with_recovery(start)
    found = spark.read.parquet(f"{root}/out-earliest").groupBy("partition")
    return found.agg(F.count("*").alias("records"), F.min("offset").alias("first"))


@query("stream_at_fixed_interval", "SELECT CAST(event_id AS VARCHAR) AS key, props AS value FROM events")
def _(spark, sf_dir):
    """Batches at an interval, one file each, until all that is there is written."""
    root = scratch_dir(spark, "stream")
    stream = jobs.kv_stream(_event_stream(spark, sf_dir, root, per_trigger=1))
    running = jobs.append_to(stream, "parquet", f"{root}/checkpoint", f"{root}/out", interval="1 second")
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return spark.read.parquet(f"{root}/out")
