import json

import pytest
from pyspark.sql import functions as F

from lakework.sources import replay
from lakework.streaming import jobs


def records(spark, n, first=0):
    return spark.range(first, first + n).select(
        F.col("id").cast("string").cast("binary").alias("key"), F.when(F.col("id") % 7 > 0, F.lit("v").cast("binary")).alias("value"),
        F.timestamp_seconds("id").alias("timestamp"), "id",
    )


@pytest.fixture
def log(spark, tmp_path):
    path = str(tmp_path / "log")
    replay.write_log(records(spark, 100), path, F.col("id") % 3, F.col("id"), segment_records=10)
    return path


def test_whole_log(spark, log):
    spark.dataSource.register(replay.ReplayLog)
    rows = spark.read.format("replay_log").option("path", log).load().collect()
    assert sorted((int(r["key"]), r["partition"], r["offset"]) for r in rows) == sorted((i, i % 3, i // 3) for i in range(100))
    assert sum(r["value"] is None for r in rows) == 15 and {int(r["timestamp"].timestamp()) for r in rows} == set(range(100))
    whole = replay.Log(log)
    assert whole.earliest() == {"0": 0, "1": 0, "2": 0} and whole.end() == {"0": 34, "1": 33, "2": 33}
    assert [(s.partition, s.first, s.stop) for s in whole.ranges({"0": 8}, {"0": 21})] == [(0, 8, 10), (0, 10, 20), (0, 20, 21)]
    assert whole.ranges({"0": 34}, {"0": 34}) == []


def drain(spark, log, tmp_path, **options):
    """All batches at a short interval, as lists of (partition, offset)."""
    seen = []
    stream = replay.read_log(spark, log, **options).select("partition", "offset")
    query = (
        stream.writeStream.foreachBatch(lambda batch, _: seen.append(sorted(map(tuple, batch.collect()))))
        .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(processingTime="0 seconds").start()
    )
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return [s for s in seen if s]


def test_rate_limit_holds_over_a_restart(spark, log, tmp_path):
    options = {"maxRecordsPerTrigger": "12", "progress": str(tmp_path / "progress.json")}
    first = drain(spark, log, tmp_path, **options)
    assert len(first) == 9 and all(len(b) <= 12 for b in first)
    assert sorted(x for b in first for x in b) == sorted((i % 3, i // 3) for i in range(100))
    assert drain(spark, log, tmp_path, **options) == []
    replay.write_log(records(spark, 60, 1000), str(tmp_path / "more"), F.col("id") % 3, F.col("id"), segment_records=10)
    for p in range(3):  # the next segments of every partition
        for segment in (tmp_path / "more" / f"partition={p}").iterdir():
            (tmp_path / "log" / f"partition={p}" / f"segment={int(segment.name.split('=')[1]) + 4}").mkdir()
            for file in segment.glob("*.parquet"):
                table = replay.pq.read_table(file)
                moved = table.set_column(table.schema.get_field_index("offset"), "offset", replay.pa.compute.add(table["offset"], 40))
                replay.pq.write_table(moved, tmp_path / "log" / f"partition={p}" / f"segment={int(segment.name.split('=')[1]) + 4}" / file.name)
    again = drain(spark, log, tmp_path, **options)
    assert all(len(b) <= 12 for b in again) and sorted(x for b in again for x in b) == sorted((p, 40 + i) for p in range(3) for i in range(20))


def test_start_positions(spark, log, tmp_path):
    assert drain(spark, log, tmp_path, startingOffsets="latest") == []
    (tmp_path / "two").mkdir()
    (batch,) = drain(spark, log, tmp_path / "two", startingOffsets=json.dumps({"0": 30, "2": 33}))
    assert batch == sorted([(0, i) for i in range(30, 34)] + [(1, i) for i in range(33)])


def test_offsets_that_are_gone_raise_and_recovery_starts_anew(spark, log, tmp_path):
    assert replay.drop_segments(spark, log, 1, 25) == 2 and replay.drop_segments(spark, log, 1, 25) == 0
    assert replay.Log(log).earliest() == {"0": 0, "1": 20, "2": 0}
    tries = []

    def start(offset):
        tries.append(offset)
        stream = replay.read_log(spark, log, startingOffsets=offset or '{"1": 5}').select("partition", "offset")
        return jobs.append_to(stream, "parquet", str(tmp_path / f"c-{offset}"), str(tmp_path / f"o-{offset}"))

    jobs.run_with_recovery(start)
    assert tries == [None, "earliest"]
    assert spark.read.parquet(str(tmp_path / "o-earliest")).where("partition = 1").agg(F.min("offset"), F.count("*")).first()[:] == (20, 13)


def test_empty_log(spark, tmp_path):
    path = str(tmp_path / "none")
    replay.write_log(records(spark, 0), path, F.col("id") % 3, F.col("id"))
    assert drain(spark, path, tmp_path) == []
