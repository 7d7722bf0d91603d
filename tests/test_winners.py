import pytest

from lakework.streaming.winners import append_winners, current_rows

SCHEMA = "k long, name string, _order_ts long, _order_seq long, _is_deleted boolean"


@pytest.fixture
def run(spark, tmp_path):
    """Deliver batches one after the other to one checkpoint, and give all winners so far."""

    def deliver(*batches, restart=True):
        for rows in batches:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            if restart:
                _drain(spark, tmp_path)
        if not restart:
            _drain(spark, tmp_path)
        out = spark.read.parquet(str(tmp_path / "out")).collect()
        return sorted((r["k"] if r["k"] is not None else -1, r["_order_ts"], r["_order_seq"], r["name"]) for r in out)

    return deliver


def _drain(spark, tmp_path):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    append_winners(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), ["k"]).awaitTermination()


def test_late_records_neither_win_nor_revive(run, spark, tmp_path):
    got = run(
        [(1, "a", 5, 1, False), (1, "older", 4, 9, False), (2, "b", 5, 1, False), (None, "n", 1, 1, False)],
        [(2, None, 7, 1, True), (1, "late", 4, 8, False), (3, "c", None, 1, False), (None, "m", 2, 1, False)],
        [(2, "late", 6, 1, False), (1, "new", 5, 2, False), (4, "d", 1, 1, False), (4, "d", 1, 1, False)],
        [(2, "again", 8, 1, False), (4, "d", 1, 1, False)],
    )
    assert got == [(-1, 1, 1, "n"), (-1, 2, 1, "m"), (1, 5, 1, "a"), (1, 5, 2, "new"), (2, 5, 1, "b"), (2, 7, 1, None), (2, 8, 1, "again"), (4, 1, 1, "d")]
    rows = {(r["k"], r["name"]) for r in current_rows(spark, str(tmp_path / "out"), ["k"]).collect()}
    assert rows == {(None, "m"), (1, "new"), (2, "again"), (4, "d")}


def test_a_hot_key_and_an_empty_batch(run, spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    hot = [(1, f"v{i}", i % 5000, i, False) for i in range(30_000)]
    got = run([], [*hot, *((k, "x", 1, 1, k % 2 == 0) for k in range(10, 60))], restart=False)
    assert got[0] == (1, 4999, 29_999, "v29999") and len(got) == 51
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before


def test_two_checkpoints_share_a_folder(spark, tmp_path):
    """Batch numbers start anew with a checkpoint; what the second one appends must not be taken for a replay."""
    for name, rows in (("a", [(1, "x", 1, 1, False)]), ("b", [(2, "y", 1, 1, False)])):
        spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / name))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / name))
        append_winners(stream, str(tmp_path / "out"), str(tmp_path / f"checkpoint-{name}"), ["k"]).awaitTermination()
    assert {r["k"] for r in current_rows(spark, str(tmp_path / "out"), ["k"]).collect()} == {1, 2}


def test_no_row_passes_through_python(spark, tmp_path):
    spark.createDataFrame([(1, "x", 1, 1, False)], SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    query = append_winners(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), ["k"])
    query.awaitTermination()
    plan = query._jsq.streamingQuery().lastExecution().executedPlan().toString()
    assert "StateStoreSave" in plan and "Python" not in plan and "mapInArrow" not in plan
