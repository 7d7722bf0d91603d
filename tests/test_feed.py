import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakework.operators import changes, upsert
from lakework.operators.changes import TypeOptions
from lakework.sources import hadoop
from lakework.streaming import feed, jobs


def record(op="INSERT", ts=1, seq=1, name="db.t", pk=("id",), fields=(), before=None, after=None):
    return (op, ts, seq, name, list(pk), [tuple(f) for f in fields], before, after)


def envelopes(spark, *records):
    return changes.encode_envelope(spark.createDataFrame(list(records), changes.ENVELOPE))


ID = ("id", 8, None, None)


def simple(op, seq, key, value=None, ts=1, **kw):
    image = {"id": str(key), "v": value}
    before, after = (image, None) if op == "DELETE" else (None, image)
    return record(op, ts, seq, fields=[ID, ("v", 253, None, None)], before=before, after=after, **kw)


def typed(spark, fields, after, options=TypeOptions()):
    states, _ = changes.prepare(
        changes.decode_envelope(envelopes(spark, *[record(seq=i, fields=[ID, *fields], after={"id": str(i), **a}) for i, a in enumerate(after)]))
    )
    (shape,) = changes.table_shapes(states, options)
    return shape, changes.typed_rows(states, shape, options).orderBy("id").collect()


def test_type_matrix(spark):
    fields = [
        ("i", 3, None, None), ("f", 4, None, None), ("d", 5, None, None), ("ts", 7, None, None), ("day", 10, None, None),
        ("clock", 11, None, None), ("moment", 18, None, None), ("year", 13, None, None), ("bit", 16, None, None), ("s", 245, None, None),
    ]
    values = {
        "i": "7", "f": "1.5", "d": "2.25", "ts": "1600000000123", "day": "2020-02-03", "clock": "01:02:03.5",
        "moment": "2020-02-03 04:05:06.789", "year": "1999", "bit": "1", "s": "{}",
    }
    _, (full, empty) = typed(spark, fields, [values, {}])
    assert (full.i, full.f, full.d, full.year, full.bit, full.s) == (7, 1.5, 2.25, 1999, 1, "{}")
    assert full.day == dt.date(2020, 2, 3)
    assert full.ts == dt.datetime(2020, 9, 13, 12, 26, 40, 123000)
    assert full.clock == dt.datetime(1970, 1, 1, 1, 2, 3, 500000)
    assert full.moment == dt.datetime(2020, 2, 3, 4, 5, 6, 789000)
    assert all(empty[name] is None for name, *_ in fields)


def test_missing_date_parts_are_null(spark):
    fields = [("day", 10, None, None), ("moment", 12, None, None)]
    _, rows = typed(spark, fields, [{"day": "2020-02", "moment": "2020-02-03"}, {"day": "2020", "moment": "2020-02-03 01"}])
    assert [(r.day, r.moment) for r in rows] == [(None, None), (None, None)]


def test_everything_as_text(spark):
    fields = [("day", 10, None, None), ("moment", 12, None, None), ("ts", 7, None, None), ("f", 4, None, None), ("n", 0, 3, 2)]
    _, (row,) = typed(
        spark, fields,
        [{"day": "1970-01-02", "moment": "1970-01-01 00:00:01.5", "ts": "5", "f": "1.50", "n": "1.10"}],
        TypeOptions(all_to_string=True),
    )
    assert (row.day, row.moment, row.ts, row.f, row.n, row.id) == ("86400000", "1500", "5", "1.5", "1.10", "0")


def test_decimals_of_one_column_fit_together(spark):
    def rows(options=TypeOptions()):
        return envelopes(
            spark,
            *[
                record(seq=i, fields=[ID, ("n", 246, p, s)], after={"id": str(i), "n": text})
                for i, (text, p, s) in enumerate([("1.11", 3, 2), ("11.11", 4, 2), ("11", 2, 0), ("999999999", 9, 0), (None, None, None)])
            ],
        )

    states, _ = changes.prepare(changes.decode_envelope(rows()))
    (shape,) = changes.table_shapes(states)
    assert shape.schema["n"].dataType == T.DecimalType(20, 2)
    values = [r.n for r in changes.typed_rows(states, shape).orderBy("id").collect()]
    assert values == [Decimal("1.11"), Decimal("11.11"), Decimal("11.00"), Decimal("999999999.00"), None]
    (text,) = changes.table_shapes(states, TypeOptions(decimal_to_string=True))
    assert text.schema["n"].dataType == T.StringType()
    (own,) = changes.table_shapes(states, TypeOptions(decimals={"t": {"n": (12, 4)}, "db.t": {"n": (15, 3)}}))
    assert own.schema["n"].dataType == T.DecimalType(15, 3)


def test_decimal_definitions():
    assert changes.parse_decimal_defs("fees:net,12,4;tax,7,3#rents:cold,9,2") == {
        "fees": {"net": (12, 4), "tax": (7, 3)},
        "rents": {"cold": (9, 2)},
    }
    assert changes.parse_decimal_defs("") == {} == changes.parse_decimal_defs(None)


def test_precision_steps_by_ten():
    assert [changes.safe_precision(p) for p in (1, 9, 10, 11, 29, 30, 38)] == [10, 10, 20, 20, 30, 38, 38]


def test_unknown_type_is_named():
    with pytest.raises(ValueError, match="77"):
        changes.spark_type_for(77)


def test_widening():
    assert changes.widen(T.IntegerType(), T.LongType()) == T.LongType()
    assert changes.widen(T.LongType(), T.DecimalType(10, 2)) == T.DecimalType(21, 2)
    assert changes.widen(T.DecimalType(10, 0), T.DecimalType(10, 4)) == T.DecimalType(14, 4)
    assert changes.widen(T.StringType(), T.IntegerType()) == T.StringType()
    with pytest.raises(TypeError):
        changes.widen(T.DateType(), T.LongType())


def test_object_names(spark):
    df = spark.createDataFrame([("a.b",), ("a.x.b",), ("a",), ("a.b.c.d",)], "n string")
    db, table = changes.split_object_name("n")
    assert [tuple(r) for r in df.select(db, table).collect()] == [("a", "b"), ("a", "b"), ("a", ""), ("", "")]


def test_broken_envelope_fails(spark):
    with pytest.raises(Exception, match="(?i)malformed"):
        changes.decode_envelope(spark.createDataFrame([("{",)], "value string")).collect()


def test_records_without_key_are_reported(spark, tmp_path):
    batch = envelopes(spark, simple("INSERT", 1, 1, "a"), simple("INSERT", 2, 2, "b", name="db.log", pk=()))
    report = feed.apply_batch(batch, 0, feed.CdcConfig(str(tmp_path))).collect()
    assert [(r.table, r.upserts) for r in report] == [("t", 1), ("", 1)]


def read(spark, root, *columns):
    df = upsert.read_upsert_table(spark, f"{root}/db/t")
    return sorted((tuple(r) for r in df.select(*(columns or ("id", "v"))).collect()), key=str)


@pytest.mark.parametrize("kind", [upsert.COPY_ON_WRITE, upsert.MERGE_ON_READ])
def test_feed_states(spark, tmp_path, kind):
    config = feed.CdcConfig(str(tmp_path), table_type=kind, max_delta_commits=3)
    first = envelopes(
        spark,
        *[simple("INSERT", i, i, "old") for i in range(10)],
        simple("DELETE", 20, 3), simple("INSERT", 21, 3, "again"),  # delete and insert in one batch
        simple("UPDATE", 22, 4, "late"), simple("UPDATE", 21, 4, "early"),  # out of order
    )
    feed.apply_batch(first, 0, config)
    want = {i: "old" for i in range(10)} | {3: "again", 4: "late"}
    assert dict(read(spark, tmp_path)) == want
    second = envelopes(
        spark,
        simple("DELETE", 30, 0), simple("DELETE", 31, 77), simple("UPDATE", 32, 1, "new"),
        record("UPDATE", 1, 33, fields=[ID, ("v", 253, None, None)], before={"id": "2", "v": "old"}, after={"id": "200", "v": "moved"}),
    )
    feed.apply_batch(second, 1, config)
    del want[0], want[2]
    want |= {1: "new", 200: "moved"}
    assert dict(read(spark, tmp_path)) == want
    report = feed.apply_batch(second, 1, config).collect()  # a replay
    assert [r.skipped for r in report] == [True]
    assert dict(read(spark, tmp_path)) == want
    third = feed.apply_batch(envelopes(spark, simple("INSERT", 40, 5, "z")), 2, config).collect()
    assert third[0].compacted == (kind == upsert.MERGE_ON_READ)
    assert dict(read(spark, tmp_path)) == want | {5: "z"}


def test_narrow_and_wide_records_share_a_table(spark, tmp_path):
    config = feed.CdcConfig(str(tmp_path))
    narrow = record(seq=1, fields=[ID], after={"id": "1"})
    wide = record(seq=2, fields=[("extra", 3, None, None), ID], after={"id": "2", "extra": "5"})
    feed.apply_batch(envelopes(spark, narrow, wide), 0, config)
    assert read(spark, tmp_path, "id", "extra") == [(1, None), (2, 5)]
    longer = record(seq=3, fields=[ID, ("extra", 8, None, None)], after={"id": "3", "extra": "5000000000"})
    feed.apply_batch(envelopes(spark, longer), 1, config)
    got = {r.id: r.extra for r in upsert.read_upsert_table(spark, f"{tmp_path}/db/t").collect()}
    assert got == {1: None, 2: 5, 3: 5_000_000_000}


def frame(spark, rows, ddl="k1 string, k2 string, v int, _order_ts long"):
    return spark.createDataFrame(rows, ddl)


def test_keys_are_compared_by_column(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [("a,b", "c", 1, 1), ("a", "b,c", 2, 1), (None, "x", 3, 1), ("null", "x", 4, 1)]
    upsert.upsert_table(frame(spark, rows), path, ["k1", "k2"], "_order_ts")
    upsert.upsert_table(frame(spark, [(None, "x", 30, 2)]), path, ["k1", "k2"], "_order_ts")
    assert sorted(r.v for r in upsert.read_upsert_table(spark, path).collect()) == [1, 2, 4, 30]


def test_one_key_with_a_third_of_all_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    hot = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")
    )
    report = upsert.upsert_table(hot, path, ["k"], "v")
    assert report.upserts == 20_001
    assert upsert.read_upsert_table(spark, path).where("k = -1").first().v == 29_997


def test_modes_and_retention(spark, tmp_path):
    path = str(tmp_path / "t")
    one, two = frame(spark, [("a", "b", 1, 1)]), frame(spark, [("c", "d", 2, 1)])
    upsert.upsert_table(one, path, ["k1", "k2"], "_order_ts")
    with pytest.raises(FileExistsError):
        upsert.upsert_table(two, path, ["k1", "k2"], "_order_ts", mode="errorifexists")
    with pytest.raises(ValueError):
        upsert.upsert_table(two, path, ["k1"], "_order_ts")
    assert upsert.upsert_table(two, path, ["k1", "k2"], "_order_ts", mode="ignore").skipped
    upsert.upsert_table(two, path, ["k1", "k2"], "_order_ts", mode="overwrite")
    assert [r.v for r in upsert.read_upsert_table(spark, path).collect()] == [2]
    assert upsert.drop_old_versions(spark, path) == 1
    assert [r.v for r in upsert.read_upsert_table(spark, path + "/*").collect()] == [2]


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    upsert.upsert_table(spark.range(1000).selectExpr("id k", "id v"), path, ["k"], "v")
    upsert.upsert_table(spark.range(1).selectExpr("id k", "id + 5 v"), path, ["k"], "v")
    assert len(hadoop.list_names(spark, f"{path}/base/_version=1")) >= 16
    assert len([n for n in hadoop.list_names(spark, f"{path}/base/_version=2") if n.startswith("_bucket")]) == 1
    assert upsert.read_upsert_table(spark, path).count() == 1000


def test_a_failed_write_leaves_the_table_as_it_was(spark, tmp_path):
    path = str(tmp_path / "t")
    upsert.upsert_table(spark.range(10).selectExpr("id k", "id v"), path, ["k"], "v")
    bad = spark.range(10).selectExpr("id k", "if(id = 5, raise_error('no'), id) v")
    with pytest.raises(Exception):
        upsert.upsert_table(bad, path, ["k"], "v")
    assert upsert.current_commit(spark, path).version == 1
    assert upsert.read_upsert_table(spark, path).count() == 10


def test_starting_offsets():
    assert jobs.starting_offsets("t", "earliest") == "earliest"
    assert jobs.starting_offsets("t", None) == "latest"
    assert jobs.starting_offsets("t", 42) == '{"t": {"0": 42}}'
    assert jobs.starting_offsets("t", 42, partitions=3) == '{"t": {"0": 42, "1": 42, "2": 42}}'
    assert jobs.starting_offsets("t", {1: 5, 0: 7}) == '{"t": {"0": 7, "1": 5}}'
    with pytest.raises(ValueError):
        jobs.starting_offsets("t", "soon")


class _Query:
    def __init__(self, error=None):
        self.error = error

    def awaitTermination(self):
        if self.error:
            raise self.error


def _failure(text):
    from pyspark.errors import StreamingQueryException

    return StreamingQueryException(text)


@pytest.mark.parametrize("words", ["Offsets out of range with no configured reset policy", "Cannot fetch offset 7 (GroupId: g, TopicPartition: t-0)"])
def test_lost_position_restarts_from_earliest(words):
    offsets = []

    def start(offset):
        offsets.append(offset)
        return _Query(_failure(words) if len(offsets) == 1 else None)

    jobs.run_with_recovery(start)
    assert offsets == [None, "earliest"]


def test_other_failures_end_the_job():
    from pyspark.errors import StreamingQueryException

    with pytest.raises(StreamingQueryException):
        jobs.run_with_recovery(lambda offset: _Query(_failure("disk full")))


def test_stream_job_resumes_and_reports(spark, tmp_path):
    source = tmp_path / "feed"
    envelopes(spark, simple("INSERT", 1, 1, "a")).write.parquet(str(source))
    config = feed.CdcConfig(str(tmp_path), trigger=None, report_path=str(tmp_path / "reports"))
    reports = []

    def run():
        stream = jobs.read_stream(spark, "parquet", str(source), "value binary")
        feed.run_cdc(stream, config, str(tmp_path / "checkpoint"), lambda r: reports.extend(r.collect())).awaitTermination()

    run()
    envelopes(spark, simple("INSERT", 2, 2, "b")).write.mode("append").parquet(str(source))
    run()
    assert read(spark, tmp_path) == [(1, "a"), (2, "b")]
    assert [(r.batch_id, r.upserts) for r in reports] == [(0, 1), (1, 1)]
    assert spark.read.parquet(str(tmp_path / "reports")).count() == 2


def test_settings_from_text():
    config = feed.CdcConfig.from_properties({"base_path": "/x", "all_to_string": "true", "max_delta_commits": "3", "other": "1"})
    assert (config.base_path, config.all_to_string, config.max_delta_commits) == ("/x", True, 3)


def test_catalog_follows_and_its_failure_does_not_stop(spark, tmp_path, monkeypatch):
    config = feed.CdcConfig(str(tmp_path), table_type=upsert.COPY_ON_WRITE, catalog_sync=True, catalog_db="synced")
    feed.apply_batch(envelopes(spark, *[simple("INSERT", i, i, "a") for i in range(20)]), 0, config)
    assert spark.table("synced.t").count() == 20
    feed.apply_batch(envelopes(spark, simple("DELETE", 30, 7), simple("UPDATE", 31, 8, "b")), 1, config)
    assert sorted(r.v for r in spark.table("synced.t").collect()) == ["a"] * 18 + ["b"]

    def broken(*args):
        raise RuntimeError("no catalog")

    config = feed.CdcConfig(str(tmp_path), table_type=upsert.COPY_ON_WRITE, catalog_sync=True, catalog_db="synced")
    monkeypatch.setattr(feed, "sync_table", broken)
    feed.apply_batch(envelopes(spark, simple("INSERT", 40, 40, "c")), 2, config)
    assert (40, "c") in read(spark, tmp_path)


@pytest.mark.parametrize("settings", [{"table_type": upsert.MERGE_ON_READ, "max_delta_commits": n} for n in (2, 10)] + [{}])
def test_a_deleted_key_keeps_its_order(spark, tmp_path, settings):
    path = str(tmp_path / "t")

    def put(key, order, gone=False):
        row = spark.createDataFrame([(key, order, gone)], "k long, at long, _is_deleted boolean")
        upsert.upsert_table(row, path, ["k"], "at", ordering=upsert.EVENT_TIME, **settings)

    put(1, 1), put(2, 1), put(1, 5, gone=True), put(1, 3), put(3, 2)
    assert sorted(r.k for r in upsert.read_upsert_table(spark, path).collect()) == [2, 3]
    name = upsert.sync_table(spark, "synced_late", f"t{len(settings)}{settings.get('max_delta_commits', 0)}", path)
    assert sorted(r.k for r in spark.sql(f"SELECT k FROM {name}").collect()) == [2, 3]
    put(1, 9)
    assert sorted(r.k for r in upsert.read_upsert_table(spark, path).collect()) == [1, 2, 3]
    upsert.sync_table(spark, "synced_late", name.split(".")[1].strip("`"), path)
    assert sorted(r.k for r in spark.sql(f"SELECT k FROM {name}").collect()) == [1, 2, 3]


def test_the_ordering_of_a_table_is_binding(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(3).selectExpr("id k", "id at")
    upsert.upsert_table(rows, path, ["k"], "at", ordering=upsert.EVENT_TIME)
    upsert.upsert_table(rows, path, ["k"], "at")
    assert upsert.current_commit(spark, path).ordering == upsert.EVENT_TIME
    with pytest.raises(ValueError, match="ordered by event_time"):
        upsert.upsert_table(rows, path, ["k"], "at", ordering=upsert.ARRIVAL)


def test_times_with_sign_and_many_hours(spark):
    rows = spark.createDataFrame([("-01:00:00",), ("100:00:00.5",), ("838:59:59",), ("2020-01",), (None,), ("01:02",)], "t string")
    got = [r.m for r in rows.select(F.unix_millis(changes.convert_value(F.col("t"), 11, T.TimestampType())).alias("m")).collect()]
    assert got == [-3_600_000, 360_000_500, 3_020_399_000, None, None, None]
    days = spark.createDataFrame([("2020-02-29",), ("2020-02",), ("0000-00-00",)], "t string")
    assert [str(r.d) for r in days.select(changes.convert_value(F.col("t"), 10, T.DateType()).alias("d")).collect()] == ["2020-02-29", "None", "None"]
    for text, kind in (("noon", 11), ("2020-13-45", 10), ("tomorrow", 12)):
        bad = spark.createDataFrame([(text,)], "t string")
        with pytest.raises(Exception, match="not a date or time"):
            bad.select(changes.convert_value(F.col("t"), kind, T.TimestampType()).alias("d")).collect()


def test_old_versions_and_commits_go(spark, tmp_path):
    config = feed.CdcConfig(str(tmp_path), drop_old_versions=True)
    for n in range(3):
        feed.apply_batch(envelopes(spark, *[simple("INSERT", 10 * n + i, i, f"v{n}") for i in range(5)]), n, config)
    assert read(spark, tmp_path) == [(i, "v2") for i in range(5)]
    path = upsert.table_path(str(tmp_path), "db", "t")
    assert len(hadoop.list_names(spark, f"{path}/_commits")) == 1 and len(hadoop.list_names(spark, f"{path}/base")) == 1


def test_a_batch_of_odd_table_names_is_parted(spark, tmp_path):
    names = ["db.t", "db.T%2", "d/b.t", "x.y.t"]
    rows = [record("INSERT", 1, i, n, ("id",), (("id", 3, None, None), ("v", 253, None, None)), None, {"id": str(i), "v": n}) for i, n in enumerate(names)]
    report = feed.apply_batch(envelopes(spark, *rows), 0, feed.CdcConfig(str(tmp_path))).collect()
    assert sorted((r.db, r.table, r.upserts) for r in report) == sorted([("db", "t", 1), ("db", "T%2", 1), ("d/b", "t", 1), ("x", "t", 1)])
