import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakework.functions.curves import curve_ranges, in_ranges, interleave, place_of
from lakework.functions.geometry import bbox_during
from lakework.functions.tiles import make_tile
from lakework.sources import features, layers


def key_of(corner, bits):
    return sum((v >> i & 1) << (len(corner) * i + k) for k, v in enumerate(corner) for i in range(bits))


def boxes(dims, bits):
    corner = st.integers(0, (1 << bits) - 1)
    side = st.tuples(corner, corner).map(sorted)
    return st.lists(side, min_size=dims, max_size=dims)


@settings(max_examples=200, deadline=None)
@given(st.sampled_from([(1, 5), (2, 4), (3, 3)]).flatmap(lambda d: st.tuples(st.just(d[1]), boxes(*d))), st.integers(1, 40))
def test_ranges_cover_the_box(case, max_ranges):
    bits, sides = case
    low, high = zip(*sides)
    inside = {key_of((x, *rest), bits) for x in range(low[0], high[0] + 1) for rest in _rest(low[1:], high[1:])}
    ranges = curve_ranges(low, high, bits, max_ranges)
    assert 1 <= len(ranges) <= max_ranges and ranges == sorted(ranges)
    assert all(b1 + 1 < a2 for (_, b1), (a2, _) in zip(ranges, ranges[1:]))
    covered = {k for a, b in ranges for k in range(a, b + 1)}
    assert inside <= covered
    exact = curve_ranges(low, high, bits, 1 << 12)
    assert {k for a, b in exact for k in range(a, b + 1)} == inside


def _rest(low, high):
    if not low:
        yield ()
        return
    for v in range(low[0], high[0] + 1):
        for tail in _rest(low[1:], high[1:]):
            yield (v, *tail)


def test_more_ranges_leave_less_outside():
    sizes = [sum(b - a + 1 for a, b in curve_ranges((100, 900), (1500, 1300), 20, n)) for n in (1, 4, 16, 64)]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] < 1.2 * 1401 * 401 < sizes[0]
    assert curve_ranges((3, 3), (2, 9), 4) == []
    with pytest.raises(ValueError, match="leaves"):
        curve_ranges((0, 0), (16, 3), 4)


def test_keys_of_the_columns(spark):
    rows = [(0, 0, 0), (1, 2, 3), (1023, 5, 77), (512, 1023, 1)]
    df = spark.createDataFrame(rows, "a int, b int, c int").select(interleave([F.col("a"), F.col("b"), F.col("c")], 20))
    assert [r[0] for r in df.collect()] == [key_of(r, 20) for r in rows]
    with pytest.raises(ValueError, match="long"):
        interleave([F.lit(1)] * 3, 22)
    assert spark.range(10).where(in_ranges(F.col("id"), [(1, 2), (7, 7)])).count() == 3
    assert spark.range(10).where(in_ranges(F.col("id"), [])).count() == 0


def rows_read(df):
    """Rows that the scans of a frame hand on after statistics have been asked."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    text, total, leaves = plan.toString(), 0, plan.collectLeaves()
    assert "PushedFilters" in text
    for i in range(leaves.size()):
        total += leaves.apply(i).metrics().apply("numOutputRows").value()
    return total


@pytest.fixture
def small_files(spark):
    """Ranges are kept apart, one file each, as the files of a large table are."""
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "40"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_windows_read_few_files(spark, tmp_path, small_files):
    keys = [(c, r) for c in range(-20, 44) for r in range(-20, 44)]
    df = spark.createDataFrame(keys, "col int, row int").select(
        F.struct("col", "row").alias("spatial_key"), make_tile(F.array(F.col("col").cast("double")), 1, 1).alias("band"), F.lit(3).alias("zoom")
    )
    layers.write_layer(df, str(tmp_path), "a")
    for first, last in (((5, 6), (12, 9)), ((-3, -2), (4, 5)), ((-20, -20), (-17, -1)), ((30, 30), (30, 30)), ((0, 0), (60, 60)), ((9, 9), (8, 8))):
        window = layers.load_window(spark, str(tmp_path), "a", 3, first, last)
        found = {(r["spatial_key"]["col"], r["spatial_key"]["row"]) for r in window.collect()}
        wanted = {k for k in keys if first[0] <= k[0] <= last[0] and first[1] <= k[1] <= last[1]}
        assert found == wanted and window.columns == ["spatial_key", "band", "name", "zoom"]
    narrow = layers.load_window(spark, str(tmp_path), "a", 3, (5, 6), (12, 9))
    assert 32 <= rows_read(narrow) < len(keys) / 8
    assert layers.load_window(spark, str(tmp_path), "a", 3, (100, 100), (200, 200)).collect() == []
    with pytest.raises(ValueError, match="no layer"):
        layers.load_window(spark, str(tmp_path), "a", 4, (0, 0), (1, 1))


DAY = 24 * 3600


def stamps(n):
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    return [start + datetime.timedelta(hours=7 * i) for i in range(n)]


def spots(spark, n=3000):
    rows = [(f"f{i}", ((i * 7919 % 3600) / 10 - 180, (i * 104729 % 1800) / 10 - 90), t) for i, t in enumerate(stamps(n))]
    return spark.createDataFrame(rows, "__fid__ string, geom struct<x:double,y:double>, dtg timestamp")


def test_box_and_time_read_few_files(spark, tmp_path, small_files):
    root, df = str(tmp_path), spots(spark)
    features.write_features(df, root, "t", create=True, time="dtg", period=30 * DAY)
    cases = [
        (-20, -10, 30, 15, "2024-03-01 00:00:00", "2024-03-09 12:00:00"), (-180, -90, 180, 90, "2024-01-01 00:00:00", "2026-12-31 00:00:00"),
        (-500, -500, 0, 500, "2023-01-01 00:00:00", "2024-02-11 05:00:00"), (10, 10, 10.5, 70, "2024-06-30 23:00:00", "2025-04-01 00:00:00"),
        (5, 5, 4, 6, "2024-01-01 00:00:00", "2025-01-01 00:00:00"), (0, 0, 50, 50, "2025-01-01 00:00:00", "2024-01-01 00:00:00"),
    ]
    for case in cases:
        found = features.read_during(spark, root, "t", *case)
        assert found.columns == df.columns
        assert sorted(r["__fid__"] for r in found.collect()) == sorted(r["__fid__"] for r in bbox_during(df, *case).collect())
    narrow = features.read_during(spark, root, "t", *cases[0])
    assert 0 < rows_read(narrow) < 3000 / 8
    assert rows_read(features.read_during(spark, root, "t", *cases[1])) == 3000


def test_index_keeps_odd_features(spark, tmp_path):
    root = str(tmp_path)
    odd = spark.createDataFrame(
        [("a", None, stamps(1)[0]), ("b", (0.0, 0.0), None), ("c", (1000.0, 0.0), stamps(2)[1]), ("d", (0.0, float("nan")), stamps(2)[1]), ("e", (None, 1.0), stamps(2)[1])],
        "__fid__ string, geom struct<x:double,y:double>, dtg timestamp",
    )
    features.write_features(spots(spark, 10), root, "t", create=True, time="dtg")
    features.write_features(odd.unionAll(odd), root, "t", time="dtg")
    features.write_features(odd.limit(0), root, "t")  # the type keeps its index
    assert features.read_features(spark, root, "t").count() == 20
    far = features.read_during(spark, root, "t", 900, -1, 1100, 1, "2024-01-01 00:00:00", "2024-02-01 00:00:00")
    assert [r["__fid__"] for r in far.collect()] == ["c", "c"]
    with pytest.raises(ValueError, match="no index"):
        features.write_features(odd, root, "t", time="other")
    features.write_features(odd, root, "plain", create=True)
    with pytest.raises(ValueError, match="no index"):
        features.read_during(spark, root, "plain", 0, 0, 1, 1, "2024-01-01 00:00:00", "2024-02-01 00:00:00")


def test_places_are_the_same_on_both_sides(spark):
    from lakework.functions.curves import place

    values = [-180.0, -179.9999, 0.1, 77.7, 180.0, 200.0, -1e9]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(place(F.col("v"), -180.0, 180.0, 20))
    assert [r[0] for r in df.collect()] == [place_of(v, -180.0, 180.0, 20) for v in values]


def test_during_ranges_share_the_middle_bins():
    index = {"time": "dtg", "bounds": [-180, -90, 180, 90], "period": DAY}
    spans = features.during_ranges(index, (0, 0, 1, 1), 0, 9 * DAY * 1_000_000 + 5)
    assert [(a, b) for a, b, _ in spans] == [(0, 0), (1, 8), (9, 9)]
    assert all(1 <= len(ranges) <= 32 for *_, ranges in spans)
