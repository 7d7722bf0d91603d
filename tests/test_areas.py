import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakework.functions import geometry
from lakework.functions.geometry import st_contains
from lakework.operators import areas
from lakework.operators.areas import _Shape, fill_tile, points_in_areas, rasterise_areas
from lakework.operators.cells import explode_tiles

POINT = "struct<x:double,y:double>"


def edges_of(*rings):
    pairs = [(a, b) for ring in rings for a, b in zip(ring, [*ring[1:], ring[0]])]
    return np.array([[a[0], a[1], b[0], b[1]] for a, b in pairs]).T


def crossings(edges, x, y):
    px, py, qx, qy = edges
    side = (qx - px) * (y - py) - (qy - py) * (x - px)
    touched = (side == 0) & (np.minimum(px, qx) <= x) & (x <= np.maximum(px, qx)) & (np.minimum(py, qy) <= y) & (y <= np.maximum(py, qy))
    return touched.any(), int((((py > y) != (qy > y)) & np.where(qy > py, side > 0, side < 0)).sum())


@settings(max_examples=60, deadline=None)
@given(st.integers(3, 40), st.integers(0, 3), st.integers(0, 1 << 30))
def test_cells_of_the_cover_tell_points_apart(corners, levels, seed):
    rng = np.random.default_rng(seed)
    edges = edges_of(rng.integers(0, 64, (corners, 2)) / 4, rng.integers(0, 64, (3, 2)) / 4)
    if edges[0].min() == edges[0].max() or edges[1].min() == edges[1].max():
        return
    start, domain = 2, (0.0, 0.0, 16.5, 16.5)
    leaf = start + 2 * levels
    cells = {}
    for level, cx, cy, own in _Shape(edges, domain).cells(start, leaf):
        assert (level, cx, cy) not in cells
        cells[level, cx, cy] = own
    for x, y in [*rng.random((60, 2)) * 16.5, *rng.integers(0, 64, (40, 2)) / 4]:
        found = [own for (level, cx, cy), own in cells.items() if (int(x / 16.5 * 2**level), int(y / 16.5 * 2**level)) == (cx, cy)]
        touched, n = crossings(edges, x, y)
        assert len(found) <= 1
        if not found:
            assert not touched and n % 2 == 0
        elif found[0] is None:
            assert not touched and n % 2 == 1
        else:  # the edges that the cell carries tell the same as all
            own = crossings(edges[:, found[0]], x, y)
            assert own[0] == touched and (touched or own[1] % 2 == n % 2)


def test_large_polygons_are_spread_over_their_cells():
    n = 20_000
    angles = np.arange(n) * (2 * math.pi / n)
    radius = 100 + 5 * np.sin(400 * angles)
    shape = _Shape(edges_of(np.stack([radius * np.cos(angles), radius * np.sin(angles)], axis=1)), (-128.0, -128.0, 256.0, 256.0))
    cells = list(shape.cells(2, 8))
    border = [len(own) for *_, own in cells if own is not None]
    assert max(border) < n / 20 and sum(border) < 40 * n
    assert sum(4.0 ** (8 - level) for level, *_, own in cells if own is None) > 0.8 * math.pi * 95**2


SQUARE = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
HOLE = [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0), (4.0, 4.0)]


def test_points_in_areas_equals_the_plain_predicate(spark):
    rng = np.random.default_rng(4)
    rings = []
    for k in range(30):
        size, at = 10.0 ** rng.integers(-1, 3), rng.random(2) * 60
        ring = [tuple(map(float, p)) for p in at + rng.random((int(rng.integers(3, 30)), 2)) * size]
        rings.append((k, [*ring, ring[0]]))
    spots = [(i, (float(x), float(y))) for i, (x, y) in enumerate(rng.random((900, 2)) * 120)]
    spots += [(1000 + k, ring[0]) for k, ring in rings]  # corners are outside
    areas = spark.createDataFrame(rings, f"id int, area array<{POINT}>")
    points = spark.createDataFrame(spots, f"n int, geom {POINT}")
    got = points_in_areas(points, areas).select("n", "id")
    plain = points.crossJoin(areas).where(st_contains("area", "geom", "polygon")).select("n", "id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect())) and plain.count() > 60
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_holes_odd_rows_and_names(spark):
    nan = float("nan")
    areas = spark.createDataFrame(
        [(1, "a", [SQUARE, HOLE]), (1, "a", [SQUARE, HOLE]), (2, "b", None), (3, "c", []), (4, "d", [[]]), (5, "e", [[(0.0, 0.0), (nan, 1.0), (0.0, 0.0)]]),
         (6, "f", [[(0.0, 0.0), (5.0, 5.0), (0.0, 0.0)]]), (7, "g", [[(2.0, 2.0), None, (2.0, 2.0)]]), (None, None, [SQUARE])],
        f"n int, name string, area array<array<{POINT}>>",
    )
    points = spark.createDataFrame(
        [(1, (5.0, 5.0)), (2, (2.0, 5.0)), (2, (2.0, 5.0)), (3, (4.0, 5.0)), (4, None), (5, (nan, 5.0)), (6, (50.0, 5.0)), (7, (10.0, 10.0))],
        f"n int, geom {POINT}",
    )
    got = points_in_areas(points, areas)
    assert got.columns == ["n", "geom", "area_n", "name"]
    # Twice each: the point and the area are repeated; the hole and its edge are outside, the plain square holds them.
    assert sorted((r["n"], r["area_n"]) for r in got.where("area_n IS NOT NULL").collect()) == [(2, 1)] * 4
    assert sorted(r["n"] for r in got.where("area_n IS NULL").collect()) == [1, 2, 2, 3]
    assert points_in_areas(points, areas.limit(0)).collect() == [] and points_in_areas(points.limit(0), areas).collect() == []
    assert points_in_areas(points, areas.limit(0)).columns == got.columns
    several = areas.where("n = 1").select(F.array("area").alias("area"))
    assert points_in_areas(points, several).count() == 4
    named = points_in_areas(points, areas.where("n = 1").selectExpr("n AS _id", "name AS _level", "area"))
    assert named.columns == ["n", "geom", "_id", "area__level"] and {(r["_id"], r["area__level"]) for r in named.collect()} == {(1, "a")}
    with pytest.raises(ValueError, match="may not have"):
        points_in_areas(points.withColumn("_cx", F.lit(1)), areas)
    with pytest.raises(ValueError, match="no ring"):
        points_in_areas(points, areas, area="name")


@settings(max_examples=100, deadline=None)
@given(st.integers(3, 30), st.integers(1, 9), st.integers(1, 9), st.integers(-3, 3), st.integers(-3, 3), st.integers(0, 1 << 30))
def test_fill_tile_counts_crossings(corners, cols, rows, x0, y0, seed):
    rng = np.random.default_rng(seed)
    edges = edges_of(rng.integers(-16, 40, (corners, 2)) / 4)
    mask = fill_tile(edges, x0, y0, cols, rows)
    px, py, qx, qy = edges
    for r in range(rows):
        for c in range(cols):
            x, y = x0 + c + 0.5, y0 + r + 0.5
            spans = (np.minimum(py, qy) <= y) & (y < np.maximum(py, qy))
            right = px[spans] + (y - py[spans]) * (qx[spans] - px[spans]) / (qy[spans] - py[spans]) > x
            assert mask[r, c] == (right.sum() % 2 == 1)


def painted(layer):
    cells = explode_tiles(layer).where("target IS NOT NULL").collect()
    cols, rows = layer.first()["target"]["cols"], layer.first()["target"]["rows"]
    return {(r["spatial_key"]["col"] * cols + r["column_index"], r["spatial_key"]["row"] * rows + r["row_index"]): r["target"] for r in cells}


def test_first_area_wins_and_large_ones_fill_whole_tiles(spark):
    big = [(-30.0, 41.0), (50.0, 41.0), (50.0, -39.0), (-30.0, -39.0), (-30.0, 41.0)]
    rows = [(2, 1.0, [big]), (1, 5.0, [SQUARE, HOLE]), (1, 4.0, [HOLE]), (1, 4.0, [HOLE]), (0, 9.0, None), (None, 9.0, [SQUARE]), (0, None, [SQUARE])]
    areas = spark.createDataFrame(rows, f"ord int, label double, area array<array<{POINT}>>").repartition(5)
    layer = rasterise_areas(areas, "label", 8, 4, order="ord", cell=1.0)
    got = painted(layer)
    expected = {(c, r): 1.0 for c in range(-30, 50) for r in range(-41, 39)}
    expected |= {(c, r): 5.0 for c in range(10) for r in range(-10, 0)} | {(c, r): 4.0 for c in (4, 5) for r in (-6, -5)}
    assert got == expected
    assert layer.groupBy("spatial_key").count().where("count > 1").isEmpty()


def test_neighbours_share_no_cell_and_grids_may_be_odd(spark):
    left = [(0.0, 0.0), (1.5, 0.0), (1.5, 3.0), (0.0, 3.0), (0.0, 0.0)]
    right = [(1.5, 0.0), (3.0, 0.0), (3.0, 3.0), (1.5, 3.0), (1.5, 0.0)]
    areas = spark.createDataFrame([(7, left), (8, right)], f"label int, area array<{POINT}>")
    got = painted(rasterise_areas(areas, "label", 5, 3, origin=(-1.0, 4.0), cell=1.0))
    assert len(got) == 9 and sum(v == 7 for v in got.values()) == 3
    fine = painted(rasterise_areas(areas, "label", 5, 3, origin=(-1.0, 4.0), cell=0.25))
    assert len(fine) == 144 and sum(v == 8 for v in fine.values()) == 72
    none = rasterise_areas(areas.limit(0), "label", 5, 3)
    assert none.collect() == [] and none.columns == ["spatial_key", "target"]
    small = spark.createDataFrame([(1, [(0.1, 0.1), (0.2, 0.1), (0.2, 0.2), (0.1, 0.1)])], f"label int, area array<{POINT}>")
    assert rasterise_areas(small, "label", 5, 3).collect() == []


def test_areas_in_one_file_are_covered_by_many_tasks(spark, monkeypatch):
    """The cover is work per area, and its cells are neither made in one task nor sent whole to every task."""
    seen, cover = [], areas.cover

    def counted(shapes, domain):
        seen.append(shapes.rdd.getNumPartitions())
        return cover(shapes, domain)

    monkeypatch.setattr(areas, "cover", counted)
    ring = F.array(*[geometry.st_point(F.col("id") % 50 + x, F.floor(F.col("id") / 50) + y) for x, y in ((0.0, 0.0), (2.0, 0.0), (0.0, 2.0), (0.0, 0.0))])
    shapes = spark.range(0, 500, 1, 1).select("id", ring.alias("area"))
    points = spark.range(100).select(F.col("id").alias("p"), geometry.st_point(F.col("id") % 10 + 0.25, F.floor(F.col("id") / 10) + 0.25).alias("geom"))
    found = areas.points_in_areas(points, shapes)
    assert seen == [int(spark.conf.get("spark.sql.shuffle.partitions"))] and seen[0] > 1
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    # (x, y) = (i + .25, j + .25) lies in the triangles at (i, j), (i - 1, j) and (i, j - 1) where they are there.
    assert found.count() == 100 + 90 + 90
