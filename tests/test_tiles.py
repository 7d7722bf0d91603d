import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakework.functions import tiles
from lakework.operators import cells, color, layers
from lakework.operators.layers import KEY

NONE = None


def tile_frame(spark, *grids, key=(0, 0)):
    """One row: a key and tiles a, b, ... from nested lists."""
    rows, ddl = [], []
    for name, grid in zip("abc", grids):
        flat = [None if v is None else float(v) for line in grid for v in line]
        rows.append((len(grid[0]), len(grid), flat))
        ddl.append(f"{name} {tiles.TILE_DDL}")
    return spark.createDataFrame([(key, *rows)], f"{KEY} struct<col:int,row:int>, {', '.join(ddl)}")


def cells_from(df, expression):
    return df.select(expression["cells"].alias("c")).first().c


A = [[1, 2], [None, 4]]
B = [[2, 0], [3, None]]


def test_local_algebra_spreads_no_data(spark):
    df = tile_frame(spark, A, B)
    assert cells_from(df, tiles.st_local_add("a", "b")) == [3, 2, None, None]
    assert cells_from(df, tiles.st_local_subtract("a", 1)) == [0, 1, None, 3]
    assert cells_from(df, tiles.st_local_multiply("a", "b")) == [2, 0, None, None]
    assert cells_from(df, tiles.st_local_divide("a", "b")) == [0.5, None, None, None]
    assert cells_from(df, tiles.st_local_less("a", 2)) == [1, 0, None, 0]
    logs = cells_from(df, tiles.st_log(tiles.st_local_subtract("a", 1)))
    assert logs[:3] == [None, 0, None] and logs[3] == pytest.approx(math.log(3))


def test_a_mask_full_of_data_changes_nothing(spark):
    df = tile_frame(spark, A, [[7, 7], [7, 7]])
    assert cells_from(df, tiles.st_mask("a", "b")) == cells_from(df, F.col("a"))
    assert cells_from(df, tiles.st_mask("b", "a")) == [7, 7, None, 7]


def test_conversion_truncates_and_knows_no_data(spark):
    df = tile_frame(spark, [[1.9, -1.9], [5, 1e12]])
    assert cells_from(df, tiles.convert_cells("a", "int")) == [1, -1, 5, 2147483647]
    assert cells_from(df, tiles.convert_cells("a", "double", nodata=5)) == [1.9, -1.9, None, 1e12]
    with pytest.raises(ValueError):
        tiles.convert_cells("a", "byte")


def test_tile_totals(spark):
    row = tile_frame(spark, A).select(
        tiles.st_tile_sum("a").alias("s"), tiles.st_no_data_cells("a").alias("n"), tiles.st_data_cells("a").alias("d")
    ).first()
    assert (row.s, row.n, row.d) == (7.0, 1, 3)


def test_numpy_function_equals_native_expression(spark):
    df = tile_frame(spark, A, B)
    ndvi = tiles.tile_udf(lambda x, y: np.divide(x - y, x + y, out=np.full_like(x, np.nan), where=(x + y) != 0))
    assert cells_from(df, ndvi("a", "b")) == cells_from(df, tiles.normalized_difference("a", "b"))


def test_missing_tile_stays_missing(spark):
    df = tile_frame(spark, A).withColumn("gone", F.lit(None).cast(tiles.TILE_DDL))
    assert cells_from(df, tiles.st_local_add("gone", "a")) is None
    assert cells.explode_tiles(df, ["a", "gone"]).where("gone IS NOT NULL").count() == 0
    assert cells.explode_tiles(df, ["a", "gone"]).count() == 4


def test_rgb_composite_clamps(spark):
    df = tile_frame(spark, [[300, 1]], [[-5, 2]], [[3.7, None]])
    assert cells_from(df, tiles.st_rgb_composite("a", "b", "c")) == [255 * 65536 + 3, None]


def test_explode_then_assemble_is_identity(spark):
    df = tile_frame(spark, [[1, None, 3], [None, None, 6]])
    exploded = cells.explode_tiles(df)
    back = cells.st_assemble_tile(exploded, [KEY], "column_index", "row_index", "a", 3, 2)
    assert back.select("a.cells").first()[0] == df.select("a.cells").first()[0]
    # Cells that are not there at all are NoData as well.
    sparse = cells.st_assemble_tile(exploded.dropna(), [KEY], "column_index", "row_index", "a", 3, 2)
    assert sparse.select("a.cells").first()[0] == [1, None, 3, None, None, 6]


def test_assemble_settles_repeated_and_outside_cells(spark):
    rows = spark.range(10_000).select(
        F.lit(1).alias("k"), (F.col("id") % 3).cast("int").alias("c"), F.lit(0).alias("r"), F.col("id").cast("double").alias("v")
    )
    out = cells.st_assemble_tile(rows, ["k"], "c", "r", "v", 2, 1)
    assert out.select("v.cells").first()[0] == [9999.0, 9997.0]


def test_layer_of_186_by_169_pads_to_four_tiles(spark):
    raster = spark.range(1).select(
        tiles.make_tile(F.transform(F.sequence(F.lit(0), F.lit(186 * 169 - 1)), lambda i: i.cast("double")), 186, 169).alias("tile")
    )
    layer = layers.to_layer(raster, 128, 128, "band")
    assert layer.count() == 4
    counted = layer.select(tiles.st_data_cells("band").alias("n"), F.size("band.cells").alias("all"))
    assert counted.agg(F.sum("n"), F.sum("all")).first()[:] == (186 * 169, 4 * 128 * 128)
    corner = layer.where(f"{KEY}.col = 1 AND {KEY}.row = 1").select("band.cells").first()[0]
    assert corner[0] == 128 * 186 + 128


def test_focal_mean_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    grid = rng.integers(0, 50, (12, 12)).astype(float)
    grid[rng.random((12, 12)) < 0.2] = np.nan
    rows = []
    for r in range(3):
        for c in range(3):
            part = grid[r * 4 : r * 4 + 4, c * 4 : c * 4 + 4].reshape(-1)
            rows.append(((c, r), (4, 4, [None if np.isnan(v) else float(v) for v in part])))
    layer = spark.createDataFrame(rows, f"{KEY} struct<col:int,row:int>, v {tiles.TILE_DDL}")
    for radius in (1, 5):
        for row in cells.focal_mean(layer, "v", radius, 4, 4).collect():
            for i, got in enumerate(row.v.cells):
                y, x = row[KEY].row * 4 + i // 4, row[KEY].col * 4 + i % 4
                window = grid[max(0, y - radius) : y + radius + 1, max(0, x - radius) : x + radius + 1]
                want = np.nanmean(window) if (~np.isnan(window)).any() else None
                assert (got is None) == (want is None)
                assert got is None or abs(got - want) < 1e-9


def test_layer_shape_is_checked(spark):
    with pytest.raises(ValueError):
        layers.as_layer(spark.range(1))
    assert layers.as_layer(tile_frame(spark, A)).count() == 1


def test_color_ramp_interpolates():
    assert color.color_ramp([(0, 0, 0), (10, 20, 30)], 3) == [(0, 0, 0), (5, 10, 15), (10, 20, 30)]
    assert color.color_ramp([(1, 2, 3)], 2) == [(1, 2, 3), (1, 2, 3)]
