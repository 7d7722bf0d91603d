import numpy as np
import pytest
from pyspark.sql import functions as F

from lakework.functions.geometry import register_sql_functions
from lakework.functions.tiles import make_tile
from lakework.operators.cells import explode_tiles, focal_max, focal_mean, focal_median, focal_min, running_max
from lakework.operators.quantiles import exact_quantiles, merge_sketches, quantile_sketches, sketch_quantiles


@pytest.mark.parametrize(("n", "side"), [(1, 1), (7, 3), (20, 5), (21, 7), (9, 9), (40, 11)])
def test_running_extremes(n, side):
    rng = np.random.default_rng(n)
    values = rng.integers(-9, 9, (4, n)).astype(float)
    values[rng.random(values.shape) < 0.2] = -np.inf
    want = np.stack([values[:, i : i + side].max(axis=1) for i in range(n - side + 1)], axis=1)
    assert (running_max(values, side, 1) == want).all()
    assert (running_max(values.T, side, 0) == want.T).all()


def layer_of(spark, grid, cols, rows, name="band"):
    """A layer from a grid of numbers, NaN for NoData, one tile in the middle left out."""
    tiles = []
    for r in range(grid.shape[0] // rows):
        for c in range(grid.shape[1] // cols):
            cells = grid[r * rows : (r + 1) * rows, c * cols : (c + 1) * cols].ravel()
            tiles.append(((c, r), [None if np.isnan(v) else float(v) for v in cells]))
    df = spark.createDataFrame(tiles, "spatial_key struct<col:int,row:int>, cells array<double>")
    return df.select("spatial_key", make_tile(F.col("cells"), cols, rows).alias(name))


@pytest.mark.parametrize("radius", [0, 1, 2, 5])
def test_focal_windows_equal_brute_force(spark, radius):
    cols, rows = 4, 3
    rng = np.random.default_rng(radius)
    grid = np.round(rng.normal(0, 5, (9, 12)), 1)
    grid[rng.random(grid.shape) < 0.3] = np.nan
    grid[:3, :4] = np.nan
    layer = layer_of(spark, grid, cols, rows)
    twice = layer.unionAll(layer.where("spatial_key.col = 1"))
    padded = np.pad(grid, radius, constant_values=np.nan)
    windows = np.lib.stride_tricks.sliding_window_view(padded, (2 * radius + 1, 2 * radius + 1)).reshape(*grid.shape, -1)
    for fn, plain in ((focal_min, np.nanmin), (focal_max, np.nanmax), (focal_median, np.nanmedian), (focal_mean, np.nanmean)):
        got = np.full(grid.shape, np.nan)
        for r in explode_tiles(fn(twice, "band", radius, cols, rows), ["band"]).collect():
            y, x = r["spatial_key"]["row"] * rows + r["row_index"], r["spatial_key"]["col"] * cols + r["column_index"]
            got[y, x] = np.nan if r["band"] is None else r["band"]
        for y in range(grid.shape[0]):
            for x in range(grid.shape[1]):
                own = windows[y, x]
                want = plain(own) if (~np.isnan(own)).any() else np.nan
                assert np.isclose(got[y, x], want, equal_nan=True), (fn.__name__, y, x)
    assert focal_median(layer.limit(0), "band", 1, cols, rows).count() == 0


def test_tiles_as_rows_in_sql(spark):
    register_sql_functions(spark)
    grid = np.array([[1.0, np.nan, 3.0, 4.0], [5.0, 6.0, np.nan, 8.0]])
    layer = layer_of(spark, grid, 2, 2)
    layer.unionAll(layer.where("spatial_key.col = 0")).unionAll(spark.createDataFrame([((9, 9), None)], "spatial_key struct<col:int,row:int>, band struct<cols:int,rows:int,cells:array<double>>")).createOrReplaceTempView("sql_tiles")
    rows = spark.sql("SELECT spatial_key.col AS c, e.* FROM sql_tiles, LATERAL st_explode_tile(band) e ORDER BY c, row_index, column_index").collect()
    assert [(r["c"], r["column_index"], r["row_index"], r["value"]) for r in rows if r["c"] == 1] == [(1, 0, 0, 3.0), (1, 1, 0, 4.0), (1, 0, 1, None), (1, 1, 1, 8.0)]
    assert sum(r["c"] == 0 for r in rows) == 8 and not [r for r in rows if r["c"] == 9]
    plan = spark.sql("SELECT e.value FROM sql_tiles, LATERAL st_explode_tile(band) e")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan


def test_sketches_merge_within_their_error(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(0, 1, 20_000), rng.exponential(50, 5000), np.full(5000, 7.0)])
    rng.shuffle(values)
    df = spark.createDataFrame([(int(i % 40), float(v)) for i, v in enumerate(values)], "g int, v double").repartition(6)
    odd = spark.createDataFrame([(0, None), (0, float("nan")), (99, None)], "g int, v double")
    parts = quantile_sketches(df.unionAll(odd), "v", ["g"])
    assert parts.count() == 41
    shares = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    merged = merge_sketches(parts).select(sketch_quantiles(shares).alias("q"), F.kll_sketch_get_n_double("sketch").alias("n")).first()
    assert merged["n"] == 30_000 and merged["q"][0] == values.min() and merged["q"][-1] == values.max()
    for p, q in zip(shares, merged["q"]):
        assert (values < q).mean() - 0.01 <= p <= (values <= q).mean() + 0.01
    exact = exact_quantiles(df, "v", [0.5])[0]
    assert abs(merged["q"][3] - exact) < 0.2
    assert parts.where("g = 99").select(sketch_quantiles([0.5]).alias("q")).first()["q"] is None
    assert quantile_sketches(df.limit(0), "v").select(sketch_quantiles([0.5]).alias("q")).collect()[0]["q"] is None
    assert quantile_sketches(df.limit(0), "v", ["g"]).collect() == []
