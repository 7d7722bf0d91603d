"""Between tiles and cells: explode, assemble, statistics, zones and neighbourhoods."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakework.functions.tiles import cells_of, cols_of, make_tile, rows_of


def is_tile(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.StructType) and data_type.names == ["cols", "rows", "cells"]


def tile_columns(df: DataFrame) -> list[str]:
    """Names of the tile columns, in order."""
    return [f.name for f in df.schema.fields if is_tile(f.dataType)]


def explode_tiles(layer: DataFrame, bands: Sequence[str] | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """One row per cell: kept columns, ``column_index``, ``row_index`` and the band values.

    A band that is missing in a row (after a left join) gives NULL cells.
    """
    bands = list(bands or tile_columns(layer))
    if keep is None:
        keep = [f.name for f in layer.schema.fields if not is_tile(f.dataType)]
    empty = F.array().cast("array<double>")
    zipped = F.arrays_zip(*[F.coalesce(cells_of(b), empty).alias(b) for b in bands])
    width = F.coalesce(*[cols_of(b) for b in bands])
    exploded = layer.select(*keep, width.alias("_w"), F.posexplode(zipped).alias("_p", "_c"))
    return exploded.select(
        *keep,
        (F.col("_p") % F.col("_w")).alias("column_index"),
        F.expr("CAST(_p DIV _w AS INT)").alias("row_index"),
        *[F.col("_c")[b].alias(b) for b in bands],
    )


def no_data_filter(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop the cells with NoData in any of the columns."""
    return df.dropna(subset=list(cols))


def _dense(entries: Column, size: int) -> Column:
    """Row-major cells from ``(pos, value)`` entries in position order; gaps become NoData."""
    positions = F.transform(entries, lambda e: e["pos"])
    previous = F.concat(F.array(F.lit(-1)), F.slice(positions, 1, F.greatest(F.size(entries) - 1, F.lit(0))))
    blank = F.lit(None).cast("double")
    runs = F.zip_with(
        entries,
        previous,
        lambda e, p: F.concat(F.array_repeat(blank, e["pos"] - p - 1), F.array(e["value"])),
    )
    tail = F.array_repeat(blank, F.lit(size - 1) - F.element_at(positions, -1))
    complete = F.size(entries) == size
    return F.when(complete, F.transform(entries, lambda e: e["value"])).otherwise(F.concat(F.flatten(runs), tail))


def st_assemble_tile(
    df: DataFrame,
    keys: Sequence[str],
    col: str,
    row: str,
    values: str | Sequence[str],
    cols: int,
    rows: int,
    cell_type: str = "double",
    distinct_cells: bool = False,
) -> DataFrame:
    """Gather cells into one tile per key; cells outside the tile are dropped, missing ones are NoData.

    Where several rows hit one cell the largest value stays, settled by a partial
    aggregate first, so that no key gathers more entries than the tile has cells.
    ``distinct_cells`` skips that step for input that is known to be unique.
    """
    names = [values] if isinstance(values, str) else list(values)
    position = (F.col(row) * cols + F.col(col)).cast("int")
    inside = F.col(col).between(0, cols - 1) & F.col(row).between(0, rows - 1)

    def typed(name: str) -> Column:
        value = F.col(name).cast("double")
        return value if cell_type == "double" else value.cast("int").cast("double")

    cells = df.where(inside).select(*keys, position.alias("_pos"), *[typed(n).alias(n) for n in names])
    if not distinct_cells:
        cells = cells.groupBy(*keys, "_pos").agg(*[F.max(n).alias(n) for n in names])
    entry = F.struct(F.col("_pos").alias("pos"), *[F.col(n).alias(f"v{i}") for i, n in enumerate(names)])
    gathered = cells.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("_entries"))

    def band(i: int) -> Column:
        picked = F.transform(
            "_entries", lambda e: F.struct(e["pos"].alias("pos"), e[f"v{i}"].alias("value"))
        )
        return picked

    picked = gathered.select(*keys, *[band(i).alias(f"_e{i}") for i in range(len(names))])
    return picked.select(
        *keys,
        *[make_tile(_dense(F.col(f"_e{i}"), cols * rows), cols, rows).alias(n) for i, n in enumerate(names)],
    )


def merge_repeated(df: DataFrame, keys: Sequence[str], arrays: Sequence[str]) -> DataFrame:
    """One row of ``keys`` and ``arrays`` per key; where a key repeats, cell by cell the largest value.

    Only the rows of repeated keys are taken apart; whether there are any is asked first.
    """
    repeated = df.groupBy(*keys).count().where("count > 1").select(*keys)
    if repeated.isEmpty():
        return df.select(*keys, *arrays)
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    rest = df.alias("d").join(repeated.alias("r"), reduce(and_, same), "left_anti").select(*keys, *arrays)
    empty = F.array().cast("array<double>")
    cells = (
        df.alias("d").join(repeated.alias("r"), reduce(and_, same), "left_semi")
        .select(*keys, F.posexplode(F.arrays_zip(*[F.coalesce(F.col(a), empty).alias(a) for a in arrays])).alias("_p", "_c"))
        .groupBy(*keys, "_p").agg(*[F.max(F.col("_c")[a]).alias(a) for a in arrays])
    )
    gathered = cells.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_p", *arrays))).alias("_e"))

    def cells_in_order(name: str) -> Column:
        return F.transform("_e", lambda e: e[name]).alias(name)

    merged = gathered.select(*keys, *map(cells_in_order, arrays))
    return rest.unionByName(merged)


def unique_tiles(layer: DataFrame, bands: Sequence[str], key: str = "spatial_key") -> DataFrame:
    """Key and bands of a layer with every key once, as in a union of scenes on one grid."""
    flat = layer.select(
        F.col(f"{key}.col").alias("_col"), F.col(f"{key}.row").alias("_row"), cols_of(bands[0]).alias("_w"), rows_of(bands[0]).alias("_h"),
        *[cells_of(b).alias(b) for b in bands],
    )
    once = merge_repeated(flat, ["_col", "_row", "_w", "_h"], bands)
    return once.select(
        F.struct(F.col("_col").alias("col"), F.col("_row").alias("row")).alias(key),
        *[F.when(F.col(b).isNotNull(), F.struct(F.col("_w").alias("cols"), F.col("_h").alias("rows"), F.col(b).alias("cells"))).alias(b) for b in bands],
    )


def st_agg_local_min(df: DataFrame, tile: str, keys: Sequence[str], cols: int, rows: int) -> DataFrame:
    """Cell-wise minimum over the tiles of each group; NoData is skipped."""
    cells = explode_tiles(df, [tile], keep=list(keys))
    least = cells.groupBy(*keys, "column_index", "row_index").agg(F.min(tile).alias(tile))
    return st_assemble_tile(least, keys, "column_index", "row_index", tile, cols, rows, distinct_cells=True)


def st_agg_stats(df: DataFrame, tile: str) -> DataFrame:
    """Data and NoData cells, extremes, mean and population variance of a tile column."""
    return _stats(df.select(F.explode(cells_of(tile)).alias("v")).agg, "v")


def _stats(agg, value: str) -> DataFrame:
    return agg(
        F.count(value).alias("data_cells"),
        (F.count("*") - F.count(value)).alias("no_data_cells"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.avg(value).alias("mean"),
        F.var_pop(value).alias("variance"),
    )


def zonal_stats(layer: DataFrame, value: str, zone: str) -> DataFrame:
    """Statistics of one band inside the zones that another band marks."""
    cells = explode_tiles(layer, [value, zone], keep=[]).where(F.col(zone).isNotNull())
    return _stats(cells.groupBy(F.col(zone).alias("zone")).agg, value)


# -- patches: rectangles of cells on their way to another tile ---------------------

PATCH_DDL = "struct<x:int,y:int,w:int,h:int,cells:array<double>>"


def window_cells(cells: Column, width: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """The cells of a window of a row-major tile, row-major again."""
    strip = F.transform(F.sequence(y, y + h - 1), lambda r: F.slice(cells, r * width + x + 1, w))
    return F.flatten(strip)


def _paint(canvas: np.ndarray, patches: pa.StructScalar) -> None:
    """Draw patches on a canvas of shape (rows, cols); NoData in a patch leaves the canvas as it is."""
    height, width = canvas.shape
    xs, ys, ws, hs, cells = (patches.field(n) for n in ("x", "y", "w", "h", "cells"))
    for i in range(len(patches)):
        x, y, w, h = (a[i].as_py() for a in (xs, ys, ws, hs))
        block = cells[i].values.fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(h, w)
        x0, y0, x1, y1 = max(x, 0), max(y, 0), min(x + w, width), min(y + h, height)
        if x0 < x1 and y0 < y1:
            part = block[y0 - y : y1 - y, x0 - x : x1 - x]
            target = canvas[y0:y1, x0:x1]
            np.copyto(target, part, where=~np.isnan(part))


def _cells_of_canvases(canvases: list[np.ndarray]) -> pa.Array:
    flat = [c.reshape(-1) for c in canvases]
    values = np.concatenate(flat) if flat else np.empty(0)
    offsets = np.cumsum([0, *[len(f) for f in flat]]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, mask=np.isnan(values)))


def paint_patches(patches: Column, cols: int, rows: int) -> Column:
    """Dense cells of a cols x rows tile from a short list of patches, in Arrow batches."""

    def per_batch(batch: pa.Array) -> pa.Array:
        canvases = []
        for i in range(len(batch)):
            canvas = np.full((rows, cols), np.nan)
            _paint(canvas, batch[i].values)
            canvases.append(canvas)
        return _cells_of_canvases(canvases)

    per_batch.__annotations__ = {"batch": pa.Array, "return": pa.Array}
    return F.arrow_udf(per_batch, "array<double>")(patches)


def _focal(layer: DataFrame, band: str, radius: int, cols: int, rows: int, key: str, unique: bool, kernel) -> DataFrame:
    """Apply ``kernel`` (a canvas with ``radius`` cells around the tile, NaN for NoData, to the tile's cells) to every tile.

    Every tile sends itself to its own key and only its border strips to its
    neighbours, so a tile gathers one patch per neighbour and the shuffle grows with
    the perimeter. Tiles that share a key are one tile first; ``unique`` says that there are none.
    """
    if radius < 0:
        raise ValueError("radius must not be negative")
    reach_x, reach_y = math.ceil(radius / cols), math.ceil(radius / rows)
    steps = [(dx, dy) for dx in range(-reach_x, reach_x + 1) for dy in range(-reach_y, reach_y + 1)]
    sent = (layer if unique else unique_tiles(layer, [band], key)).select(
        F.col(f"{key}.col").alias("_c"), F.col(f"{key}.row").alias("_r"), cells_of(band).alias("_cells"),
        F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in steps])).alias("_d"),
    )
    dx, dy = F.col("_d.dx"), F.col("_d.dy")
    # Window of the source tile that the neighbour at (dx, dy) sees, in source cells.
    x0 = F.greatest(F.lit(0), dx * cols - radius)
    x1 = F.least(F.lit(cols), (dx + 1) * cols + radius)
    y0 = F.greatest(F.lit(0), dy * rows - radius)
    y1 = F.least(F.lit(rows), (dy + 1) * rows + radius)
    sent = sent.select(
        (F.col("_c") + dx).alias("col"), (F.col("_r") + dy).alias("row"), "_cells",
        dx.alias("_dx"), dy.alias("_dy"), ((dx == 0) & (dy == 0) & F.col("_cells").isNotNull()).alias("_own"),
        (x0 - dx * cols + radius).alias("x"), (y0 - dy * rows + radius).alias("y"),
        (x1 - x0).alias("w"), (y1 - y0).alias("h"), x0.alias("x0"), y0.alias("y0"),
    )
    part = window_cells(
        F.col("_cells"), F.lit(cols), F.col("x0"), F.col("y0"), F.col("w"), F.col("h")
    )
    part = F.when(F.col("_own"), F.col("_cells")).otherwise(part)
    patch = F.when(F.col("_cells").isNotNull(), F.struct("x", "y", "w", "h", part.alias("cells")))
    # One aggregate per direction: a group holds one patch of each, whatever the input repeats.
    gathered = (
        sent.where("w > 0 AND h > 0")
        .select("col", "row", "_own", "_dx", "_dy", patch.alias("_patch"))
        .groupBy("col", "row")
        .agg(
            F.max("_own").alias("_own"),
            F.array_compact(
                F.array(
                    *[F.max(F.when((F.col("_dx") == dx) & (F.col("_dy") == dy), F.col("_patch"))) for dx, dy in steps]
                )
            ).alias("_patches"),
        )
        .where("_own")
    )

    def per_batch(batch: pa.Array) -> pa.Array:
        canvases = []
        for i in range(len(batch)):
            canvas = np.full((rows + 2 * radius, cols + 2 * radius), np.nan)
            _paint(canvas, batch[i].values)
            canvases.append(kernel(canvas))
        return _cells_of_canvases(canvases)

    per_batch.__annotations__ = {"batch": pa.Array, "return": pa.Array}
    focal = F.arrow_udf(per_batch, "array<double>")
    return gathered.select(
        F.struct("col", "row").alias(key), make_tile(focal(F.col("_patches")), cols, rows).alias(band)
    )


def focal_mean(layer: DataFrame, band: str, radius: int, cols: int, rows: int, key: str = "spatial_key", unique: bool = False) -> DataFrame:
    """Mean of the data cells in the (2r+1) x (2r+1) window around each cell, across tile edges.

    Windows without data give NoData. Sums come from a summed-area table, so the work does not
    grow with the radius.
    """
    side = 2 * radius + 1

    def sums(values: np.ndarray) -> np.ndarray:
        area = np.pad(values.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        return area[side:, side:] - area[:-side, side:] - area[side:, :-side] + area[:-side, :-side]

    def kernel(canvas: np.ndarray) -> np.ndarray:
        known = ~np.isnan(canvas)
        count = sums(known.astype("int64"))
        # Around the mean, so that the running sums stay small and exact to the last digits.
        middle = canvas[known].mean() if known.any() else 0.0
        total = sums(np.where(known, canvas - middle, 0.0)) + middle * count
        return np.divide(total, count, out=np.full((rows, cols), np.nan), where=count > 0)

    return _focal(layer, band, radius, cols, rows, key, unique, kernel)


def running_max(values: np.ndarray, side: int, axis: int) -> np.ndarray:
    """Largest of every ``side`` neighbours along an axis, by two passes over blocks of ``side``.

    One pass keeps the largest from each block's start, the other from its end; a window spans the end
    of one block and the start of the next, so each cell takes two comparisons whatever the side.
    """
    values = np.moveaxis(values, axis, -1)
    n = values.shape[-1]
    padded = np.concatenate([values, np.full((*values.shape[:-1], -n % side), -np.inf)], axis=-1)
    blocks = padded.reshape(*values.shape[:-1], -1, side)
    ahead = np.maximum.accumulate(blocks, axis=-1).reshape(padded.shape)
    back = np.maximum.accumulate(blocks[..., ::-1], axis=-1)[..., ::-1].reshape(padded.shape)
    return np.moveaxis(np.maximum(back[..., : n - side + 1], ahead[..., side - 1 : n]), -1, axis)


def focal_max(layer: DataFrame, band: str, radius: int, cols: int, rows: int, key: str = "spatial_key", unique: bool = False) -> DataFrame:
    """Largest data cell in the (2r+1) x (2r+1) window around each cell, across tile edges; see :func:`running_max`."""
    side = 2 * radius + 1

    def kernel(canvas: np.ndarray) -> np.ndarray:
        most = running_max(running_max(np.where(np.isnan(canvas), -np.inf, canvas), side, 0), side, 1)
        return np.where(most == -np.inf, np.nan, most)

    return _focal(layer, band, radius, cols, rows, key, unique, kernel)


def focal_min(layer: DataFrame, band: str, radius: int, cols: int, rows: int, key: str = "spatial_key", unique: bool = False) -> DataFrame:
    """Smallest data cell in the (2r+1) x (2r+1) window around each cell, across tile edges."""
    side = 2 * radius + 1

    def kernel(canvas: np.ndarray) -> np.ndarray:
        least = running_max(running_max(np.where(np.isnan(canvas), -np.inf, -canvas), side, 0), side, 1)
        return np.where(least == -np.inf, np.nan, -least)

    return _focal(layer, band, radius, cols, rows, key, unique, kernel)


class _RankHistogram:
    """Counts of the ranks in a sliding window for all rows at once, coarse and fine, so that the middle is found in two steps."""

    def __init__(self, rows: int, ranks: int) -> None:
        self.width = max(1, math.isqrt(max(1, ranks)))
        self.fine = np.zeros((rows, -(-ranks // self.width) * self.width + self.width), np.int32)
        self.coarse = np.zeros((rows, self.fine.shape[1] // self.width), np.int32)
        self.row = np.arange(rows)

    def add(self, ranks: np.ndarray, sign: int) -> None:
        """Add (or take) the ranks of one cell per row; -1 is no data."""
        own = np.flatnonzero(ranks >= 0)
        self.fine[own, ranks[own]] += sign
        self.coarse[own, ranks[own] // self.width] += sign

    def nth(self, n: np.ndarray) -> np.ndarray:
        """Per row the rank of which more than ``n`` counted ones are not above."""
        sums = np.cumsum(self.coarse, axis=1)
        block = (sums > n[:, None]).argmax(axis=1)
        left = n - np.where(block > 0, sums[self.row, np.maximum(block - 1, 0)], 0)
        fine = self.fine[self.row[:, None], block[:, None] * self.width + np.arange(self.width)[None, :]]
        return block * self.width + (np.cumsum(fine, axis=1) > left[:, None]).argmax(axis=1)


def focal_median(layer: DataFrame, band: str, radius: int, cols: int, rows: int, key: str = "spatial_key", unique: bool = False) -> DataFrame:
    """Median of the data cells in the (2r+1) x (2r+1) window around each cell, across tile edges.

    Of an even number the mean of the two middle ones. The window slides along all rows of a tile at
    once over a histogram of the cells' ranks: a step adds one column of the window and takes one.
    """
    side = 2 * radius + 1

    def kernel(canvas: np.ndarray) -> np.ndarray:
        values, inverse = np.unique(canvas[~np.isnan(canvas)], return_inverse=True)
        if not len(values):
            return np.full((rows, cols), np.nan)
        ranks = np.full(canvas.shape, -1)
        ranks[~np.isnan(canvas)] = inverse
        out, count = np.empty((rows, cols)), np.zeros(rows, np.int64)
        histogram = _RankHistogram(rows, len(values))

        def slide(column: int, sign: int) -> None:
            for dy in range(side):
                cells = ranks[dy : dy + rows, column]
                histogram.add(cells, sign)
                count[:] += sign * (cells >= 0)

        for column in range(side - 1):
            slide(column, 1)
        for x in range(cols):
            slide(x + side - 1, 1)
            held = np.maximum(count, 1)
            low, high = histogram.nth((held - 1) // 2), histogram.nth(held // 2)
            last = len(values) - 1
            out[:, x] = np.where(count > 0, (values[np.minimum(low, last)] + values[np.minimum(high, last)]) / 2, np.nan)
            slide(x, -1)
        return out

    return _focal(layer, band, radius, cols, rows, key, unique, kernel)
