"""Tile algebra.

A tile is ``struct<cols:int, rows:int, cells:array<double>>``: cells in row-major
order, row 0 in the north, NULL for NoData. Every function takes and gives Spark
columns, so NULL spreads through the arithmetic by itself and nothing leaves the
JVM. A missing tile (NULL) has NULL cells and stays missing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TILE_DDL = "struct<cols:int,rows:int,cells:array<double>>"
TILE_TYPE = T.StructType(
    [
        T.StructField("cols", T.IntegerType()),
        T.StructField("rows", T.IntegerType()),
        T.StructField("cells", T.ArrayType(T.DoubleType())),
    ]
)

Tile = Column | str
Operand = Column | str | int | float


def _col(value: Tile) -> Column:
    return F.col(value) if isinstance(value, str) else value


def make_tile(cells: Column, cols: Column | int, rows: Column | int) -> Column:
    """Build a tile from row-major cells."""
    as_int = lambda v: (F.lit(v) if isinstance(v, int) else v).cast("int")
    return F.struct(
        as_int(cols).alias("cols"), as_int(rows).alias("rows"), cells.cast("array<double>").alias("cells")
    )


def cells_of(tile: Tile) -> Column:
    return _col(tile)["cells"]


def cols_of(tile: Tile) -> Column:
    return _col(tile)["cols"]


def rows_of(tile: Tile) -> Column:
    return _col(tile)["rows"]


def _like(tile: Tile, cells: Column) -> Column:
    return make_tile(cells, cols_of(tile), rows_of(tile))


def map_cells(tile: Tile, fn: Callable[[Column], Column]) -> Column:
    """Apply a column expression to every cell."""
    return _like(tile, F.transform(cells_of(tile), fn))


def _combine(a: Tile, b: Operand, fn: Callable[[Column, Column], Column]) -> Column:
    if isinstance(b, (int, float)):
        return map_cells(a, lambda x: fn(x, F.lit(float(b))))
    return _like(a, F.zip_with(cells_of(a), cells_of(b), fn))


def st_local_add(a: Tile, b: Operand) -> Column:
    return _combine(a, b, lambda x, y: x + y)


def st_local_subtract(a: Tile, b: Operand) -> Column:
    return _combine(a, b, lambda x, y: x - y)


def st_local_multiply(a: Tile, b: Operand) -> Column:
    return _combine(a, b, lambda x, y: x * y)


def st_local_divide(a: Tile, b: Operand) -> Column:
    """Cell-wise quotient; a zero divisor gives NoData."""
    return _combine(a, b, F.try_divide)


def st_local_less(a: Tile, b: Operand) -> Column:
    """1 where a < b, else 0; NoData stays NoData."""
    return _combine(a, b, lambda x, y: (x < y).cast("double"))


def st_log(tile: Tile) -> Column:
    """Natural logarithm; cells at or below zero become NoData."""
    return map_cells(tile, lambda x: F.when(x > 0, F.ln(x)))


def normalized_difference(a: Tile, b: Operand) -> Column:
    """(a - b) / (a + b), for example NDVI of a near-infrared and a red band."""
    return _combine(a, b, lambda x, y: F.try_divide(x - y, x + y))


def st_mask(tile: Tile, mask: Tile) -> Column:
    """Keep the cells over which the mask holds data."""
    return _combine(tile, mask, lambda x, m: F.when(m.isNotNull(), x))


def convert_cells(tile: Tile, to: str = "double", nodata: float | None = None) -> Column:
    """Change the cell type. ``int`` truncates towards zero; cells equal to ``nodata`` become NoData."""
    if to not in ("int", "double"):
        raise ValueError(f"cell type must be int or double, not {to!r}")

    def convert(x: Column) -> Column:
        value = F.when(~F.isnan(x), x)
        if nodata is not None:
            value = F.when(x != F.lit(float(nodata)), value)
        if to == "int":
            bounded = F.least(F.greatest(value, F.lit(-2147483648.0)), F.lit(2147483647.0))
            value = F.when(value.isNotNull(), bounded).cast("int").cast("double")
        return value

    return map_cells(tile, convert)


def st_tile_sum(tile: Tile) -> Column:
    """Sum of the data cells, 0 when there are none."""
    return F.aggregate(
        cells_of(tile), F.lit(0.0), lambda total, x: total + F.coalesce(x, F.lit(0.0))
    )


def st_no_data_cells(tile: Tile) -> Column:
    return F.size(F.filter(cells_of(tile), lambda x: x.isNull()))


def st_data_cells(tile: Tile) -> Column:
    return F.size(F.filter(cells_of(tile), lambda x: x.isNotNull()))


def st_rgb_composite(red: Tile, green: Tile, blue: Tile) -> Column:
    """One cell per pixel: red * 65536 + green * 256 + blue, each clamped to 0..255."""

    def channel(x: Column) -> Column:
        return F.when(x.isNotNull(), F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(255.0))))

    high = F.zip_with(cells_of(red), cells_of(green), lambda r, g: channel(r) * 65536 + channel(g) * 256)
    return _like(red, F.zip_with(high, cells_of(blue), lambda h, b: (h + channel(b)).cast("double")))


def multiband(*tiles: Tile) -> Column:
    """Stack single-band tiles into one array of tiles."""
    return F.array(*[_col(t) for t in tiles])


def band(stack: Tile, index: int) -> Column:
    """The tile at a zero-based position of a stack."""
    return F.get(_col(stack), F.lit(index))


def st_tile(raster: Tile) -> Column:
    """The tile of a projected raster ``struct<tile, crs, extent>``."""
    return _col(raster)["tile"]


def st_raster_crs(raster: Tile) -> Column:
    return _col(raster)["crs"]


def st_raster_extent(raster: Tile) -> Column:
    return _col(raster)["extent"]


def proj_raster(tile: Tile, crs: Tile, extent: Tile) -> Column:
    """Tile, CRS and extent in one value."""
    return F.struct(_col(tile).alias("tile"), _col(crs).alias("crs"), _col(extent).alias("extent"))


def tile_udf(fn: Callable) -> Callable[..., Column]:
    """Turn a numpy function over 2-D tiles into a column function.

    ``fn`` gets one float array of shape (rows, cols) per tile, NaN for NoData, and
    returns an array of the same shape. Tiles travel in Arrow batches.
    """
    import numpy as np
    import pyarrow as pa

    def per_batch(batch: pa.Array) -> pa.Array:
        names = [batch.type.field(i).name for i in range(batch.type.num_fields)]
        cols, rows, *bands = [batch.field(n) for n in names]
        out = []
        for i in range(len(batch)):
            inputs = [b[i].values for b in bands]
            if any(v is None for v in inputs):
                out.append(None)
                continue
            shape = (rows[i].as_py(), cols[i].as_py())
            arrays = [
                v.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(shape)
                for v in inputs
            ]
            result = np.asarray(fn(*arrays), dtype="float64").reshape(-1)
            out.append(pa.array(result, mask=np.isnan(result)))
        return pa.array(out, type=pa.list_(pa.float64()))

    # The hints above are strings under postponed evaluation; Spark needs the types.
    per_batch.__annotations__ = {"batch": pa.Array, "return": pa.Array}
    cells_udf = F.arrow_udf(per_batch, "array<double>")

    def apply(*tiles: Tile) -> Column:
        packed = F.struct(
            cols_of(tiles[0]).alias("cols"),
            rows_of(tiles[0]).alias("rows"),
            *[cells_of(t).alias(f"c{i}") for i, t in enumerate(tiles)],
        )
        return _like(tiles[0], cells_udf(packed))

    return apply
