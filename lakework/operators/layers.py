"""Tile layers: cutting, georeferencing, joining on the grid, mosaics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakework.functions.geometry import make_box
from lakework.functions.tiles import cells_of, cols_of, make_tile, rows_of
from lakework.operators.cells import is_tile, merge_repeated, paint_patches, tile_columns, unique_tiles, window_cells

KEY = "spatial_key"


def as_layer(df: DataFrame) -> DataFrame:
    """Check that a frame is a layer: a ``spatial_key`` of col and row, and at least one tile."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    if KEY not in fields or getattr(fields[KEY], "names", None) != ["col", "row"]:
        raise ValueError(f"a layer needs {KEY}: struct<col,row>")
    if not any(is_tile(t) for t in fields.values()):
        raise ValueError("a layer needs a tile column")
    return df


def to_layer(raster: DataFrame, cols: int, rows: int, name: str, tile: str = "tile") -> DataFrame:
    """Cut a raster into tiles of one size and give each its ``spatial_key``.

    The raster is one row, or many rows with ``col_off`` and ``row_off``, the place
    of each piece in the whole. Pieces are cut into windows first; a target tile
    gathers the windows that fall on it, and what no window covers is NoData.
    """
    off_x = F.col("col_off") if "col_off" in raster.columns else F.lit(0)
    off_y = F.col("row_off") if "row_off" in raster.columns else F.lit(0)
    pieces = raster.select(
        off_x.cast("int").alias("ox"), off_y.cast("int").alias("oy"),
        cols_of(tile).alias("w"), rows_of(tile).alias("h"), cells_of(tile).alias("cells"),
    )
    keyed = pieces.select(
        "*",
        F.explode(F.expr(f"sequence(CAST(floor(ox / {cols}) AS INT), CAST(floor((ox + w - 1) / {cols}) AS INT))")).alias("col"),
    ).select(
        "*",
        F.explode(F.expr(f"sequence(CAST(floor(oy / {rows}) AS INT), CAST(floor((oy + h - 1) / {rows}) AS INT))")).alias("row"),
    )
    x0 = F.greatest(F.col("col") * cols, F.col("ox"))
    x1 = F.least((F.col("col") + 1) * cols, F.col("ox") + F.col("w"))
    y0 = F.greatest(F.col("row") * rows, F.col("oy"))
    y1 = F.least((F.col("row") + 1) * rows, F.col("oy") + F.col("h"))
    cut = keyed.select(
        "col", "row", (x0 - F.col("col") * cols).alias("x"), (y0 - F.col("row") * rows).alias("y"),
        (x1 - x0).alias("pw"), (y1 - y0).alias("ph"),
        window_cells(F.col("cells"), F.col("w"), x0 - F.col("ox"), y0 - F.col("oy"), x1 - x0, y1 - y0).alias("cells"),
    )
    # One window per place: repeated pieces merge cell by cell before a tile gathers its windows.
    once = merge_repeated(cut, ["col", "row", "x", "y", "pw", "ph"], ["cells"])
    patch = F.struct("x", "y", F.col("pw").alias("w"), F.col("ph").alias("h"), "cells")
    gathered = once.groupBy("col", "row").agg(F.sort_array(F.collect_list(patch)).alias("_patches"))
    return gathered.select(
        F.struct("col", "row").alias(KEY),
        make_tile(paint_patches(F.col("_patches"), cols, rows), cols, rows).alias(name),
    )


def with_crs(layer: DataFrame, crs: str) -> DataFrame:
    return layer.withColumn("crs", F.lit(crs))


def key_extent(col: Column, row: Column, cols: int, rows: int, origin: tuple[float, float], cell: float) -> Column:
    """Extent of the tile at a key; the origin is the upper left corner of key (0, 0)."""
    x, y = origin
    return make_box(
        x + col * (cols * cell), y - (row + 1) * (rows * cell), x + (col + 1) * (cols * cell), y - row * (rows * cell)
    )


def with_extent(
    layer: DataFrame, cols: int, rows: int, origin: tuple[float, float] = (0.0, 0.0), cell: float = 1.0
) -> DataFrame:
    """Add the extent of each tile from the layout. Row 0 is the northernmost."""
    return layer.withColumn("extent", key_extent(F.col(f"{KEY}.col"), F.col(f"{KEY}.row"), cols, rows, origin, cell))


def layer_metadata(layer: DataFrame) -> DataFrame:
    """One row: key bounds, tile size, and CRS and extent where the layer has them.

    A layer has one CRS and one tile size; a mixed one fails.
    """
    tile = tile_columns(layer)[0]

    def one(value: Column, what: str) -> Column:
        low, high = F.min(value), F.max(value)
        return F.when(low.eqNullSafe(high), high).otherwise(F.raise_error(F.lit(f"the layer has more than one {what}")))

    fields = [
        F.min(f"{KEY}.col").alias("min_col"), F.max(f"{KEY}.col").alias("max_col"),
        F.min(f"{KEY}.row").alias("min_row"), F.max(f"{KEY}.row").alias("max_row"),
        one(cols_of(tile), "tile width").alias("tile_cols"), one(rows_of(tile), "tile height").alias("tile_rows"),
        F.count("*").alias("tiles"),
    ]
    if "crs" in layer.columns:
        fields.append(one(F.col("crs"), "CRS").alias("crs"))
    if "extent" in layer.columns:
        fields += [
            F.min("extent.xmin").alias("xmin"), F.min("extent.ymin").alias("ymin"),
            F.max("extent.xmax").alias("xmax"), F.max("extent.ymax").alias("ymax"),
        ]
    return layer.agg(*fields)


def spatial_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join two layers of one grid on their key. The key stays once, bands stand side by side.

    Georeference columns that both sides have are taken from the left.
    """
    shared = [c for c in right.columns if c in left.columns and c in ("crs", "extent")]
    return left.join(right.drop(*shared), on=KEY, how=how)


def to_raster(layer: DataFrame, band: str, width: int, height: int, resample: str = "nearest", unique: bool = False) -> DataFrame:
    """Mosaic a band and resample it to width x height cells: ``column_index, row_index, value``.

    Each tile works out by integer arithmetic which output cells its own cells feed,
    so ``nearest`` needs no join and no shuffle; ``bilinear`` adds up the weighted
    parts of the neighbouring cells per output cell. Cells without data are left out.
    Tiles that share a key are one tile first, cell by cell the largest value; ``unique`` says that
    there are none, which saves a pass over the layer.
    """
    layer = layer if unique else unique_tiles(layer, [band])
    meta = layer_metadata(layer).first()
    if meta.tiles == 0:
        raise ValueError("the layer is empty")
    tc, tr = meta.tile_cols, meta.tile_rows
    total_w = (meta.max_col - meta.min_col + 1) * tc
    total_h = (meta.max_row - meta.min_row + 1) * tr
    start = layer.where(F.col(band).isNotNull()).select(
        ((F.col(f"{KEY}.col") - meta.min_col) * tc).cast("long").alias("sx"),
        ((F.col(f"{KEY}.row") - meta.min_row) * tr).cast("long").alias("sy"),
        cells_of(band).alias("cells"),
    )
    if resample == "nearest":
        return _nearest_mosaic(start, tc, tr, total_w, total_h, width, height)
    if resample == "bilinear":
        return _bilinear_mosaic(start, tc, tr, total_w, total_h, width, height)
    raise ValueError(f"unknown resampling {resample!r}")


def _candidates(start: str, length: int, total: int, out: int, margin: int) -> Column:
    """Output indexes that may read source cells start .. start + length - 1, some too many."""
    low = f"CAST(floor((({start} - {margin}) * {out}D) / {total}) AS LONG) - 1"
    high = f"CAST(ceil((({start} + {length} + {margin}) * {out}D) / {total}) AS LONG) + 1"
    return F.expr(f"sequence(greatest(0L, {low}), greatest(0L, least({out - 1}L, {high})))")


def _nearest_mosaic(start, tc, tr, total_w, total_h, width, height) -> DataFrame:
    def source(index: str, total: int, out: int) -> str:
        return f"((2 * {index} + 1) * {total}L DIV {2 * out}L)"

    placed = (
        start.select("*", F.explode(_candidates("sx", tc, total_w, width, 0)).alias("ocol"))
        .withColumn("_x", F.expr(f"{source('ocol', total_w, width)} - sx"))
        .where(f"_x BETWEEN 0 AND {tc - 1} AND ocol < {width}")
        .select("*", F.explode(_candidates("sy", tr, total_h, height, 0)).alias("orow"))
        .withColumn("_y", F.expr(f"{source('orow', total_h, height)} - sy"))
        .where(f"_y BETWEEN 0 AND {tr - 1} AND orow < {height}")
    )
    value = F.get("cells", (F.col("_y") * tc + F.col("_x")).cast("int"))
    return placed.select(
        F.col("ocol").alias("column_index"), F.col("orow").alias("row_index"), value.alias("value")
    ).where("value IS NOT NULL")


def _bilinear_mosaic(start, tc, tr, total_w, total_h, width, height) -> DataFrame:
    def parts(index: str, origin: str, total: int, out: int, length: int) -> str:
        """The two source cells around an output centre that lie in this tile, with weights."""
        f = f"((2 * {index} + 1) * {total}D / {2 * out}D - 0.5D)"
        low = f"CAST(floor({f}) AS LONG)"
        return (
            f"filter(array(named_struct('i', {low} - {origin}, 'w', 1 - ({f} - floor({f}))),"
            f" named_struct('i', {low} + 1 - {origin}, 'w', {f} - floor({f}))),"
            f" p -> p.i BETWEEN 0 AND {length - 1} AND p.w > 0)"
        )

    fed = (
        start.select("*", F.explode(_candidates("sx", tc, total_w, width, 1)).alias("ocol"))
        .where(f"ocol < {width}")
        .select("*", F.explode(F.expr(parts("ocol", "sx", total_w, width, tc))).alias("px"))
        .select("*", F.explode(_candidates("sy", tr, total_h, height, 1)).alias("orow"))
        .where(f"orow < {height}")
        .select("*", F.explode(F.expr(parts("orow", "sy", total_h, height, tr))).alias("py"))
        .select(
            "ocol", "orow", (F.col("px.w") * F.col("py.w")).alias("w"),
            F.get("cells", (F.col("py.i") * tc + F.col("px.i")).cast("int")).alias("v"),
        )
        .where("v IS NOT NULL")
    )
    return fed.groupBy(F.col("ocol").alias("column_index"), F.col("orow").alias("row_index")).agg(
        (F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("value")
    )

