"""Pyramids of tile layers and their space-filling key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakework.functions.curves import interleave
from lakework.functions.tiles import cells_of, make_tile
from lakework.operators.cells import tile_columns, unique_tiles
from lakework.operators.layers import KEY
from lakework.operators.resample import _uniform
from lakework.session import cut_lineage


def z_key(col: Column | str, row: Column | str, bits: int = 31) -> Column:
    """Z-curve position of a key: the bits of col and row in turn, col lowest."""
    return interleave([F.col(v) if isinstance(v, str) else v for v in (col, row)], bits)


def _halved(cells: Column, cols: int, rows: int) -> Column:
    """Mean of the data cells in each 2 x 2 block: a quarter of the cells."""
    half = cols // 2

    def block(i: Column) -> Column:
        at = F.floor(i / half).cast("int") * (2 * cols) + (i % half) * 2
        four = [F.get(cells, at + d) for d in (0, 1, cols, cols + 1)]
        total = reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0.0)) for v in four])
        count = reduce(lambda a, b: a + b, [v.isNotNull().cast("int") for v in four])
        return F.try_divide(total, count)

    return F.transform(F.sequence(F.lit(0), F.lit(cols * rows // 4 - 1)), block)


def parent_level(layer: DataFrame, cols: int, rows: int, unique: bool = False) -> DataFrame:
    """The next coarser level: 2 x 2 cells become one, 2 x 2 tiles become one.

    Tiles shrink before the shuffle, so a quarter of the data moves, and each parent
    keeps one value per quadrant. Tiles that share a key are made one first; ``unique``
    says that there are none.
    """
    if cols % 2 or rows % 2:
        raise ValueError("tile sizes must be even")
    bands = tile_columns(layer)
    layer = layer if unique else unique_tiles(layer, bands)
    small = layer.select(
        F.floor(F.col(f"{KEY}.col") / 2).cast("int").alias("col"),
        F.floor(F.col(f"{KEY}.row") / 2).cast("int").alias("row"),
        (F.pmod(F.col(f"{KEY}.col"), F.lit(2)) + 2 * F.pmod(F.col(f"{KEY}.row"), F.lit(2))).alias("_q"),
        *[_halved(cells_of(b), cols, rows).alias(b) for b in bands],
    )
    quadrants = [
        F.max(F.when(F.col("_q") == q, F.col(b))).alias(f"_{q}_{b}") for b in bands for q in range(4)
    ]
    gathered = small.groupBy("col", "row").agg(*quadrants)
    blank = F.array_repeat(F.lit(None).cast("double"), cols * rows // 4)
    half_c, half_r = cols // 2, rows // 2

    def halves(b: str, left: int) -> Column:
        """Rows of the upper or lower half: a row of the left quadrant, then of the right one."""
        def row_of(q: int, i: Column) -> Column:
            return F.slice(F.coalesce(F.col(f"_{q}_{b}"), blank), i * half_c + 1, F.lit(half_c))

        return F.transform(
            F.sequence(F.lit(0), F.lit(half_r - 1)), lambda i: F.concat(row_of(left, i), row_of(left + 1, i))
        )

    return gathered.select(
        F.struct("col", "row").alias(KEY),
        *[make_tile(F.flatten(F.concat(halves(b, 0), halves(b, 2))), cols, rows).alias(b) for b in bands],
    )


def build_pyramid(layer: DataFrame, max_zoom: int, min_zoom: int = 0, unique: bool = False) -> DataFrame:
    """All levels from ``max_zoom``, the layer itself, up to ``min_zoom``, with a ``zoom`` column.

    Every level is written once to the checkpoint folder before the next one reads it,
    so the base is not read again for each level. Tiles that share a key are made one first;
    ``unique`` says that there are none.
    """
    if min_zoom > max_zoom:
        raise ValueError("min_zoom must not be above max_zoom")
    bands = tile_columns(layer)
    base = layer.select(KEY, *bands)
    cols, rows = _uniform(base, f"{bands[0]}.cols", f"{bands[0]}.rows")
    levels, current = [base.withColumn("zoom", F.lit(max_zoom))], base if unique else unique_tiles(base, bands)
    for zoom in range(max_zoom - 1, min_zoom - 1, -1):
        current = cut_lineage(parent_level(current, cols, rows, unique=True))
        levels.append(current.withColumn("zoom", F.lit(zoom)))
    return reduce(DataFrame.unionByName, levels)
