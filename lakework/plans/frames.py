"""Frames derived from the given tables, and the same frames in SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakework.functions.tiles import make_tile, map_cells
from lakework.operators.layers import KEY, with_crs, with_extent
from lakework.plans.registry import table

SIDE = 8  # an embedding of 64 numbers is a tile of 8 x 8 cells
ACROSS = 25  # tiles per row of the layer
COARSE_ACROSS = 20  # tiles per row of the second grid


def _tiles(spark: SparkSession, sf_dir: str, across: int) -> DataFrame:
    """Each embedding as a tile of digital numbers, placed row by row."""
    numbers = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 10000).cast("double"))
    return table(spark, sf_dir, "embeddings").select(
        F.struct(
            (F.col("vec_id") % across).cast("int").alias("col"),
            F.expr(f"CAST(vec_id DIV {across} AS INT)").alias("row"),
        ).alias(KEY),
        numbers.alias("numbers"),
        F.col("label").cast("double").alias("label"),
    )


def band_layer(spark: SparkSession, sf_dir: str, band: str) -> DataFrame:
    """A layer with one band: ``band_1`` is the embedding, ``band_2`` the same reversed."""
    cells = F.col("numbers") if band == "band_1" else F.reverse("numbers")
    return _tiles(spark, sf_dir, ACROSS).select(KEY, make_tile(cells, SIDE, SIDE).alias(band))


def layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both bands; a tile per embedding, so every key is there once."""
    return _tiles(spark, sf_dir, ACROSS).select(
        KEY,
        make_tile(F.col("numbers"), SIDE, SIDE).alias("band_1"),
        make_tile(F.reverse("numbers"), SIDE, SIDE).alias("band_2"),
    )


def gappy_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layer with NoData: low cells of band_1 and high cells of band_2 are missing."""
    full = layer(spark, sf_dir)
    return full.select(
        KEY,
        map_cells("band_1", lambda x: F.when(x >= 8000, x)).alias("band_1"),
        map_cells("band_2", lambda x: F.when(x <= 12000, x)).alias("band_2"),
    )


def label_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of each embedding in all cells of its tile."""
    tiles = _tiles(spark, sf_dir, ACROSS)
    return tiles.select(KEY, make_tile(F.transform("numbers", lambda _: F.col("label")), SIDE, SIDE).alias("target"))


CELLS = f"""
SELECT vec_id, label, CAST(vec_id % {ACROSS} AS INTEGER) AS tile_col, CAST(vec_id // {ACROSS} AS INTEGER) AS tile_row,
       CAST((i - 1) % {SIDE} AS INTEGER) AS column_index, CAST((i - 1) // {SIDE} AS INTEGER) AS row_index,
       floor((CAST(embedding[i] AS DOUBLE) + 1) * 10000) AS band_1,
       floor((CAST(embedding[{SIDE * SIDE + 1} - i] AS DOUBLE) + 1) * 10000) AS band_2
FROM embeddings, range(1, {SIDE * SIDE + 1}) t(i)
"""

GAPPY_CELLS = f"""
SELECT vec_id, label, tile_col, tile_row, column_index, row_index,
       CASE WHEN band_1 >= 8000 THEN band_1 END AS band_1,
       CASE WHEN band_2 <= 12000 THEN band_2 END AS band_2
FROM ({CELLS})
"""

GEO_ORIGIN, GEO_CELL = (-25.0, 80.0), 0.25


def geo_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gappy layer in degrees: 2 x 2 degree tiles from 25 W, 80 N."""
    placed = with_extent(gappy_layer(spark, sf_dir), SIDE, SIDE, GEO_ORIGIN, GEO_CELL)
    return with_crs(placed, "EPSG:4326")


def plain_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gappy layer on a plane with cells of size 1 and its upper left corner at (0, 0)."""
    return with_crs(with_extent(gappy_layer(spark, sf_dir), SIDE, SIDE), "EPSG:3857")


def other_grid(
    spark: SparkSession, sf_dir: str, origin: tuple[float, float], cell: float, name: str = "other"
) -> DataFrame:
    """The embeddings again on a second grid with its own tiling, origin and cell size."""
    tiles = _tiles(spark, sf_dir, COARSE_ACROSS)
    one = tiles.select(KEY, make_tile(F.col("numbers"), SIDE, SIDE).alias(name))
    return with_crs(with_extent(one, SIDE, SIDE, origin, cell), "EPSG:3857")


OTHER_CELLS = f"""
SELECT (vec_id % {COARSE_ACROSS}) * {SIDE} + (i - 1) % {SIDE} AS gc, (vec_id // {COARSE_ACROSS}) * {SIDE} + (i - 1) // {SIDE} AS gr,
       floor((CAST(embedding[i] AS DOUBLE) + 1) * 10000) AS other
FROM embeddings, range(1, {SIDE * SIDE + 1}) t(i)
"""


def customer_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lon/lat point for every customer."""
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.expr("CAST(c_custkey * 7919 % 3600 AS DOUBLE) / 10 - 180").alias("x"),
        F.expr("CAST(c_custkey * 104729 % 1700 AS DOUBLE) / 10 - 85").alias("y"),
    )


POINTS = """
SELECT c_custkey, CAST(c_custkey * 7919 % 3600 AS DOUBLE) / 10 - 180 AS x,
       CAST(c_custkey * 104729 % 1700 AS DOUBLE) / 10 - 85 AS y
FROM customer
"""
