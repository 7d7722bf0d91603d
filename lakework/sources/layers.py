"""Stored tile layers: parquet partitioned by name and zoom, and a small catalog beside it."""

from __future__ import annotations

import json
import time
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakework.functions.curves import curve_ranges, in_ranges
from lakework.functions.tiles import cols_of, rows_of
from lakework.operators.cells import tile_columns
from lakework.operators.layers import KEY
from lakework.operators.pyramid import z_key


def write_layer(df: DataFrame, root: str, name: str) -> None:
    """Store the levels of a layer in Z-curve order, and list them in the catalog.

    ``df`` has ``spatial_key``, ``zoom`` and tile columns. Rows are ranged by zoom and
    curve position, so neighbours share files and a box query skips the rest by the
    key's statistics. A layer that is there is replaced: its levels are written over, and
    the newest write alone is listed. The catalog keeps the columns of each write.
    """
    keyed = df.withColumns({"z": z_key(f"{KEY}.col", f"{KEY}.row"), "name": F.lit(name), "zoom": F.col("zoom").cast("int")})
    ordered = keyed.repartitionByRange("zoom", "z").sortWithinPartitions("zoom", "z")
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("name", "zoom").parquet(f"{root}/tiles")
    tile = tile_columns(df)[0]
    columns = T.StructType([f for f in keyed.schema.fields if f.name not in ("name", "zoom")])
    # The listing reads back what was stored, key and tile sizes only.
    stored = _tiles(df.sparkSession, root, columns.json()).where(F.col("name") == name)
    entry = stored.groupBy("name", "zoom").agg(
        F.count("*").alias("tiles"),
        F.min(f"{KEY}.col").alias("min_col"), F.max(f"{KEY}.col").alias("max_col"),
        F.min(f"{KEY}.row").alias("min_row"), F.max(f"{KEY}.row").alias("max_row"),
        F.max(cols_of(tile)).alias("tile_cols"), F.max(rows_of(tile)).alias("tile_rows"),
    )
    levels = [r.zoom for r in df.select(F.col("zoom").cast("int").alias("zoom")).distinct().collect()]  # a few levels
    listed = entry.where(F.col("zoom").isin(levels)).select(
        F.struct(
            F.struct("name", "zoom").alias("id"),
            "tiles", "min_col", "max_col", "min_row", "max_row", "tile_cols", "tile_rows",
        ).alias("layer"),
        F.lit(time.time_ns()).alias("written"), F.lit(columns.json()).alias("columns"),
    )
    listed.write.mode("append").parquet(f"{root}/catalog")


def _tiles(spark: SparkSession, root: str, columns: str) -> DataFrame:
    """The tile folder with the columns of one layer."""
    schema = T.StructType.fromJson(json.loads(columns)).add("name", T.StringType()).add("zoom", T.IntegerType())
    return spark.read.schema(schema).parquet(f"{root}/tiles")


def read_layer_catalog(spark: SparkSession, root: str) -> DataFrame:
    """One row per stored layer and zoom, with the nested ``layer.id.name`` and ``layer.id.zoom``, and its columns."""
    entries = spark.read.parquet(f"{root}/catalog")
    newest = entries.groupBy(F.col("layer.id.name").alias("name")).agg(F.max("written").alias("newest"))
    current = entries.join(newest, (F.col("layer.id.name") == F.col("name")) & (F.col("written") == F.col("newest")))
    return current.select("layer", "columns")


def load_layers(spark: SparkSession, root: str, catalog: DataFrame) -> DataFrame:
    """The union of the layers that a catalog frame lists; only their folders are read.

    A band that one of them lacks is NULL there.
    """
    # A catalog has one row per layer and level.
    chosen = catalog.select("layer.id.name", "layer.id.zoom", "columns").collect()
    if not chosen:
        raise ValueError("no layer chosen")
    by_columns: dict[str, list] = {}
    for r in chosen:
        by_columns.setdefault(r.columns, []).append((F.col("name") == r.name) & (F.col("zoom") == r.zoom))
    parts = [_tiles(spark, root, columns).where(reduce(or_, wanted)).drop("z") for columns, wanted in sorted(by_columns.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def window_ranges(first: tuple[int, int], last: tuple[int, int], max_ranges: int = 32) -> list[tuple[int, int]]:
    """Z ranges of a window of tile keys (col, row), both corners included; negative keys follow the others."""
    half = 1 << 31
    sides = []
    for a, b in zip(first, last):
        pieces = [(max(a, 0), min(b, half - 1)), (half + max(a, -half), half + min(b, -1))]
        sides.append([(lo, hi) for lo, hi in pieces if lo <= hi])
    boxes = [(c, r) for c in sides[0] for r in sides[1]]
    each = max(1, max_ranges // max(1, len(boxes)))
    return sorted(z for (c0, c1), (r0, r1) in boxes for z in curve_ranges((c0, r0), (c1, r1), 31, each))


def load_window(
    spark: SparkSession, root: str, name: str, zoom: int, first: tuple[int, int], last: tuple[int, int], max_ranges: int = 32
) -> DataFrame:
    """The tiles of a stored layer from key ``first`` to key ``last``, (col, row), both included.

    The window is asked for as a few ranges of the Z key, in the order of which the files lie, so
    all others are skipped by their statistics; the keys themselves decide what is left.
    """
    entries = read_layer_catalog(spark, root).where((F.col("layer.id.name") == name) & (F.col("layer.id.zoom") == zoom))
    columns = entries.select("columns").first()
    if columns is None:
        raise ValueError(f"no layer {name!r} at zoom {zoom}")
    tiles = _tiles(spark, root, columns[0]).where((F.col("name") == name) & (F.col("zoom") == zoom))
    near = tiles.where(in_ranges(F.col("z"), window_ranges(first, last, max_ranges)))
    inside = F.col(f"{KEY}.col").between(first[0], last[0]) & F.col(f"{KEY}.row").between(first[1], last[1])
    return near.where(inside).drop("z")


def write_image(df: DataFrame, root: str, image_id: int, level: int) -> None:
    """Store one pyramid level of an image."""
    tagged = df.withColumns({"image": F.lit(image_id), "level": F.lit(level)})
    tagged.write.mode("append").partitionBy("image", "level").parquet(root)


def load_image(spark: SparkSession, root: str, image_id: int, level: int) -> DataFrame:
    """The tiles of an image at a pyramid level; other images and levels are not read."""
    chosen = (F.col("image") == image_id) & (F.col("level") == level)
    return spark.read.parquet(root).where(chosen).drop("image", "level")
