"""Pixel classification queries: the bands of the tiles against their labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakework.functions import tiles
from lakework.operators import layers, pixels
from lakework.operators.layers import KEY
from lakework.operators.relational import count_by, layer_stack
from lakework.plans import frames
from lakework.plans.frames import GAPPY_CELLS, SIDE
from lakework.plans.registry import query

BANDS = ["band_1", "band_2"]
_OUT = (150, 135)
# A tree cannot be trained in SQL. With a band that tells the labels apart it has to learn them
# exactly, so what it predicts, and where, can be counted.
TELLING = ["band_1", "telling"]
DEPTH = 9  # enough for ten labels in a row


def _bands(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    gappy = frames.gappy_layer(spark, sf_dir)
    return [gappy.select(KEY, b) for b in BANDS]


def _telling_bands(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    telling = tiles.st_local_subtract(tiles.st_local_multiply("target", -100.0), 5.0)
    return [
        frames.gappy_layer(spark, sf_dir).select(KEY, "band_1"),
        frames.label_layer(spark, sf_dir).select(KEY, telling.alias("telling")),
    ]


def _model(spark: SparkSession, sf_dir: str, depths: tuple[int, ...] = (DEPTH,)):
    abt = pixels.base_table(_telling_bands(spark, sf_dir), frames.label_layer(spark, sf_dir))
    return pixels.train(abt, TELLING, depths=depths)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.score(_model(spark, sf_dir), layer_stack(_telling_bands(spark, sf_dir)))


@query(
    "pixel_base_table",
    f"SELECT tile_col, tile_row, column_index, row_index, band_1, band_2, CAST(label AS DOUBLE) AS target FROM ({GAPPY_CELLS})"
    " WHERE band_1 IS NOT NULL AND band_2 IS NOT NULL",
)
def _(spark, sf_dir):
    rows = pixels.pixel_table(_bands(spark, sf_dir), frames.label_layer(spark, sf_dir))
    return rows.select(
        F.col(f"{KEY}.col").alias("tile_col"), F.col(f"{KEY}.row").alias("tile_row"), "column_index", "row_index", *BANDS, "target"
    )


@query(
    "pixel_validation_metrics",
    "SELECT 'maxDepth = ' || d AS params, (SELECT CAST(count(*) = count(label) AS DOUBLE) FROM embeddings) AS metric"
    f" FROM (VALUES ({DEPTH}), ({DEPTH + 2})) v(d)",
)
def _(spark, sf_dir):
    """Every depth that can hold the labels validates without an error."""
    metrics = pixels.cv_metrics(frames.gappy_layer(spark, sf_dir), _model(spark, sf_dir, depths=(DEPTH, DEPTH + 2)))
    return metrics.withColumn("metric", F.round("metric", 9))


@query(
    "pixel_class_counts",
    f"SELECT CAST(label AS DOUBLE) AS class, count(*) AS count FROM ({GAPPY_CELLS}) WHERE band_1 IS NOT NULL GROUP BY label",
)
def _(spark, sf_dir):
    """Each cell with data in all bands gets its label, all others none."""
    return count_by(_scored(spark, sf_dir), "prediction", "class")


@query(
    "pixel_classified_mosaic",
    f"""
WITH s AS (SELECT tile_col * {SIDE} + column_index AS x, tile_row * {SIDE} + row_index AS y, CASE WHEN band_1 IS NOT NULL THEN label END AS v FROM ({GAPPY_CELLS})),
size AS (SELECT max(x) // {SIDE} * {SIDE} + {SIDE} AS w, max(y) // {SIDE} * {SIDE} + {SIDE} AS h FROM s)
SELECT c.i AS column_index, r.i AS row_index, CAST(v AS DOUBLE) AS value
FROM size, range(0, {_OUT[0]}) c(i), range(0, {_OUT[1]}) r(i), s
WHERE x = (2 * c.i + 1) * w // {2 * _OUT[0]} AND y = (2 * r.i + 1) * h // {2 * _OUT[1]} AND v IS NOT NULL
""",
)
def _(spark, sf_dir):
    """The predictions as a mosaic: labels where the nearest cell has data, nothing elsewhere."""
    tiled = pixels.retile(_scored(spark, sf_dir), SIDE, SIDE)
    return layers.to_raster(tiled, "prediction", *_OUT)
