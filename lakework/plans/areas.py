"""Queries over areas of many rows: points in them, and labels painted from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakework.functions import geometry
from lakework.operators.areas import points_in_areas, rasterise_areas
from lakework.operators.cells import explode_tiles
from lakework.operators.layers import spatial_join
from lakework.plans import frames
from lakework.plans.frames import CELLS, POINTS, SIDE
from lakework.plans.registry import query, table

# The parcel of a supplier: an outer ring with a notch, and a hole in every second one.
_OUTER = [(0, 0), (4, 0), (4, 4), (2, 2.5), (0, 4), (0, 0)]
_HOLE = [(1, 0.5), (1.5, 0.5), (1.5, 1.5), (1, 1.5), (1, 0.5)]


def parcels(spark: SparkSession, sf_dir: str, x: str, y: str, scale: str) -> DataFrame:
    """One polygon for every supplier, its lower left corner at (x, y)."""
    ring = lambda points: F.array(*[
        geometry.st_point(F.expr(f"{x} + {a}D * ({scale})"), F.expr(f"{y} + {b}D * ({scale})")) for a, b in points
    ])
    rings = F.when(F.expr("s_suppkey % 2 = 0"), F.array(ring(_OUTER), ring(_HOLE))).otherwise(F.array(ring(_OUTER)))
    return table(spark, sf_dir, "supplier").select("s_suppkey", rings.alias("area"))


def _edges(x: str, y: str, scale: str) -> str:
    """The parcels' edges in SQL, with the box of each parcel."""
    rows = ", ".join(
        f"({hole}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)"
        for hole, points in ((0, _OUTER), (1, _HOLE)) for (a, b), (c, d) in zip(points, points[1:])
    )
    return f"""
SELECT s_suppkey, {x} AS x0, {y} AS y0, {x} + 4 * ({scale}) AS x1, {y} + 4 * ({scale}) AS y1,
       {x} + a * ({scale}) AS px, {y} + b * ({scale}) AS py, {x} + c * ({scale}) AS qx, {y} + d * ({scale}) AS qy
FROM supplier, (VALUES {rows}) o(hole, a, b, c, d) WHERE hole = 0 OR s_suppkey % 2 = 0
"""


_LON, _LAT = "(CAST(s_suppkey * 7919 % 3500 AS DOUBLE) / 10 - 180)", "(CAST(s_suppkey * 104729 % 1500 AS DOUBLE) / 10 - 85)"
_DEGREES = "CAST(1 + s_suppkey % 9 AS DOUBLE) / 2"


@query(
    "points_in_areas",
    f"""
WITH pairs AS (
  SELECT c_custkey, s_suppkey, (qx - px) * (y - py) - (qy - py) * (x - px) AS side, (py > y) <> (qy > y) AS spans, qy > py AS upward,
         x BETWEEN least(px, qx) AND greatest(px, qx) AND y BETWEEN least(py, qy) AND greatest(py, qy) AS along
  FROM ({POINTS}) JOIN ({_edges(_LON, _LAT, _DEGREES)}) ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1
)
SELECT c_custkey, s_suppkey FROM pairs GROUP BY ALL
HAVING count_if(side = 0 AND along) = 0 AND count_if(spans AND (upward AND side > 0 OR NOT upward AND side < 0)) % 2 = 1
""",
)
def _(spark, sf_dir):
    """Which customers lie in which parcels."""
    points = frames.customer_points(spark, sf_dir).select("c_custkey", geometry.st_point("x", "y").alias("geom"))
    found = points_in_areas(points, parcels(spark, sf_dir, _LON, _LAT, _DEGREES))
    return found.select("c_custkey", "s_suppkey")


# On the plain grid: corners at eighths of a cell, north up.
_GX, _GY = "CAST(s_suppkey * 37 % 190 AS DOUBLE)", "(-20 - CAST(s_suppkey * 53 % 600 AS DOUBLE) / 4)"
_CELLS_WIDE = "CAST(1 + s_suppkey % 5 AS DOUBLE) * 1.125"
_LABELS = f"""
WITH e AS ({_edges(_GX, _GY, _CELLS_WIDE)}), corners AS (SELECT DISTINCT s_suppkey, x0, y0, x1, y1 FROM e),
near AS (
  SELECT s_suppkey, CAST(gc AS INTEGER) AS gc, CAST(gr AS INTEGER) AS gr FROM corners,
         unnest(range(CAST(floor(x0) AS BIGINT), CAST(ceil(x1) AS BIGINT))) c(gc), unnest(range(CAST(floor(-y1) AS BIGINT), CAST(ceil(-y0) AS BIGINT))) r(gr)
), inside AS (
  SELECT gc, gr, s_suppkey FROM near JOIN e USING (s_suppkey)
  WHERE least(-py, -qy) <= gr + 0.5::DOUBLE AND greatest(-py, -qy) > gr + 0.5::DOUBLE
    AND px + (gr + 0.5::DOUBLE - -py) * (qx - px) / (-qy - -py) > gc + 0.5::DOUBLE
  GROUP BY ALL HAVING count(*) % 2 = 1
)
SELECT CAST(floor(gc / {SIDE}) AS INTEGER) AS tile_col, CAST(floor(gr / {SIDE}) AS INTEGER) AS tile_row,
       CAST(gc - floor(gc / {SIDE}) * {SIDE} AS INTEGER) AS column_index, CAST(gr - floor(gr / {SIDE}) * {SIDE} AS INTEGER) AS row_index,
       CAST(min(s_suppkey) % 10 AS DOUBLE) AS target
FROM inside GROUP BY gc, gr
"""


def _label_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = parcels(spark, sf_dir, _GX, _GY, _CELLS_WIDE).withColumn("label", F.expr("s_suppkey % 10"))
    return rasterise_areas(labelled, "label", SIDE, SIDE, order="s_suppkey")


@query("layer_from_polygons", _LABELS)
def _(spark, sf_dir):
    """Labelled parcels as a tile layer; where they overlap, the first supplier's label stays."""
    cells = explode_tiles(_label_tiles(spark, sf_dir)).where("target IS NOT NULL")
    return cells.select(F.col("spatial_key.col").alias("tile_col"), F.col("spatial_key.row").alias("tile_row"), "column_index", "row_index", "target")


@query(
    "pixel_bands_by_polygon_label",
    f"SELECT target, count(*) AS pixels, sum(band_1) AS band_1_sum FROM ({CELLS}) JOIN ({_LABELS}) USING (tile_col, tile_row, column_index, row_index) GROUP BY target",
)
def _(spark, sf_dir):
    """The base table of a classification: a band under the labels of the parcels."""
    both = spatial_join(frames.band_layer(spark, sf_dir, "band_1"), _label_tiles(spark, sf_dir))
    pixels = explode_tiles(both).where("target IS NOT NULL")
    return pixels.groupBy("target").agg(F.count("*").alias("pixels"), F.sum("band_1").alias("band_1_sum"))
