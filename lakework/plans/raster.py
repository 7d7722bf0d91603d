"""Raster queries over tiles made of the embeddings table."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakework.functions import geometry, tiles
from lakework.operators import cells as cell_ops
from lakework.operators import color, layers, pyramid, quantiles, resample
from lakework.operators.layers import KEY
from lakework.plans import frames
from lakework.plans.frames import ACROSS, CELLS, COARSE_ACROSS, GAPPY_CELLS, GEO_CELL, GEO_ORIGIN, OTHER_CELLS, SIDE
from lakework.plans.registry import query, table
from lakework.session import scratch_dir
from lakework.sources import layers as layer_store

_PLACE = "tile_col, tile_row, column_index, row_index"


def cells_of_layer(layer: DataFrame, *bands: str) -> DataFrame:
    """The cells of a layer in plain columns."""
    out = cell_ops.explode_tiles(layer.select(KEY, *bands), list(bands))
    return out.select(
        F.col(f"{KEY}.col").alias("tile_col"), F.col(f"{KEY}.row").alias("tile_row"), "column_index", "row_index", *bands
    )


def _every_other(rest: int) -> Column:
    """The cells of ``band_1`` at even or odd places; the others are NoData."""
    cells = F.transform("band_1.cells", lambda v, i: F.when(i % 2 == rest, v))
    return tiles.make_tile(cells, SIDE, SIDE)


def _two_scenes(layer: DataFrame) -> DataFrame:
    """A layer as the union of two scenes on its keys that complement each other."""
    rest = [c for c in layer.columns if c not in ("band_1", "band_2")]
    return layer.select(*rest, _every_other(0).alias("band_1")).unionByName(layer.select(*rest, _every_other(1).alias("band_1")))


def _local(name: str, expression: Callable[[], Column], sql: str) -> None:
    """Register a cell-wise function over the two gappy bands."""

    def run(spark, sf_dir):
        return cells_of_layer(frames.gappy_layer(spark, sf_dir).select(KEY, expression().alias("v")), "v")

    query(name, f"SELECT {_PLACE}, {sql} AS v FROM ({GAPPY_CELLS})")(run)


_local("tile_local_add", lambda: tiles.st_local_add("band_1", "band_2"), "band_1 + band_2")
_local("tile_local_subtract", lambda: tiles.st_local_subtract("band_1", "band_2"), "band_1 - band_2")
_local("tile_local_multiply", lambda: tiles.st_local_multiply("band_1", 2.5), "band_1 * 2.5::DOUBLE")
_local(
    "tile_local_divide",
    lambda: tiles.st_local_divide("band_1", tiles.st_local_subtract("band_2", 10000)),
    "CASE WHEN band_2 - 10000 <> 0 THEN band_1 / (band_2 - 10000) END",
)
_local("tile_local_less", lambda: tiles.st_local_less("band_1", 10700), "CAST(band_1 < 10700 AS DOUBLE)")
_local(
    "tile_log",
    lambda: tiles.map_cells(tiles.st_log(tiles.st_local_subtract("band_1", 10000)), lambda x: F.round(x, 6)),
    "CASE WHEN band_1 > 10000 THEN round(ln(band_1 - 10000), 6) END",
)
_local("tile_mask", lambda: tiles.st_mask("band_2", "band_1"), "CASE WHEN band_1 IS NOT NULL THEN band_2 END")
_local(
    "tile_convert_cells",
    lambda: tiles.convert_cells(tiles.st_local_divide("band_1", 7), "int", nodata=1200),
    "CASE WHEN band_1 / 7 <> 1200 THEN trunc(band_1 / 7) END",
)
_local(
    "tile_map_cells",
    lambda: tiles.map_cells("band_1", lambda x: F.when(x > 10700, x)),
    "CASE WHEN band_1 > 10700 THEN band_1 END",
)
_NDVI = "CASE WHEN band_1 + band_2 <> 0 THEN (band_1 - band_2) / (band_1 + band_2) END"
_local("tile_normalized_difference", lambda: tiles.normalized_difference("band_1", "band_2"), _NDVI)
_local("tile_function_numpy", lambda: tiles.tile_udf(lambda a, b: (a - b) / (a + b))("band_1", "band_2"), _NDVI)
_local(
    "tile_rgb_composite",
    lambda: tiles.st_rgb_composite(
        tiles.st_local_divide("band_1", 50), tiles.st_local_divide("band_2", 50), tiles.st_local_subtract("band_1", 9900)
    ),
    "CASE WHEN band_1 IS NOT NULL AND band_2 IS NOT NULL THEN floor(least(greatest(band_1 / 50, 0), 255)) * 65536 + floor(least(greatest(band_2 / 50, 0), 255)) * 256"
    " + floor(least(greatest(band_1 - 9900, 0), 255)) END",
)


@query("layer_spatial_join", f"SELECT {_PLACE}, band_1, band_2 FROM ({CELLS})")
def _(spark, sf_dir):
    left, right = frames.band_layer(spark, sf_dir, "band_1"), frames.band_layer(spark, sf_dir, "band_2")
    return cells_of_layer(layers.spatial_join(left, right), "band_1", "band_2")


@query(
    "ndvi_of_joined_bands",
    f"SELECT {_PLACE}, CASE WHEN band_1 + band_2 <> 0 THEN (band_1 - band_2) / (band_1 + band_2) END AS ndvi FROM ({CELLS})",
)
def ndvi_of_joined_bands(spark, sf_dir):
    left, right = frames.band_layer(spark, sf_dir, "band_1"), frames.band_layer(spark, sf_dir, "band_2")
    joined = layers.spatial_join(left, right)
    ndvi = joined.select(KEY, tiles.normalized_difference("band_1", "band_2").alias("ndvi"))
    return cells_of_layer(ndvi, "ndvi")


@query(
    "layer_project_and_add_column",
    "SELECT CAST(vec_id % 25 AS INTEGER) AS tile_col, CAST(vec_id // 25 AS INTEGER) AS tile_row,"
    f" CAST(2 * sum(band_1) AS DOUBLE) AS doubled FROM ({CELLS}) GROUP BY vec_id",
)
def _(spark, sf_dir):
    renamed = frames.layer(spark, sf_dir).select(KEY, F.col("band_1").alias("first"))
    added = layers.as_layer(renamed.withColumn("twice", tiles.st_local_add("first", "first")))
    return added.select(f"{KEY}.col", f"{KEY}.row", tiles.st_tile_sum("twice").alias("doubled")).toDF(
        "tile_col", "tile_row", "doubled"
    )


@query(
    "tile_sum",
    "SELECT tile_col, tile_row, coalesce(sum(band_1), 0) AS total, CAST(sum(CASE WHEN band_1 IS NULL THEN 1 ELSE 0 END) AS INTEGER) AS no_data,"
    f" CAST(count(band_1) AS INTEGER) AS data FROM ({GAPPY_CELLS}) GROUP BY tile_col, tile_row",
)
def _(spark, sf_dir):
    return frames.gappy_layer(spark, sf_dir).select(
        F.col(f"{KEY}.col").alias("tile_col"),
        F.col(f"{KEY}.row").alias("tile_row"),
        tiles.st_tile_sum("band_1").alias("total"),
        tiles.st_no_data_cells("band_1").alias("no_data"),
        tiles.st_data_cells("band_1").alias("data"),
    )


@query(
    "tile_sum_in_sql_text",
    "SELECT tile_col, tile_row, round(coalesce(sum((band_1 + band_2) / band_1), 0), 6) AS total,"
    " CAST(sum(CASE WHEN band_1 IS NOT NULL AND band_2 IS NULL THEN 1 ELSE 0 END) + sum(CASE WHEN band_1 IS NULL THEN 1 ELSE 0 END) AS INTEGER) AS no_data"
    f" FROM ({GAPPY_CELLS}) GROUP BY tile_col, tile_row",
)
def _(spark, sf_dir):
    geometry.register_sql_functions(spark)
    frames.gappy_layer(spark, sf_dir).createOrReplaceTempView("gappy_layer")
    return spark.sql(
        "SELECT spatial_key.col AS tile_col, spatial_key.row AS tile_row,"
        " round(st_tile_sum(st_local_divide(st_local_add(band_1, band_2), band_1)), 6) AS total,"
        " st_no_data_cells(st_mask(band_2, band_1)) AS no_data FROM gappy_layer"
    )


@query(
    "layer_statistics",
    "SELECT count(band_1) AS data_cells, count(*) - count(band_1) AS no_data_cells, min(band_1) AS min, max(band_1) AS max,"
    f" avg(band_1) AS mean, round(var_pop(band_1), 2) AS variance FROM ({GAPPY_CELLS})",
)
def _(spark, sf_dir):
    stats = cell_ops.st_agg_stats(frames.gappy_layer(spark, sf_dir), "band_1")
    return stats.withColumn("variance", F.round("variance", 2))


@query("layer_explode_tiles", f"SELECT {_PLACE}, band_1, band_2 FROM ({GAPPY_CELLS})")
def _(spark, sf_dir):
    return cells_of_layer(frames.gappy_layer(spark, sf_dir), "band_1", "band_2")


@query("layer_assemble_tiles", f"SELECT {_PLACE}, band_1, band_2 FROM ({GAPPY_CELLS})")
def _(spark, sf_dir):
    exploded = cell_ops.explode_tiles(frames.gappy_layer(spark, sf_dir))
    known = exploded.where("band_1 IS NOT NULL OR band_2 IS NOT NULL")
    built = cell_ops.st_assemble_tile(
        known, [KEY], "column_index", "row_index", ["band_1", "band_2"], SIDE, SIDE
    )
    return cells_of_layer(built, "band_1", "band_2")


@query(
    "layer_no_data_filter",
    f"SELECT {_PLACE}, band_1, band_2 FROM ({GAPPY_CELLS}) WHERE band_1 IS NOT NULL AND band_2 IS NOT NULL",
)
def _(spark, sf_dir):
    return cell_ops.no_data_filter(
        cells_of_layer(frames.gappy_layer(spark, sf_dir), "band_1", "band_2"), ["band_1", "band_2"]
    )


@query(
    "layer_local_minimum",
    "SELECT label, column_index, row_index, min(band_1) AS least FROM"
    f" (SELECT CAST(label AS INTEGER) AS label, column_index, row_index, band_1 FROM ({GAPPY_CELLS}))"
    " GROUP BY label, column_index, row_index",
)
def _(spark, sf_dir):
    labels = frames.label_layer(spark, sf_dir).select(KEY, F.get("target.cells", F.lit(0)).cast("int").alias("label"))
    named = frames.gappy_layer(spark, sf_dir).join(labels, on=KEY)
    least = cell_ops.st_agg_local_min(named, "band_1", ["label"], SIDE, SIDE)
    return cell_ops.explode_tiles(least, ["band_1"]).withColumnRenamed("band_1", "least")


_RETILE = (12, 10)


@query(
    "layer_retile",
    f"""
WITH source AS (SELECT tile_col * {SIDE} + column_index AS x, tile_row * {SIDE} + row_index AS y, band_1 FROM ({GAPPY_CELLS})),
size AS (SELECT max(x) // {_RETILE[0]} AS last_col, max(y) // {_RETILE[1]} AS last_row FROM source),
grid AS (SELECT c.i AS tile_col, r.i AS tile_row, p.i AS column_index, q.i AS row_index
         FROM size, range(0, last_col + 1) c(i), range(0, last_row + 1) r(i), range(0, {_RETILE[0]}) p(i), range(0, {_RETILE[1]}) q(i))
SELECT CAST(tile_col AS INTEGER) AS tile_col, CAST(tile_row AS INTEGER) AS tile_row, CAST(column_index AS INTEGER) AS column_index,
       CAST(row_index AS INTEGER) AS row_index, band_1
FROM grid LEFT JOIN source ON x = tile_col * {_RETILE[0]} + column_index AND y = tile_row * {_RETILE[1]} + row_index
""",
)
def _(spark, sf_dir):
    pieces = frames.gappy_layer(spark, sf_dir).select(
        (F.col(f"{KEY}.col") * SIDE).alias("col_off"), (F.col(f"{KEY}.row") * SIDE).alias("row_off"),
        F.col("band_1").alias("tile"),
    )
    return cells_of_layer(layers.to_layer(pieces, *_RETILE, "band_1"), "band_1")


@query(
    "layer_from_overlapping_pieces",
    f"SELECT {_PLACE}, band_1 FROM ({GAPPY_CELLS})",
)
def _(spark, sf_dir):
    """Every piece comes twice on the same place: once with its even cells only, once with the odd ones."""
    pieces = frames.gappy_layer(spark, sf_dir).select(
        (F.col(f"{KEY}.col") * SIDE).alias("col_off"), (F.col(f"{KEY}.row") * SIDE).alias("row_off"), "band_1",
    )
    parts = [pieces.select("col_off", "row_off", _every_other(b).alias("tile")) for b in (0, 1)]
    return cells_of_layer(layers.to_layer(parts[0].unionByName(parts[1]), SIDE, SIDE, "band_1"), "band_1")


@query(
    "layer_crs_and_extent",
    f"SELECT DISTINCT tile_col, tile_row, 'EPSG:4326' AS crs, {GEO_ORIGIN[0]}::DOUBLE + tile_col * 2.0::DOUBLE AS xmin,"
    f" {GEO_ORIGIN[1]}::DOUBLE - (tile_row + 1) * 2.0::DOUBLE AS ymin, {GEO_ORIGIN[0]}::DOUBLE + (tile_col + 1) * 2.0::DOUBLE AS xmax,"
    f" {GEO_ORIGIN[1]}::DOUBLE - tile_row * 2.0::DOUBLE AS ymax FROM ({CELLS})",
)
def _(spark, sf_dir):
    return frames.geo_layer(spark, sf_dir).select(
        F.col(f"{KEY}.col").alias("tile_col"), F.col(f"{KEY}.row").alias("tile_row"), "crs", "extent.*"
    )


@query(
    "layer_metadata",
    "SELECT min(tile_col) AS min_col, max(tile_col) AS max_col, min(tile_row) AS min_row, max(tile_row) AS max_row,"
    f" {SIDE}::INTEGER AS tile_cols, {SIDE}::INTEGER AS tile_rows, count(DISTINCT vec_id) AS tiles, 'EPSG:4326' AS crs,"
    f" min({GEO_ORIGIN[0]}::DOUBLE + tile_col * 2.0::DOUBLE) AS xmin, min({GEO_ORIGIN[1]}::DOUBLE - (tile_row + 1) * 2.0::DOUBLE) AS ymin,"
    f" max({GEO_ORIGIN[0]}::DOUBLE + (tile_col + 1) * 2.0::DOUBLE) AS xmax, max({GEO_ORIGIN[1]}::DOUBLE - tile_row * 2.0::DOUBLE) AS ymax"
    f" FROM ({CELLS})",
)
def _(spark, sf_dir):
    return layers.layer_metadata(frames.geo_layer(spark, sf_dir))


@query(
    "projected_raster_parts",
    "SELECT vec_id, sum(band_1) AS total, 'EPSG:4326' AS crs,"
    f" {GEO_ORIGIN[0]}::DOUBLE + any_value(tile_col) * 2.0::DOUBLE AS xmin, {GEO_ORIGIN[1]}::DOUBLE - any_value(tile_row) * 2.0::DOUBLE AS ymax,"
    f" CAST(5 AS INTEGER) AS corners FROM ({CELLS}) GROUP BY vec_id",
)
def _(spark, sf_dir):
    raster = layers.with_crs(
        layers.with_extent(frames.layer(spark, sf_dir), SIDE, SIDE, GEO_ORIGIN, GEO_CELL), "EPSG:4326"
    ).select(
        (F.col(f"{KEY}.row") * ACROSS + F.col(f"{KEY}.col")).cast("long").alias("vec_id"),
        tiles.proj_raster("band_1", "crs", "extent").alias("raster"),
    )
    ring = geometry.st_geometry(tiles.st_raster_extent("raster"))
    return raster.select(
        "vec_id", tiles.st_tile_sum(tiles.st_tile("raster")).alias("total"), tiles.st_raster_crs("raster").alias("crs"),
        geometry.st_extent(ring)["xmin"].alias("xmin"), geometry.st_extent(ring)["ymax"].alias("ymax"),
        F.size(ring).alias("corners"),
    )


@query("layer_stack_bands", f"SELECT {_PLACE}, band_1 AS v0, band_2 AS v1 FROM ({CELLS})")
def _(spark, sf_dir):
    from lakework.operators.relational import layer_stack

    stacked = layer_stack([frames.band_layer(spark, sf_dir, b) for b in ("band_1", "band_2")])
    multi = stacked.select(KEY, tiles.multiband("band_1", "band_2").alias("bands"))
    named = multi.select(KEY, tiles.band("bands", 0).alias("v0"), tiles.band("bands", 1).alias("v1"))
    return cells_of_layer(named, "v0", "v1")


_OUT = (310, 275)


def _global(source: str) -> str:
    return f"SELECT tile_col * {SIDE} + column_index AS x, tile_row * {SIDE} + row_index AS y, band_1 AS v FROM ({source})"


@query(
    "raster_mosaic_nearest",
    f"""
WITH source AS ({_global(GAPPY_CELLS)}), size AS (SELECT max(x) + 1 AS w, max(y) + 1 AS h FROM source)
SELECT c.i AS column_index, r.i AS row_index, v AS value FROM size, range(0, {_OUT[0]}) c(i), range(0, {_OUT[1]}) r(i), source
WHERE source.x = (2 * c.i + 1) * w // {2 * _OUT[0]} AND source.y = (2 * r.i + 1) * h // {2 * _OUT[1]} AND v IS NOT NULL
""",
)
def _(spark, sf_dir):
    return layers.to_raster(frames.gappy_layer(spark, sf_dir), "band_1", *_OUT, unique=True)


@query(
    "raster_mosaic_bilinear",
    f"""
WITH source AS ({_global(GAPPY_CELLS)}), size AS (SELECT max(x) + 1 AS w, max(y) + 1 AS h FROM source),
px AS (SELECT i, CAST(floor(f) AS BIGINT) + d AS x, CASE d WHEN 0 THEN 1 - (f - floor(f)) ELSE f - floor(f) END AS w
       FROM (SELECT i, (2 * i + 1) * CAST(w AS DOUBLE) / {2.0 * 150} - 0.5 AS f FROM size, range(0, 150) t(i)), range(0, 2) s(d)),
py AS (SELECT i, CAST(floor(f) AS BIGINT) + d AS y, CASE d WHEN 0 THEN 1 - (f - floor(f)) ELSE f - floor(f) END AS w
       FROM (SELECT i, (2 * i + 1) * CAST(h AS DOUBLE) / {2.0 * 135} - 0.5 AS f FROM size, range(0, 135) t(i)), range(0, 2) s(d))
SELECT px.i AS column_index, py.i AS row_index, round(sum(px.w * py.w * v) / sum(px.w * py.w), 6) AS value
FROM source JOIN px ON px.x = source.x JOIN py ON py.y = source.y
WHERE v IS NOT NULL AND px.w > 0 AND py.w > 0 GROUP BY px.i, py.i
""",
)
def _(spark, sf_dir):
    return layers.to_raster(frames.gappy_layer(spark, sf_dir), "band_1", 150, 135, "bilinear", unique=True).withColumn(
        "value", F.round("value", 6)
    )


@query("raster_min_max", f"SELECT min(band_1) AS min, max(band_1) AS max FROM ({GAPPY_CELLS})")
def _(spark, sf_dir):
    return quantiles.min_max(cells_of_layer(frames.gappy_layer(spark, sf_dir), "band_1"), "band_1")


@query(
    "raster_histogram",
    f"""
WITH b AS (SELECT min(band_1) AS lo, max(band_1) AS hi FROM ({GAPPY_CELLS}))
SELECT CAST(least(greatest(floor((band_1 - lo) / ((hi - lo) / 32)), 0), 31) AS INTEGER) AS bin, count(*) AS n
FROM ({GAPPY_CELLS}), b WHERE band_1 IS NOT NULL GROUP BY ALL
""",
)
def _(spark, sf_dir):
    return quantiles.cell_histogram(cells_of_layer(frames.gappy_layer(spark, sf_dir), "band_1"), "band_1", 32)


_QUANTILES = ", ".join(str(i / 8) for i in range(1, 8))


@query(
    "raster_quantile_classes",
    f"""
WITH b AS (SELECT quantile_cont(band_1, [{_QUANTILES}]) AS q FROM ({GAPPY_CELLS}))
SELECT {_PLACE}, band_1, CAST(CASE WHEN band_1 IS NOT NULL THEN len(list_filter(q, lambda e: e < band_1)) END AS INTEGER) AS class
FROM ({GAPPY_CELLS}), b
""",
)
def _(spark, sf_dir):
    return quantiles.quantile_classify(cells_of_layer(frames.gappy_layer(spark, sf_dir), "band_1"), "band_1", 8)


_DUSK = [(20, 12, 60), (120, 40, 110), (230, 110, 70), (250, 220, 150)]
_STOPS = color.color_ramp(_DUSK, 16)


@query(
    "raster_color_map",
    f"""
WITH b AS (SELECT quantile_cont(band_1, [{", ".join(str(i / 16) for i in range(1, 16))}]) AS q FROM ({GAPPY_CELLS})),
c AS (SELECT tile_col, tile_row, column_index, row_index, band_1,
             CASE WHEN band_1 IS NOT NULL THEN len(list_filter(q, lambda e: e < band_1)) END AS k FROM ({GAPPY_CELLS}), b)
SELECT {_PLACE}, band_1, CAST({[c[0] for c in _STOPS]}[k + 1] AS INTEGER) AS red,
       CAST({[c[1] for c in _STOPS]}[k + 1] AS INTEGER) AS green, CAST({[c[2] for c in _STOPS]}[k + 1] AS INTEGER) AS blue FROM c
""",
)
def _(spark, sf_dir):
    cells = cells_of_layer(frames.gappy_layer(spark, sf_dir), "band_1")
    breaks = quantiles.quantile_breaks(cells, "band_1", 16)
    return color.apply_color_map(cells, "band_1", breaks, _STOPS)


@query(
    "raster_zonal_statistics",
    "SELECT CAST(label AS DOUBLE) AS zone, count(band_1) AS data_cells, count(*) - count(band_1) AS no_data_cells,"
    " min(band_1) AS min, max(band_1) AS max, avg(band_1) AS mean, round(var_pop(band_1), 2) AS variance"
    f" FROM ({GAPPY_CELLS}) GROUP BY label",
)
def _(spark, sf_dir):
    joined = layers.spatial_join(frames.gappy_layer(spark, sf_dir), frames.label_layer(spark, sf_dir))
    stats = cell_ops.zonal_stats(joined, "band_1", "target")
    return stats.withColumn("variance", F.round("variance", 2))


@query(
    "raster_focal_mean",
    f"""
WITH source AS ({_global(GAPPY_CELLS)}),
spread AS (SELECT x + dx.i AS x, y + dy.i AS y, v FROM source, range(-1, 2) dx(i), range(-1, 2) dy(i) WHERE v IS NOT NULL),
means AS (SELECT x, y, sum(v) / count(*) AS m FROM spread GROUP BY x, y)
SELECT CAST(x // {SIDE} AS INTEGER) AS tile_col, CAST(y // {SIDE} AS INTEGER) AS tile_row, CAST(x % {SIDE} AS INTEGER) AS column_index,
       CAST(y % {SIDE} AS INTEGER) AS row_index, round(m, 6) AS band_1
FROM source LEFT JOIN means USING (x, y)
""",
)
def _(spark, sf_dir):
    mean = cell_ops.focal_mean(frames.gappy_layer(spark, sf_dir), "band_1", 1, SIDE, SIDE, unique=True)
    return cells_of_layer(mean, "band_1").withColumn("band_1", F.round("band_1", 6))


@query(
    "raster_focal_extremes",
    f"""
WITH source AS ({_global(GAPPY_CELLS)}),
spread AS (SELECT x + dx.i AS x, y + dy.i AS y, v FROM source, range(-2, 3) dx(i), range(-2, 3) dy(i) WHERE v IS NOT NULL),
windows AS (SELECT x, y, min(v) AS least, max(v) AS most, median(v) AS middle FROM spread GROUP BY x, y)
SELECT CAST(x // {SIDE} AS INTEGER) AS tile_col, CAST(y // {SIDE} AS INTEGER) AS tile_row, CAST(x % {SIDE} AS INTEGER) AS column_index,
       CAST(y % {SIDE} AS INTEGER) AS row_index, least, most, middle
FROM source LEFT JOIN windows USING (x, y)
""",
)
def _(spark, sf_dir):
    """Smallest, largest and middle value of the 5 x 5 window around each cell."""
    source = frames.gappy_layer(spark, sf_dir).select(KEY, "band_1")
    layers = [
        fn(source, "band_1", 2, SIDE, SIDE, unique=True).withColumnRenamed("band_1", name)
        for fn, name in ((cell_ops.focal_min, "least"), (cell_ops.focal_max, "most"), (cell_ops.focal_median, "middle"))
    ]
    cells = cell_ops.explode_tiles(layers[0].join(layers[1], KEY).join(layers[2], KEY), ["least", "most", "middle"])
    return cells.select(
        F.col(f"{KEY}.col").alias("tile_col"), F.col(f"{KEY}.row").alias("tile_row"), "column_index", "row_index", "least", "most", "middle"
    )


@query("tile_explode_in_sql_text", f"SELECT {_PLACE}, band_1 FROM ({GAPPY_CELLS})")
def _(spark, sf_dir):
    geometry.register_sql_functions(spark)
    frames.gappy_layer(spark, sf_dir).createOrReplaceTempView("gappy_tiles")
    return spark.sql(
        "SELECT spatial_key.col AS tile_col, spatial_key.row AS tile_row, e.column_index, e.row_index, e.value AS band_1"
        " FROM gappy_tiles, LATERAL st_explode_tile(band_1) e"
    )


@query(
    "tile_aggregates_in_sql_text",
    f"SELECT tile_row, column_index, row_index, min(band_1) AS least, max(band_1) AS most, count(band_1) AS data_cells, count(*) - count(band_1) AS no_data_cells,"
    f" sum(band_1) AS total FROM ({GAPPY_CELLS}) GROUP BY tile_row, column_index, row_index",
)
def _(spark, sf_dir):
    """Cell-wise aggregates over the tiles of a group, in SQL: map-side sums of Spark's own, whatever the group's size."""
    geometry.register_sql_functions(spark)
    frames.gappy_layer(spark, sf_dir).createOrReplaceTempView("gappy_tiles")
    return spark.sql(
        "SELECT spatial_key.row AS tile_row, e.column_index, e.row_index, min(e.value) AS least, max(e.value) AS most, count(e.value) AS data_cells,"
        " count(*) - count(e.value) AS no_data_cells, sum(e.value) AS total"
        " FROM gappy_tiles, LATERAL st_explode_tile(band_1) e GROUP BY spatial_key.row, e.column_index, e.row_index"
    )


_SHIFTED = (40.0, -12.0)


@query(
    "raster_join_same_crs",
    f"""
WITH l AS (SELECT tile_col, tile_row, column_index, row_index, band_1, tile_col * {SIDE} + column_index + 0.5::DOUBLE AS x,
                  -(tile_row * {SIDE} + row_index + 0.5::DOUBLE) AS y FROM ({GAPPY_CELLS})),
r AS ({OTHER_CELLS}),
m AS (SELECT {_PLACE}, band_1, other FROM l LEFT JOIN r
      ON gc = CAST(floor((x - {_SHIFTED[0]}) / 1.25) AS BIGINT) AND gr = CAST(ceil(({_SHIFTED[1]} - y) / 1.25) - 1 AS BIGINT))
SELECT {_PLACE}, band_1, other FROM m
""",
)
def _(spark, sf_dir):
    other = frames.other_grid(spark, sf_dir, _SHIFTED, 1.25)
    joined = resample.raster_join(frames.plain_layer(spark, sf_dir), other, unique=True)
    return cells_of_layer(joined, "band_1", "other")


@query(
    "raster_join_of_two_scenes",
    f"""
WITH l AS (SELECT scene, tile_col, tile_row, column_index, row_index, tile_col * {SIDE} + column_index + 0.5::DOUBLE + scene * 24 AS x,
                  -(tile_row * {SIDE} + row_index + 0.5::DOUBLE) AS y FROM ({GAPPY_CELLS}), (VALUES (0), (1)) s(scene)),
r AS ({OTHER_CELLS})
SELECT CAST(scene AS INTEGER) AS scene, {_PLACE}, other FROM l LEFT JOIN r
ON gc = CAST(floor((x - {_SHIFTED[0]}) / 1.25) AS BIGINT) AND gr = CAST(ceil(({_SHIFTED[1]} - y) / 1.25) - 1 AS BIGINT)
""",
)
def _(spark, sf_dir):
    """Two scenes with the same keys, the second three tiles to the east."""
    first = frames.plain_layer(spark, sf_dir).withColumn("scene", F.lit(0))
    moved = F.struct(
        (F.col("extent.xmin") + 24).alias("xmin"), F.col("extent.ymin").alias("ymin"),
        (F.col("extent.xmax") + 24).alias("xmax"), F.col("extent.ymax").alias("ymax"),
    )
    scenes = first.unionByName(first.withColumns({"extent": moved, "scene": F.lit(1)}))
    joined = resample.raster_join(scenes.drop("band_2"), frames.other_grid(spark, sf_dir, _SHIFTED, 1.25))
    out = cell_ops.explode_tiles(joined, ["band_1", "other"], keep=[KEY, "scene"])
    return out.select(
        "scene", F.col(f"{KEY}.col").alias("tile_col"), F.col(f"{KEY}.row").alias("tile_row"), "column_index", "row_index", "other"
    )


@query(
    "raster_join_bilinear",
    f"""
WITH l AS (SELECT tile_col, tile_row, column_index, row_index, (tile_col * {SIDE} + column_index + 0.5::DOUBLE - {_SHIFTED[0]}) / 1.25 - 0.5 AS fx,
                  ({_SHIFTED[1]} + (tile_row * {SIDE} + row_index + 0.5::DOUBLE)) / 1.25 - 0.5 AS fy FROM ({GAPPY_CELLS})),
r AS ({OTHER_CELLS}),
near AS (SELECT {_PLACE}, CAST(floor(fx) AS BIGINT) + a.d AS gc, CAST(floor(fy) AS BIGINT) + b.d AS gr,
                (CASE a.d WHEN 0 THEN 1 - (fx - floor(fx)) ELSE fx - floor(fx) END) * (CASE b.d WHEN 0 THEN 1 - (fy - floor(fy)) ELSE fy - floor(fy) END) AS w
         FROM l, range(0, 2) a(d), range(0, 2) b(d))
SELECT {_PLACE}, round(sum(w * other) / sum(w), 6) AS other FROM near JOIN r USING (gc, gr) WHERE w > 0 GROUP BY {_PLACE}
""",
)
def _(spark, sf_dir):
    other = frames.other_grid(spark, sf_dir, _SHIFTED, 1.25)
    joined = resample.raster_join(frames.plain_layer(spark, sf_dir), other, how="inner", resample="bilinear", unique=True)
    return cells_of_layer(joined, "other").where("other IS NOT NULL").withColumn("other", F.round("other", 6))


_MERCATOR_ORIGIN, _MERCATOR_CELL = (-2812345.0, 15412345.0), 41234.0
_R = geometry.EARTH_RADIUS


@query(
    "raster_join_across_crs",
    f"""
WITH l AS (SELECT tile_col, tile_row, column_index, row_index, band_1,
                  radians({GEO_ORIGIN[0]} + (tile_col * {SIDE} + column_index + 0.5::DOUBLE) * {GEO_CELL}) * {_R} AS x,
                  ln(tan({math.pi / 4} + radians({GEO_ORIGIN[1]} - (tile_row * {SIDE} + row_index + 0.5::DOUBLE) * {GEO_CELL}) / 2)) * {_R} AS y
           FROM ({GAPPY_CELLS})),
r AS ({OTHER_CELLS})
SELECT {_PLACE}, band_1, other FROM l LEFT JOIN r
ON gc = CAST(floor((x - ({_MERCATOR_ORIGIN[0]})) / {_MERCATOR_CELL}) AS BIGINT)
AND gr = CAST(ceil(({_MERCATOR_ORIGIN[1]} - y) / {_MERCATOR_CELL}) - 1 AS BIGINT)
""",
)
def _(spark, sf_dir):
    other = frames.other_grid(spark, sf_dir, _MERCATOR_ORIGIN, _MERCATOR_CELL)
    joined = resample.raster_join(frames.geo_layer(spark, sf_dir), other, unique=True)
    return cells_of_layer(joined, "band_1", "other")


_WEB_TILE = 64
_WEB_ZOOM = 5
_WEB_CELL = resample.mercator_cell(_WEB_ZOOM, _WEB_TILE)
_LIMIT = geometry.MERCATOR_LIMIT


@query(
    "layer_zoomed_layout",
    f"""
WITH s AS (SELECT tile_col * {SIDE} + column_index AS sc, tile_row * {SIDE} + row_index AS sr, band_1 FROM ({GAPPY_CELLS})),
g AS (SELECT c.i AS gc, r.i AS gr, degrees(((c.i + 0.5::DOUBLE) * {_WEB_CELL} - {_LIMIT}) / {_R}) AS lon,
             degrees(2 * atan(exp(({_LIMIT} - (r.i + 0.5::DOUBLE) * {_WEB_CELL}) / {_R})) - {math.pi / 2}) AS lat
      FROM range(0, {_WEB_TILE * 2**_WEB_ZOOM}) c(i), range(0, {_WEB_TILE * 2**_WEB_ZOOM}) r(i))
SELECT CAST({_WEB_ZOOM} AS INTEGER) AS zoom, CAST(gc // {_WEB_TILE} AS INTEGER) AS tile_col, CAST(gr // {_WEB_TILE} AS INTEGER) AS tile_row,
       CAST(gc % {_WEB_TILE} AS INTEGER) AS column_index, CAST(gr % {_WEB_TILE} AS INTEGER) AS row_index, band_1
FROM g JOIN s ON sc = CAST(floor((lon - ({GEO_ORIGIN[0]})) / {GEO_CELL}) AS BIGINT)
AND sr = CAST(ceil(({GEO_ORIGIN[1]} - lat) / {GEO_CELL}) - 1 AS BIGINT)
WHERE band_1 IS NOT NULL
""",
)
def _(spark, sf_dir):
    source = frames.geo_layer(spark, sf_dir).drop("band_2")
    web = resample.to_zoomed_layout(source, _WEB_TILE)
    out = cell_ops.explode_tiles(web, ["band_1"], keep=["zoom", KEY]).where("band_1 IS NOT NULL")
    return out.select(
        "zoom", F.col(f"{KEY}.col").alias("tile_col"), F.col(f"{KEY}.row").alias("tile_row"),
        "column_index", "row_index", "band_1",
    )


_WORLD_ZOOM = 2
_WORLD_CELL = resample.mercator_cell(_WORLD_ZOOM, _WEB_TILE)
_WORLD_SPAN = ACROSS * SIDE  # columns of cells around the globe


@query(
    "layer_zoomed_layout_world",
    f"""
WITH size AS (SELECT (max(tile_row) + 1) * {SIDE} AS h FROM ({CELLS})),
s AS (SELECT tile_col * {SIDE} + column_index AS sc, tile_row * {SIDE} + row_index AS sr, band_1 FROM ({CELLS})),
g AS (SELECT c.i AS gc, r.i AS gr, degrees(((c.i + 0.5::DOUBLE) * {_WORLD_CELL} - {_LIMIT}) / {_R}) AS lon,
             degrees(2 * atan(exp(({_LIMIT} - (r.i + 0.5::DOUBLE) * {_WORLD_CELL}) / {_R})) - {math.pi / 2}) AS lat
      FROM range(0, {_WEB_TILE * 2**_WORLD_ZOOM}) c(i), range(0, {_WEB_TILE * 2**_WORLD_ZOOM}) r(i))
SELECT CAST(gc // {_WEB_TILE} AS INTEGER) AS tile_col, CAST(gr // {_WEB_TILE} AS INTEGER) AS tile_row,
       CAST(gc % {_WEB_TILE} AS INTEGER) AS column_index, CAST(gr % {_WEB_TILE} AS INTEGER) AS row_index, band_1
FROM g, size JOIN s ON sc = CAST(floor((lon + 180) / (360.0::DOUBLE / {_WORLD_SPAN})) AS BIGINT)
AND sr = CAST(ceil((90 - lat) / (180.0::DOUBLE / h)) - 1 AS BIGINT)
""",
)
def _(spark, sf_dir):
    """The layer stretched over the globe, from pole to pole."""
    plain = frames.layer(spark, sf_dir).select(KEY, "band_1")
    rows = plain.agg(F.max(f"{KEY}.row").alias("last")).first().last + 1
    wide, high = 360.0 / ACROSS, 180.0 / rows
    col, row = F.col(f"{KEY}.col"), F.col(f"{KEY}.row")
    box = F.struct(
        (col * wide - 180).alias("xmin"), (90 - (row + 1) * high).alias("ymin"), ((col + 1) * wide - 180).alias("xmax"), (90 - row * high).alias("ymax")
    )
    web = resample.to_zoomed_layout(layers.with_crs(plain.withColumn("extent", box), "EPSG:4326"), _WEB_TILE, zoom=_WORLD_ZOOM)
    return cells_of_layer(web, "band_1").where("band_1 IS NOT NULL")


def _pyramid_sql() -> str:
    """Levels 3 to 0, each the mean of the 2 x 2 data cells of the one before."""
    levels = [f"z3 AS (SELECT x, y, v FROM ({_global(GAPPY_CELLS)}) WHERE v IS NOT NULL)"]
    for z in (2, 1, 0):
        levels.append(f"z{z} AS (SELECT x // 2 AS x, y // 2 AS y, sum(v) / count(*) AS v FROM z{z + 1} GROUP BY ALL)")
    parts = [f"SELECT CAST({z} AS INTEGER) AS zoom, x, y, v FROM z{z}" for z in (3, 2, 1, 0)]
    return (
        f"WITH {', '.join(levels)} SELECT zoom, CAST(x // {SIDE} AS INTEGER) AS tile_col, CAST(y // {SIDE} AS INTEGER) AS tile_row,"
        f" CAST(x % {SIDE} AS INTEGER) AS column_index, CAST(y % {SIDE} AS INTEGER) AS row_index, round(v, 6) AS band_1"
        f" FROM ({' UNION ALL '.join(parts)})"
    )


@query("raster_pyramid_of_two_scenes", _pyramid_sql().replace("SELECT CAST(3 AS INTEGER) AS zoom, x, y, v FROM z3 UNION ALL ", ""))
def _(spark, sf_dir):
    scenes = _two_scenes(frames.gappy_layer(spark, sf_dir).select(KEY, "band_1"))
    levels = pyramid.build_pyramid(scenes, max_zoom=3).where("zoom < 3")
    out = cell_ops.explode_tiles(levels, ["band_1"]).where("band_1 IS NOT NULL")
    return out.select(
        "zoom", F.col(f"{KEY}.col").alias("tile_col"), F.col(f"{KEY}.row").alias("tile_row"),
        "column_index", "row_index", F.round("band_1", 6).alias("band_1"),
    )


@query("raster_pyramid", _pyramid_sql())
def _(spark, sf_dir):
    levels = pyramid.build_pyramid(frames.gappy_layer(spark, sf_dir).select(KEY, "band_1"), max_zoom=3, unique=True)
    out = cell_ops.explode_tiles(levels, ["band_1"]).where("band_1 IS NOT NULL")
    return out.select(
        "zoom", F.col(f"{KEY}.col").alias("tile_col"), F.col(f"{KEY}.row").alias("tile_row"),
        "column_index", "row_index", F.round("band_1", 6).alias("band_1"),
    )


_Z = " + ".join(
    f"((tile_col >> {i}) & 1) * {4**i}::BIGINT + ((tile_row >> {i}) & 1) * {2 * 4**i}::BIGINT" for i in range(16)
)


@query(
    "layer_z_curve",
    "SELECT tile_col, tile_row, CAST(" + _Z + " AS BIGINT) AS z FROM"
    f" (SELECT DISTINCT CAST(vec_id % {ACROSS} AS BIGINT) AS tile_col, CAST(vec_id // {ACROSS} AS BIGINT) AS tile_row FROM embeddings)",
)
def _(spark, sf_dir):
    return frames.layer(spark, sf_dir).select(
        F.col(f"{KEY}.col").cast("long").alias("tile_col"), F.col(f"{KEY}.row").cast("long").alias("tile_row"),
        pyramid.z_key(f"{KEY}.col", f"{KEY}.row").alias("z"),
    )


@query(
    "layer_store_and_catalog",
    f"""
WITH coarse AS (SELECT x // 2 AS x, y // 2 AS y, sum(v) / count(*) AS v FROM ({_global(GAPPY_CELLS)}) WHERE v IS NOT NULL GROUP BY ALL)
SELECT 'scene' AS name, CAST(1 AS INTEGER) AS zoom, tile_col, tile_row, column_index, row_index, band_1, NULL::DOUBLE AS band_2 FROM ({GAPPY_CELLS}) WHERE band_1 IS NOT NULL
UNION ALL
SELECT 'scene', 0, CAST(x // {SIDE} AS INTEGER), CAST(y // {SIDE} AS INTEGER), CAST(x % {SIDE} AS INTEGER), CAST(y % {SIDE} AS INTEGER), round(v, 6), NULL FROM coarse
UNION ALL
SELECT 'two bands', 2, tile_col, tile_row, column_index, row_index, band_1, band_2 FROM ({GAPPY_CELLS}) WHERE band_1 IS NOT NULL OR band_2 IS NOT NULL
""",
)
def _(spark, sf_dir):
    root = scratch_dir(spark, "layers")
    source = frames.gappy_layer(spark, sf_dir).select(KEY, "band_1")
    # Written twice, first with less and other data: the second write stands. Another layer has two bands.
    layer_store.write_layer(source.where(f"{KEY}.col > 2").withColumn("zoom", F.lit(7)), root, "scene")
    layer_store.write_layer(pyramid.build_pyramid(source, max_zoom=1), root, "scene")
    two = frames.gappy_layer(spark, sf_dir).withColumn("zoom", F.lit(2))
    layer_store.write_layer(two, root, "two bands")
    loaded = layer_store.load_layers(spark, root, layer_store.read_layer_catalog(spark, root))
    out = cell_ops.explode_tiles(loaded, ["band_1", "band_2"]).where("band_1 IS NOT NULL OR band_2 IS NOT NULL")
    return out.select(
        "name", "zoom", F.col(f"{KEY}.col").alias("tile_col"), F.col(f"{KEY}.row").alias("tile_row"),
        "column_index", "row_index", F.round("band_1", 6).alias("band_1"), "band_2",
    )


@query(
    "layer_as_checked",
    f"SELECT tile_col, tile_row, CAST({SIDE * SIDE} AS INTEGER) AS cells FROM (SELECT DISTINCT tile_col, tile_row FROM ({CELLS}))",
)
def _(spark, sf_dir):
    """A frame taken as a layer once its key and tiles are checked."""
    layer = layers.as_layer(frames.layer(spark, sf_dir))
    return layer.select(F.col(f"{KEY}.col").alias("tile_col"), F.col(f"{KEY}.row").alias("tile_row"), F.size("band_1.cells").alias("cells"))


@query(
    "layer_window",
    f"SELECT tile_col, tile_row, column_index, row_index, band_1 FROM ({CELLS}) WHERE tile_col BETWEEN 3 AND 13 AND tile_row BETWEEN 2 AND 9",
)
def _(spark, sf_dir):
    """A window of a stored layer, asked for as ranges of its Z key."""
    root = scratch_dir(spark, "layers")
    layer_store.write_layer(frames.band_layer(spark, sf_dir, "band_1").withColumn("zoom", F.lit(5)), root, "scene")
    window = layer_store.load_window(spark, root, "scene", 5, (3, 2), (13, 9))
    return cell_ops.explode_tiles(window, ["band_1"]).select(
        F.col(f"{KEY}.col").alias("tile_col"), F.col(f"{KEY}.row").alias("tile_row"), "column_index", "row_index", "band_1"
    )


@query("image_store", f"SELECT {_PLACE}, band_2 FROM ({CELLS})")
def _(spark, sf_dir):
    root = scratch_dir(spark, "images")
    source = frames.layer(spark, sf_dir)
    layer_store.write_image(source.select(KEY, "band_1"), root, 1, 6)
    layer_store.write_image(source.select(KEY, F.col("band_2").alias("band_1")), root, 2, 6)
    loaded = layer_store.load_image(spark, root, 2, 6).withColumnRenamed("band_1", "band_2")
    return cells_of_layer(loaded, "band_2")


@query(
    "reproject_points",
    f"SELECT c_custkey, round(radians(x) * {_R}, 3) + 0 AS mx, round(ln(tan({math.pi / 4} + radians(y) / 2)) * {_R}, 3) + 0 AS my,"
    f" round(x, 6) + 0 AS lon, round(y, 6) + 0 AS lat FROM ({frames.POINTS})",
)
def _(spark, sf_dir):
    points = frames.customer_points(spark, sf_dir)
    mx, my = geometry.reproject("x", "y", "EPSG:4326", "EPSG:3857")
    lon, lat = geometry.reproject(mx, my, "EPSG:3857", "EPSG:4326")
    return points.select(
        "c_custkey", F.round(mx, 3).alias("mx"), F.round(my, 3).alias("my"),
        F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"),
    )
