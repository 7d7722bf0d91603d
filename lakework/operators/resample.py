"""Layers on different grids: joins by extent, reprojection and the Web-Mercator layout."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakework.functions.geometry import MERCATOR_LATITUDE, MERCATOR_LIMIT, make_box, reproject, reproject_extent
from lakework.functions.tiles import cells_of, cols_of, rows_of
from lakework.operators.cells import st_assemble_tile, tile_columns
from lakework.operators.layers import KEY, with_extent


def _uniform(df: DataFrame, *cols: str, widest: str | None = None) -> list:
    """The one value of each column, in one scan; a layer has a single CRS and tile size.

    ``widest`` adds the longest side of a box column.
    """
    bounds = [f(c).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("low", F.min), ("high", F.max))]
    bounds += [F.max(_side(widest)).alias("side")] if widest else []
    row = df.agg(*bounds).first()
    for i, c in enumerate(cols):
        if row[f"low{i}"] != row[f"high{i}"]:
            raise ValueError(f"{c} must be the same in all rows, found {row[f'low{i}']!r} and {row[f'high{i}']!r}")
    return [row[f"low{i}"] for i in range(len(cols))] + ([row.side or 1.0] if widest else [])


def resample_pairs(
    pairs: DataFrame,
    bands: Sequence[str],
    cols: int,
    rows: int,
    target_crs: str,
    source_crs: str,
    method: str,
    target: Sequence[str] = ("_tc", "_tr"),
) -> DataFrame:
    """Draw source tiles on target tiles: one row per target with the bands resampled.

    ``pairs`` holds ``_tc, _tr`` (target key; ``target`` names what tells targets apart), ``_te`` (target extent), ``_se`` (source
    extent), ``_ord`` (source order, for overlaps), ``_sw, _sh`` (source cells) and the cells of
    the source bands. Each pair makes
    only the target cells near its source tile, and these meet per target cell in a
    partial aggregate, so overlapping sources add no load to a single task.
    """
    if method not in ("nearest", "bilinear"):
        raise ValueError(f"unknown resampling {method!r}")
    box = reproject_extent("_se", source_crs, target_crs)
    target = list(target)
    located = pairs.select(
        *target, "_te", "_se", "_ord",
        box.alias("_box"), "_sw", "_sh", *bands,
    ).select(
        "*",
        ((F.col("_te.xmax") - F.col("_te.xmin")) / cols).alias("_cw"),
        ((F.col("_te.ymax") - F.col("_te.ymin")) / rows).alias("_ch"),
        ((F.col("_se.xmax") - F.col("_se.xmin")) / F.col("_sw")).alias("_scw"),
        ((F.col("_se.ymax") - F.col("_se.ymin")) / F.col("_sh")).alias("_sch"),
    )
    # A reprojected edge is curved, so its box may fall short by part of a cell; bilinear
    # reads half a source cell beyond the tile. Both are measured in target cells.
    margin_x = margin_y = F.lit(0.0 if source_crs == target_crs else 1.0)
    if method == "bilinear":
        margin_x = margin_x + (F.col("_box.xmax") - F.col("_box.xmin")) / F.col("_sw") / F.col("_cw")
        margin_y = margin_y + (F.col("_box.ymax") - F.col("_box.ymin")) / F.col("_sh") / F.col("_ch")

    def window(low: Column, high: Column, margin: Column, size: int) -> Column:
        # Cell centres lie at i + 0.5.
        first = F.greatest(F.lit(0), F.floor(low - margin - 0.5).cast("int"))
        last = F.least(F.lit(size - 1), F.ceil(high + margin - 0.5).cast("int"))
        return F.when(first <= last, F.sequence(first, last))

    x_range = window(
        (F.col("_box.xmin") - F.col("_te.xmin")) / F.col("_cw"),
        (F.col("_box.xmax") - F.col("_te.xmin")) / F.col("_cw"), margin_x, cols,
    )
    y_range = window(
        (F.col("_te.ymax") - F.col("_box.ymax")) / F.col("_ch"),
        (F.col("_te.ymax") - F.col("_box.ymin")) / F.col("_ch"), margin_y, rows,
    )
    centres = located.select("*", F.explode(x_range).alias("_i")).select("*", F.explode(y_range).alias("_j"))
    px, py = reproject(
        F.col("_te.xmin") + (F.col("_i") + 0.5) * F.col("_cw"),
        F.col("_te.ymax") - (F.col("_j") + 0.5) * F.col("_ch"),
        target_crs, source_crs,
    )
    # Position in source cells, from the upper left corner.
    centres = centres.select(
        *target, "_i", "_j", "_ord", "_sw", "_sh", *bands,
        ((px - F.col("_se.xmin")) / F.col("_scw")).alias("_fx"),
        ((F.col("_se.ymax") - py) / F.col("_sch")).alias("_fy"),
    )
    sampled = _nearest(centres, bands, target) if method == "nearest" else _bilinear(centres, bands, target)
    return st_assemble_tile(sampled, target, "_i", "_j", list(bands), cols, rows, distinct_cells=True)


def _nearest(centres: DataFrame, bands: Sequence[str], target: list[str]) -> DataFrame:
    """The source cell that holds the centre; a centre on an edge belongs to the right and upper cell."""
    at = centres.select(
        "*", F.floor("_fx").cast("int").alias("_sc"), (F.ceil("_fy") - 1).cast("int").alias("_sr")
    ).where("_sc >= 0 AND _sc < _sw AND _sr >= 0 AND _sr < _sh")
    place = F.col("_sr") * F.col("_sw") + F.col("_sc")
    picked = at.select(*target, "_i", "_j", "_ord", *[F.get(b, place).alias(b) for b in bands])
    # Where sources overlap, the first in source order that has data.
    first = [F.min_by(b, F.when(F.col(b).isNotNull(), F.col("_ord"))).alias(b) for b in bands]
    return picked.groupBy(*target, "_i", "_j").agg(*first)


def _bilinear(centres: DataFrame, bands: Sequence[str], target: list[str]) -> DataFrame:
    """Mean of the four cells around the centre, weighted by distance over those with data.

    Every source tile gives the share of the neighbours it holds; the shares of
    several tiles add up, so tile edges need no halo.
    """
    spots = centres.select(
        "*", F.floor(F.col("_fx") - 0.5).cast("int").alias("_x0"), F.floor(F.col("_fy") - 0.5).cast("int").alias("_y0")
    ).select(
        "*", (F.col("_fx") - 0.5 - F.col("_x0")).alias("_dx"), (F.col("_fy") - 0.5 - F.col("_y0")).alias("_dy")
    ).where("_x0 + 1 >= 0 AND _x0 < _sw AND _y0 + 1 >= 0 AND _y0 < _sh")
    shares = []
    for b in bands:
        weighted, weight = F.lit(0.0), F.lit(0.0)
        for ox, wx in ((0, 1 - F.col("_dx")), (1, F.col("_dx"))):
            for oy, wy in ((0, 1 - F.col("_dy")), (1, F.col("_dy"))):
                x, y = F.col("_x0") + ox, F.col("_y0") + oy
                inside = (x >= 0) & (x < F.col("_sw")) & (y >= 0) & (y < F.col("_sh"))
                cell = F.when(inside, F.get(b, y * F.col("_sw") + x))
                weighted = weighted + F.coalesce(wx * wy * cell, F.lit(0.0))
                weight = weight + F.when(cell.isNotNull(), wx * wy).otherwise(0.0)
        shares += [weighted.alias(f"_n_{b}"), weight.alias(f"_w_{b}")]
    return (
        spots.select(*target, "_i", "_j", *shares)
        .groupBy(*target, "_i", "_j")
        .agg(*[F.try_divide(F.sum(f"_n_{b}"), F.sum(f"_w_{b}")).alias(b) for b in bands])
    )


def _flat(bands: Sequence[str]) -> list[Column]:
    """Size and cells of the tiles as plain columns.

    Above two generators over literal extents the optimizer loses track of tile structs.
    """
    return [cols_of(bands[0]).alias("_sw"), rows_of(bands[0]).alias("_sh"), *[cells_of(b).alias(b) for b in bands]]


def _source_order() -> Column:
    """Row-major order of source keys in one long."""
    return F.col(f"{KEY}.row").cast("long") * F.lit(1 << 31) + F.col(f"{KEY}.col")


def raster_join(
    left: DataFrame,
    right: DataFrame,
    how: str = "left",
    resample: str = "nearest",
    unique: bool = False,
) -> DataFrame:
    """Join layers of different CRS, extent and resolution where their extents intersect.

    Right tiles take the CRS, extent and cells of the left tiles they meet. Both sides
    need ``spatial_key, crs, extent``. Extents are put into square buckets and joined
    on the bucket. The bucket size of a right tile is the power of two of the left tile
    size that fits it, so tiles of any size fall into at most four buckets, and a few
    large ones do not make the buckets of the small ones larger. A pair counts only in
    the bucket of its intersection's lower left corner, so no pair comes twice and
    nothing has to be made distinct. A left tile is told by its key and its extent, so
    scenes that repeat keys stay apart; ``unique`` says that no key of the left repeats, which saves
    making them distinct and a part of the key. ``how`` is ``left`` or ``inner``; left tiles
    without a partner get NULL tiles.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"unknown join type {how!r}")
    bands = tile_columns(right)
    clash = set(bands) & set(left.columns)
    if clash:
        raise ValueError(f"both layers have {sorted(clash)}")
    left_tile = tile_columns(left)[0]
    left_crs, cols, rows, side = _uniform(left, "crs", f"{left_tile}.cols", f"{left_tile}.rows", widest="extent")
    if cols is None:
        return left.join(right.select(KEY, *bands).limit(0), on=KEY, how=how)
    right_crs = _uniform(right, "crs")[0] or left_crs
    place = F.xxhash64("extent.xmin", "extent.ymin", "extent.xmax", "extent.ymax")
    targets = left.select(F.col(f"{KEY}.col").alias("_tc"), F.col(f"{KEY}.row").alias("_tr"), F.col("extent").alias("_te"))
    told_by = ("_tc", "_tr") if unique else ("_tc", "_tr", "_tp")
    if not unique:
        targets = targets.withColumn("_tp", F.xxhash64("_te.xmin", "_te.ymin", "_te.xmax", "_te.ymax")).distinct()
    sources = right.select(
        F.col("extent").alias("_se"), _source_order().alias("_ord"),
        reproject_extent("extent", right_crs, left_crs).alias("_sb"), *_flat(bands),
    )
    # Bilinear weights reach half a source cell beyond a tile.
    grow_x = grow_y = F.lit(0.0)
    if resample == "bilinear":
        grow_x = (F.col("_sb.xmax") - F.col("_sb.xmin")) / F.col("_sw") / 2
        grow_y = (F.col("_sb.ymax") - F.col("_sb.ymin")) / F.col("_sh") / 2
    sources = sources.withColumn(
        "_sb",
        make_box(
            F.col("_sb.xmin") - grow_x, F.col("_sb.ymin") - grow_y,
            F.col("_sb.xmax") + grow_x, F.col("_sb.ymax") + grow_y,
        ),
    )
    level = F.greatest(F.lit(0), F.ceil(F.log2(_side("_sb") / side))).cast("int")
    sources = sources.withColumn("_lv", level)
    # At most one row per power of two between the smallest and the largest tile.
    levels = [r["_lv"] for r in sources.select("_lv").where("_lv IS NOT NULL").distinct().collect()]
    targets = targets.withColumn("_lv", F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>")))
    size = F.lit(side) * F.pow(F.lit(2.0), F.col("_lv"))
    pairs = (
        _bucketed(targets, "_te", size)
        .join(_bucketed(sources, "_sb", size), on=["_lv", "_bx", "_by"])
        .where("_te.xmin < _sb.xmax AND _sb.xmin < _te.xmax AND _te.ymin < _sb.ymax AND _sb.ymin < _te.ymax")
        .where(
            (F.col("_bx") == F.floor(F.greatest("_te.xmin", "_sb.xmin") / size))
            & (F.col("_by") == F.floor(F.greatest("_te.ymin", "_sb.ymin") / size))
        )
        .drop("_lv", "_bx", "_by", "_sb")
    )
    drawn = resample_pairs(pairs, bands, cols, rows, left_crs, right_crs, resample, told_by)
    # On the key's fields, by which the drawn tiles are partitioned already.
    same = (F.col(f"{KEY}.col") == F.col("_tc")) & (F.col(f"{KEY}.row") == F.col("_tr"))
    if not unique:
        same = same & (place == F.col("_tp"))
    return left.join(drawn, same, how).drop(*told_by)


def _side(box: str) -> Column:
    return F.greatest(F.col(f"{box}.xmax") - F.col(f"{box}.xmin"), F.col(f"{box}.ymax") - F.col(f"{box}.ymin"))


def _bucketed(df: DataFrame, box: str, size: Column) -> DataFrame:
    def span(low: str, high: str) -> Column:
        return F.sequence(F.floor(F.col(f"{box}.{low}") / size), F.floor(F.col(f"{box}.{high}") / size))

    return df.select("*", F.explode(span("xmin", "xmax")).alias("_bx")).select(
        "*", F.explode(span("ymin", "ymax")).alias("_by")
    )


def mercator_cell(zoom: int, tile_size: int) -> float:
    """Cell size in metres of a zoom level."""
    return 2 * MERCATOR_LIMIT / (tile_size * 2**zoom)


def zoom_for(cell: float, tile_size: int) -> int:
    """The coarsest zoom level whose cells are no larger than ``cell`` metres."""
    return max(0, math.ceil(round(math.log2(2 * MERCATOR_LIMIT / (tile_size * cell)), 9)))


def to_zoomed_layout(
    layer: DataFrame, tile_size: int = 256, zoom: int | None = None, resample: str = "nearest"
) -> DataFrame:
    """Re-tile a layer in the Web-Mercator pyramid layout, with a ``zoom`` column.

    Without ``zoom`` the level is the coarsest that keeps the detail of the source within the
    layout's square; what lies beyond it, towards the poles, has no place there.
    Each source tile finds the target keys under it by arithmetic; no join is needed.
    """
    bands = tile_columns(layer)
    (crs,) = _uniform(layer, "crs")
    sources = layer.select(
        F.col("extent").alias("_se"), _source_order().alias("_ord"),
        reproject_extent("extent", crs, "EPSG:3857").alias("_sb"), *_flat(bands),
    )
    if zoom is None:
        rows_drawn = F.col("_sh")
        if crs == "EPSG:4326":  # the box ends with the square, so only the rows within it share its height
            low, high = F.greatest(F.col("_se.ymin"), F.lit(-MERCATOR_LATITUDE)), F.least(F.col("_se.ymax"), F.lit(MERCATOR_LATITUDE))
            rows_drawn = rows_drawn * ((high - low) / (F.col("_se.ymax") - F.col("_se.ymin")))
        finest = F.least(
            (F.col("_sb.xmax") - F.col("_sb.xmin")) / F.col("_sw"),
            F.try_divide(F.col("_sb.ymax") - F.col("_sb.ymin"), rows_drawn),
        )
        # A tile beyond the square has no side there, so it says nothing of the detail.
        finest = sources.agg(F.min(F.when(finest > 0, finest)).alias("cell")).first().cell
        zoom = 0 if finest is None else zoom_for(finest, tile_size)
    if resample == "nearest":  # no target cell lies in such a tile; bilinear weights may reach it
        sources = sources.where("_sb.xmax > _sb.xmin AND _sb.ymax > _sb.ymin")
    cell = mercator_cell(zoom, tile_size)
    side, last = cell * tile_size, 2**zoom - 1

    def keys(low: Column, high: Column, margin: Column) -> Column:
        first = F.greatest(F.lit(0), F.floor((low - margin) / side).cast("int"))
        return F.sequence(F.least(first, F.lit(last)), F.least(F.lit(last), F.greatest(first, F.floor((high + margin) / side).cast("int"))))

    margin_x = (F.col("_sb.xmax") - F.col("_sb.xmin")) / F.col("_sw")
    margin_y = (F.col("_sb.ymax") - F.col("_sb.ymin")) / F.col("_sh")
    x_keys = keys(F.col("_sb.xmin") + MERCATOR_LIMIT, F.col("_sb.xmax") + MERCATOR_LIMIT, margin_x)
    y_keys = keys(MERCATOR_LIMIT - F.col("_sb.ymax"), MERCATOR_LIMIT - F.col("_sb.ymin"), margin_y)
    pairs = (
        sources.select("*", F.explode(x_keys).alias("_tc"))
        .select("*", F.explode(y_keys).alias("_tr"))
        .withColumn(
            "_te",
            make_box(
                F.col("_tc") * side - MERCATOR_LIMIT, MERCATOR_LIMIT - (F.col("_tr") + 1) * side,
                (F.col("_tc") + 1) * side - MERCATOR_LIMIT, MERCATOR_LIMIT - F.col("_tr") * side,
            ),
        )
    )
    drawn = resample_pairs(pairs, bands, tile_size, tile_size, "EPSG:3857", crs, resample)
    keyed = drawn.select(
        F.struct(F.col("_tc").alias("col"), F.col("_tr").alias("row")).alias(KEY),
        F.lit("EPSG:3857").alias("crs"), F.lit(zoom).alias("zoom"), *bands,
    )
    return with_extent(keyed, tile_size, tile_size, (-MERCATOR_LIMIT, MERCATOR_LIMIT), cell)
