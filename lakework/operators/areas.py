"""Areas of many rows: a hierarchical cell cover, points in areas, and labels painted into tiles.

An area is a ring, a polygon (rings, the holes after the outer one) or several polygons, as
:func:`lakework.sources.features.read_geojson` gives them; a point is inside by the even-odd rule
over all rings.

The cover is a quadtree's cells of many sizes. Each area starts with the few cells around it and
goes down: a cell that no edge touches is inside as a whole or dropped, any other is split, and what
is left at the area's finest level is a border cell. A cell carries only the edges that its own
test needs, those in its strip and not to its left, so a large polygon is spread over its cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakework.functions.geometry import inside_edges, ring_edges
from lakework.functions.tiles import make_tile
from lakework.session import scratch_dir

STEP = 2  # levels of the quadtree between a cell and its children
MAX_LEVEL = 26  # finer cells would come near the rounding of doubles
ACROSS = 8  # cells of the finest level across an area, at least
_EDGES = 64  # edges up to which that level is fine enough
_MATRIX = 1 << 20  # numbers of cells times edges that are looked at together
_MARGIN = 1e-6  # of a cell's side, by which it is widened when edges are tested



def area_edges(df: DataFrame, area: str) -> Column:
    """All edges of an area; NULL where a coordinate is missing or not finite."""
    kind, rings = df.schema[area].dataType, F.col(f"`{area}`")
    depth = 0
    while isinstance(kind, T.ArrayType):
        kind, depth = kind.elementType, depth + 1
    if depth not in (1, 2, 3) or not isinstance(kind, T.StructType):
        raise ValueError(f"{area} is no ring, polygon or list of polygons")
    if depth == 3:
        rings = F.flatten(rings)
    edges = ring_edges(rings) if depth == 1 else F.flatten(F.transform(rings, ring_edges))
    edges = F.transform(edges, lambda e: F.struct(*(F.struct(e[c]["x"].cast("double").alias("x"), e[c]["y"].cast("double").alias("y")).alias(c) for c in ("p", "q"))))
    sound = F.forall(edges, lambda e: F.coalesce(*[_finite(e)], F.lit(False)))
    return F.when(sound, edges)


def _finite(e: Column) -> Column:
    total = F.abs(e["p"]["x"]) + F.abs(e["p"]["y"]) + F.abs(e["q"]["x"]) + F.abs(e["q"]["y"])
    return total < float("inf")


def _with_bounds(df: DataFrame) -> DataFrame:
    """The box of ``_edges``; rows without an extent contain nothing and go."""
    def of(end: str, axis: str) -> Column:
        return F.transform("_edges", lambda e: e[end][axis])

    ends = {axis: F.concat(of("p", axis), of("q", axis)) for axis in "xy"}
    bounded = df.where("_edges IS NOT NULL").withColumns(
        {f"_{axis}{i}": fn(ends[axis]) for axis in "xy" for i, fn in ((0, F.array_min), (1, F.array_max))}
    )
    return bounded.where("_x1 > _x0 AND _y1 > _y0")


class _Shape:
    """The edges of one area and the quadtree's cells against them."""

    def __init__(self, edges: np.ndarray, domain: tuple[float, float, float, float]) -> None:
        self.px, self.py, self.qx, self.qy = edges
        self.left, self.right = np.minimum(self.px, self.qx), np.maximum(self.px, self.qx)
        self.low, self.high = np.minimum(self.py, self.qy), np.maximum(self.py, self.qy)
        self.domain = domain

    def settle(self, own: np.ndarray, level: int, cx: np.ndarray, cy: np.ndarray):
        """(cells inside as a whole, their numbers), (border cell, its edges) of cells that may have the edges ``own``."""
        x0, y0, width, height = self.domain
        sx, sy = width / 2.0**level, height / 2.0**level
        left, right = (x0 + (cx + d) * sx for d in (-_MARGIN, 1 + _MARGIN))
        low, high = (y0 + (cy + d) * sy for d in (-_MARGIN, 1 + _MARGIN))
        px, py = self.px[own], self.py[own]
        dx, dy = self.qx[own] - px, self.qy[own] - py

        def side(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            return dx * (y[:, None] - py) - dy * (x[:, None] - px)

        strip = (self.high[own] >= low[:, None]) & (self.low[own] <= high[:, None]) & (self.right[own] >= left[:, None])
        corners = [side(x, y) for x in (left, right) for y in (low, high)]
        apart = (np.minimum.reduce(corners) > 0) | (np.maximum.reduce(corners) < 0)
        border = (strip & (self.left[own] <= right[:, None]) & ~apart).any(axis=1)
        x, y = (left + right) / 2, (low + high) / 2
        spans = (py > y[:, None]) != (self.qy[own] > y[:, None])
        crossed = spans & np.where(dy > 0, side(x, y) > 0, side(x, y) < 0)
        inner = ~border & (crossed.sum(axis=1) % 2 == 1)
        return np.flatnonzero(inner), [(int(i), own[strip[i]]) for i in np.flatnonzero(border)]

    def cells(self, start: int, leaf: int) -> Iterator[tuple[int, int, int, np.ndarray | None]]:
        """(level, cx, cy, edges to test or None) of the cover; a border cell is split down to ``leaf``."""
        x0, y0, width, height = self.domain
        scale = 2.0**start
        xs = np.arange(int((self.left.min() - x0) / width * scale), int((self.right.max() - x0) / width * scale) + 1)
        ys = np.arange(int((self.low.min() - y0) / height * scale), int((self.high.max() - y0) / height * scale) + 1)
        open_cells = [(start, np.tile(xs, len(ys)), np.repeat(ys, len(xs)), np.arange(len(self.px)))]
        across = np.arange(1 << STEP)
        while open_cells:
            level, cx, cy, own = open_cells.pop()
            some = max(1, _MATRIX // max(1, len(own)))
            for first in range(0, len(cx), some):
                xs, ys = cx[first : first + some], cy[first : first + some]
                inner, border = self.settle(own, level, xs, ys)
                yield from ((level, int(xs[i]), int(ys[i]), None) for i in inner)
                for i, left in border:
                    if level >= leaf:
                        yield level, int(xs[i]), int(ys[i]), left
                    else:
                        children = (int(xs[i]) << STEP) + across, (int(ys[i]) << STEP) + across
                        open_cells.append((level + STEP, np.tile(children[0], len(across)), np.repeat(children[1], len(across)), left))


def edge_arrays(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(px, py, qx, qy) of all edges of a column of edges, and the n + 1 offsets of the rows."""
    flat = lists.flatten()
    edges = np.stack([pc.struct_field(flat, [end, axis]).to_numpy(zero_copy_only=False) for end in ("p", "q") for axis in ("x", "y")])
    return edges, np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))]).astype(np.int64)


_OWN_NAMES = {"_edges", "_x0", "_x1", "_y0", "_y1", "_start", "_leaf", "_level", "_cx", "_cy", "_inner", "_k"}


def cover(areas: DataFrame, domain: tuple[float, float, float, float]) -> DataFrame:
    """The cells (``_level``, ``_cx``, ``_cy``) of areas, ``_inner`` or else with the ``_edges`` to test.

    ``areas`` has ``_edges``, and ``_start`` and ``_leaf``, the levels to begin and to end with;
    ``domain`` is (x, y, width, height) of level 0. Cells of one area do not overlap.
    """
    own = [c for c in areas.columns if c not in _OWN_NAMES]
    source = areas.select(*[f"`{c}`" for c in own], "_edges", "_start", "_leaf")
    added = {"_level": "int", "_cx": "long", "_cy": "long", "_inner": "boolean"}
    schema = source.select(*[f"`{c}`" for c in own], *[F.lit(None).cast(k).alias(c) for c, k in added.items()], "_edges").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(own))
            edges, ends = edge_arrays(lists)
            starts, leaves = (batch.column(len(own) + k).to_numpy() for k in (1, 2))
            held, n = [], 0
            for i in range(batch.num_rows):
                shape = _Shape(edges[:, ends[i] : ends[i + 1]], domain)
                for level, cx, cy, left in shape.cells(int(starts[i]), int(leaves[i])):
                    held.append((i, level, cx, cy, np.zeros(0, np.int64) if left is None else left + ends[i], left is None))
                    n += len(held[-1][4]) + 1
                    if n >= _MATRIX:
                        yield flush(batch, lists, held)
                        held, n = [], 0
            if held:
                yield flush(batch, lists, held)

    def flush(batch: pa.RecordBatch, lists: pa.Array, held: list[tuple]) -> pa.RecordBatch:
        owner, level, cx, cy, at, inner = zip(*held)
        offsets = np.concatenate([[0], np.cumsum([len(a) for a in at])])
        some = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), lists.flatten().take(pa.array(np.concatenate(at), pa.int64())))
        kept = batch.select(range(len(own))).take(pa.array(owner, pa.int64())).columns
        columns = [*kept, pa.array(level, pa.int32()), pa.array(cx, pa.int64()), pa.array(cy, pa.int64()), pa.array(inner), some]
        return pa.RecordBatch.from_arrays(columns, [*own, *added, "_edges"])

    return source.mapInArrow(run, schema)


def _renamed(areas: DataFrame, taken: list[str], leave: str) -> DataFrame:
    """The areas' columns but their shape, those that are taken with ``area_`` in front."""
    names, used = [], {c.lower() for c in taken} | _OWN_NAMES
    for name in (c for c in areas.columns if c != leave):
        new = name
        while new.lower() in used:
            new = f"area_{new}"
        used.add(new.lower())
        names.append(F.col(f"`{name}`").alias(new))
    return areas.select(*names, area_edges(areas, leave).alias("_edges"))


def points_in_areas(points: DataFrame, areas: DataFrame, point: str = "geom", area: str = "area") -> DataFrame:
    """Every pair of a point and an area that holds it: the columns of both, but not the shape.

    Points meet areas by an equi join on cells; only in border cells are edges tested, and only
    the cell's. Points on an edge are outside, as with ``st_contains``. An area or a point that is NULL, or
    has a coordinate that is missing or not finite, has no pair. Repeated rows give repeated
    pairs. A column of the areas whose name the points have gets ``area_`` in front. One row of
    extents and the levels in use, a dozen numbers, come to the driver.
    """
    if clash := _OWN_NAMES & {c.lower() for c in points.columns}:
        raise ValueError(f"the points may not have columns named {sorted(clash)}")
    shapes = _with_bounds(_renamed(areas, points.columns, area))
    box = shapes.agg(F.min("_x0"), F.min("_y0"), F.max("_x1"), F.max("_y1")).first()
    if box[0] is None:
        kept = shapes.drop("_edges", "_x0", "_x1", "_y0", "_y1").where(F.lit(False))
        return points.join(kept.withColumn("_none", F.lit(0)), F.lit(0) == F.col("_none")).drop("_none")
    x0, y0 = box[0], box[1]
    size = max(box[2] - x0, box[3] - y0) * (1 + 1e-9)
    side = F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"))
    deeper = F.ceil(F.log(float(4**STEP), F.greatest(F.size("_edges") / _EDGES, F.lit(1.0))))
    fine = F.ceil(F.log2(size * ACROSS / side) / STEP) + deeper
    leaf = F.least(F.lit(MAX_LEVEL // STEP), fine).cast("int")
    start = F.greatest(F.lit(0), F.least(leaf, fine.cast("int")) - 2 - deeper.cast("int"))
    levels = shapes.withColumns({"_leaf": leaf * STEP, "_start": start * STEP})
    # Written, so that the levels in use are known without a second cover.
    path = scratch_dir(areas.sparkSession, "area-cells")
    # The cover is work per area, not per byte: a table of areas is small and may lie in one file.
    parts = int(areas.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = cover(levels.repartition(parts), (x0, y0, size, size))
    found.write.parquet(path)
    cells = areas.sparkSession.read.schema(found.schema).parquet(path)
    used = [r[0] for r in cells.select("_level").distinct().collect()]  # at most MAX_LEVEL / STEP + 1
    x, y = F.col(f"`{point}`")["x"].cast("double"), F.col(f"`{point}`")["y"].cast("double")

    def place(value: Column, origin: float, level: int) -> Column:
        return F.floor((value - origin) / size * float(1 << level)).cast("long")

    keys = [F.struct(F.lit(n).alias("level"), place(x, x0, n).alias("cx"), place(y, y0, n).alias("cy")) for n in used]
    near = points.where(x.between(x0, box[2]) & y.between(y0, box[3])).withColumn("_k", F.explode(F.array(*keys)))
    near = near.withColumns({"_level": F.col("_k.level"), "_cx": F.col("_k.cx"), "_cy": F.col("_k.cy")}).drop("_k")
    # Files of cells pack tightly, so their size says little of what a broadcast would hold: no side is sent whole.
    met = near.join(cells.hint("merge"), ["_level", "_cx", "_cy"]).where(F.col("_inner") | inside_edges(F.col("_edges"), x, y))
    return met.drop("_level", "_cx", "_cy", "_inner", "_edges")


def fill_tile(edges: np.ndarray, x0: int, y0: int, cols: int, rows: int) -> np.ndarray:
    """Scanline fill: which cells of a tile have their centre inside edges (px, py, qx, qy), rows of cells down.

    Going down the rows, edges enter a list of active ones as the scanline reaches their upper end
    and leave it at their lower end; between crossings, cells are in and out in turn. Every centre
    is inside one of two areas that share an edge. Edges to the tile's left need not be there.
    """
    px, py, qx, qy = edges
    upper, lower = np.minimum(py, qy), np.maximum(py, qy)
    entering = np.argsort(upper, kind="stable")
    centres = x0 + np.arange(cols) + 0.5
    mask, active, entered = np.zeros((rows, cols), bool), np.zeros(0, np.int64), 0
    for row in range(rows):
        y = y0 + row + 0.5
        until = int(np.searchsorted(upper[entering], y, side="right"))
        active = np.concatenate([active, entering[entered:until]])
        entered = until
        active = active[lower[active] > y]
        if len(active):
            a = active
            crossings = px[a] + (y - py[a]) * (qx[a] - px[a]) / (qy[a] - py[a])
            ends = np.searchsorted(centres, crossings, side="left")  # a crossing lies right of the cells before it
            turns = np.bincount(ends, minlength=cols + 1)[::-1].cumsum()[::-1]
            mask[row] = turns[1 : cols + 1] % 2 == 1
    return mask


def _tile_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """Runs of rows of one tile, in the order they come."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("col", "row")], axis=1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(keys)]):
            yield (int(keys[a][0]), int(keys[a][1])), batch.slice(a, b - a)


class _Canvas:
    """One tile being painted: per cell the least order and its value."""

    def __init__(self, key: tuple[int, int], size: int) -> None:
        self.key, self.order, self.value, self.free = key, np.zeros(size, np.int64), np.zeros(size), np.ones(size, bool)

    def paint(self, mask: np.ndarray, order, value) -> None:
        better = mask & (self.free | (order < self.order) | ((order == self.order) & (value < self.value)))
        self.order = np.where(better, order, self.order)
        self.value = np.where(better, value, self.value)
        self.free &= ~better

    def row(self) -> pa.RecordBatch:
        def lists(values, kind):
            return pa.array([pa.array(values, kind, mask=self.free)], pa.list_(kind))

        columns = [pa.array([self.key[0]], pa.int32()), pa.array([self.key[1]], pa.int32()), lists(self.order, pa.int64()), lists(self.value, pa.float64())]
        return pa.RecordBatch.from_arrays(columns, ["col", "row", "orders", "cells"])


def _painted(batches, size: int, paint) -> Iterator[pa.RecordBatch]:
    canvas = None
    for key, part in _tile_runs(batches):
        if canvas is not None and canvas.key != key:
            if not canvas.free.all():
                yield canvas.row()
            canvas = None
        canvas = canvas or _Canvas(key, size)
        paint(canvas, part)
    if canvas is not None and not canvas.free.all():
        yield canvas.row()


def _paint_areas(cols: int, rows: int):
    def paint(canvas: _Canvas, part: pa.RecordBatch) -> None:
        get = lambda c: part.column(part.schema.get_field_index(c))
        edges, ends = edge_arrays(get("edges"))
        for i, (inner, order, value) in enumerate(zip(get("inner").to_pylist(), get("rank").to_pylist(), get("value").to_pylist())):
            if inner:
                mask = np.ones(cols * rows, bool)
            else:
                mask = fill_tile(edges[:, ends[i] : ends[i + 1]], canvas.key[0] * cols, canvas.key[1] * rows, cols, rows).ravel()
            canvas.paint(mask, order, value)

    return lambda batches: _painted(batches, cols * rows, paint)


def _merge_tiles(cols: int, rows: int):
    def merge(canvas: _Canvas, part: pa.RecordBatch) -> None:
        orders, cells = (part.column(part.schema.get_field_index(c)) for c in ("orders", "cells"))
        for i in range(part.num_rows):
            order, value = orders[i].values, cells[i].values
            mask = order.is_valid().to_numpy(zero_copy_only=False)
            canvas.paint(mask, order.fill_null(0).to_numpy(), value.fill_null(0).to_numpy())

    return lambda batches: _painted(batches, cols * rows, merge)


def rasterise_areas(
    areas: DataFrame, value: str, cols: int, rows: int, area: str = "area", order: str | None = None,
    origin: tuple[float, float] = (0.0, 0.0), cell: float = 1.0, name: str = "target",
) -> DataFrame:
    """A layer of labels: every cell whose centre lies in an area gets its ``value``.

    Where areas overlap, the one with the least ``order`` wins, then the least value; without an order the
    least value does. The grid is that of :func:`with_extent`: ``origin`` is the upper left corner
    of key (0, 0), tiles have ``cols`` x ``rows`` cells of size ``cell``. Tiles that no area reaches
    are not there; cells outside all areas are NoData. Areas with a NULL shape, value or order, or a
    coordinate that is missing or not finite, are left out. Each task paints the areas it has, a
    tile at a time, and only painted tiles are shuffled, so a tile under any number of areas is
    merged from one tile per task.
    """
    rank = F.lit(0).cast("long") if order is None else F.col(f"`{order}`").cast("long")
    shapes = areas.select(rank.alias("rank"), F.col(f"`{value}`").cast("double").alias("value"), area_edges(areas, area).alias("_edges"))

    def on_grid(p: Column) -> Column:
        return F.struct(((p["x"] - origin[0]) / cell).alias("x"), ((origin[1] - p["y"]) / cell).alias("y"))

    turned = F.transform("_edges", lambda e: F.struct(on_grid(e["p"]).alias("p"), on_grid(e["q"]).alias("q")))
    shapes = _with_bounds(shapes.where("rank IS NOT NULL AND value IS NOT NULL").withColumn("_edges", turned))
    tile = {c: F.floor(F.col(c) / (cols if c.startswith("_x") else rows)) for c in ("_x0", "_x1", "_y0", "_y1")}
    box = shapes.agg(F.min(tile["_x0"]), F.min(tile["_y0"]), F.max(tile["_x1"]), F.max(tile["_y1"])).first()
    partial = "col int, row int, orders array<long>, cells array<double>"
    if box[0] is None:
        painted = areas.sparkSession.createDataFrame([], partial)
    else:
        across = max(box[2] - box[0], box[3] - box[1]) + 1
        depth = STEP * math.ceil(math.log(across, 2**STEP) - 1e-12)
        if depth > MAX_LEVEL:
            raise ValueError("the areas reach over too many tiles")
        spans = F.greatest(tile["_x1"] - tile["_x0"], tile["_y1"] - tile["_y0"]) + 1
        splits = F.least(F.lit(depth // STEP), F.ceil(F.log(float(2**STEP), spans.cast("double"))).cast("int"))
        levels = shapes.withColumns({"_leaf": F.lit(depth), "_start": F.lit(depth) - splits * STEP})
        domain = (box[0] * cols, box[1] * rows, cols * 2.0**depth, rows * 2.0**depth)
        cells = cover(levels, domain)
        # An inner cell above the tiles is all the tiles below it.
        below = F.expr(f"shiftleft(1L, {depth} - _level)")
        cells = cells.withColumn("_n", F.explode(F.expr(f"sequence(0L, shiftleft(1L, 2 * ({depth} - _level)) - 1)")))
        keyed = cells.select(
            (F.col("_cx") * below + F.col("_n") % below + box[0]).cast("int").alias("col"),
            (F.col("_cy") * below + F.floor(F.col("_n") / below) + box[1]).cast("int").alias("row"),
            "rank", "value", F.col("_inner").alias("inner"), F.col("_edges").alias("edges"),
        )
        local = keyed.sortWithinPartitions("col", "row", "rank").mapInArrow(_paint_areas(cols, rows), partial)
        painted = local.repartition("col", "row").sortWithinPartitions("col", "row").mapInArrow(_merge_tiles(cols, rows), partial)
    return painted.select(F.struct("col", "row").alias("spatial_key"), make_tile(F.col("cells"), cols, rows).alias(name))
