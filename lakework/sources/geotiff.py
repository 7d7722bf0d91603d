"""GeoTIFF files as tile layers.

Spark lists the files without reading them, one stage turns their headers into
windows, and a second stage decodes the windows wherever there are free tasks. A
window reads only the strips or blocks it overlaps, so one large file is shared out
like many small ones.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakework.functions.geometry import BOX_DDL
from lakework.functions.tiles import TILE_DDL
from lakework.operators.layers import KEY

# Tag numbers of the TIFF 6.0 and GeoTIFF specifications that matter here.
_WIDTH, _HEIGHT, _BITS, _COMPRESSION = 256, 257, 258, 259
_STRIP_OFFSETS, _SAMPLES, _STRIP_ROWS, _STRIP_SIZES = 273, 277, 278, 279
_PLANAR, _PREDICTOR, _BLOCK_WIDTH, _BLOCK_HEIGHT = 284, 317, 322, 323
_BLOCK_OFFSETS, _BLOCK_SIZES, _FORMAT = 324, 325, 339
_PIXEL_SCALE, _TIE_POINT, _GEO_KEYS, _NO_DATA = 33550, 33922, 34735, 42113
_GEOGRAPHIC_KEY, _PROJECTED_KEY = 2048, 3072
# Struct codes of the TIFF field types.
_CODES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
_NO_COMPRESSION, _DEFLATE = 1, (8, 32946)


@dataclass(frozen=True)
class Header:
    """What the first image of a file says about itself."""

    width: int
    height: int
    bands: int
    dtype: np.dtype
    compression: int
    predictor: int
    separate: bool
    block: tuple[int, int]  # columns, rows of a strip or block
    padded: bool  # blocks are full at the edges, strips are not
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]
    no_data: float | None
    crs: str | None
    origin: tuple[float, float]
    cell: tuple[float, float]


def _open(path: str):
    """A random-access file on any store that Arrow knows."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    store, inner = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return store.open_input_file(inner)


def _tags(file) -> tuple[str, dict[int, tuple]]:
    head = file.read_at(16, 0)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    magic = struct.unpack(f"{order}H", head[2:4])[0] if order else 0
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    big = magic == 43
    start = struct.unpack(f"{order}Q", head[8:16])[0] if big else struct.unpack(f"{order}I", head[4:8])[0]
    lead, entry, word = ("Q", 20, "Q") if big else ("H", 12, "I")
    lead_size, word_size = struct.calcsize(lead), struct.calcsize(word)
    count = struct.unpack(f"{order}{lead}", file.read_at(lead_size, start))[0]
    table = file.read_at(count * entry, start + lead_size)
    tags = {}
    for at in range(0, len(table), entry):
        tag, kind = struct.unpack(f"{order}HH", table[at : at + 4])
        n = struct.unpack(f"{order}{word}", table[at + 4 : at + 4 + word_size])[0]
        if kind not in _CODES:
            continue
        code = f"{order}{n}{_CODES[kind]}"
        raw = table[at + 4 + word_size : at + entry]
        if struct.calcsize(code) > word_size:
            raw = file.read_at(struct.calcsize(code), struct.unpack(f"{order}{word}", raw)[0])
        tags[tag] = struct.unpack(code, raw[: struct.calcsize(code)])
    return order, tags


@lru_cache(maxsize=64)
def read_header(path: str) -> Header:
    with _open(path) as file:
        order, tags = _tags(file)
    one = lambda tag, default: tags.get(tag, (default,))[0]
    bits, kind = one(_BITS, 1), {1: "u", 2: "i", 3: "f"}.get(one(_FORMAT, 1))
    if bits not in (8, 16, 32, 64) or kind is None:
        raise ValueError(f"not supported sample type in {path}")
    if one(_COMPRESSION, 1) not in (_NO_COMPRESSION, *_DEFLATE):
        raise ValueError(f"not supported compression {one(_COMPRESSION, 1)} in {path}")
    if one(_PREDICTOR, 1) not in (1, 2):
        raise ValueError(f"not supported predictor {one(_PREDICTOR, 1)} in {path}")
    width, height = one(_WIDTH, 0), one(_HEIGHT, 0)
    blocks = _BLOCK_OFFSETS in tags
    size = (one(_BLOCK_WIDTH, 0), one(_BLOCK_HEIGHT, 0)) if blocks else (width, min(height, one(_STRIP_ROWS, height)))
    scale, tie = tags.get(_PIXEL_SCALE, (1.0, 1.0, 0.0)), tags.get(_TIE_POINT, (0.0,) * 6)
    keys = tags.get(_GEO_KEYS, ())
    named = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    code = named.get(_PROJECTED_KEY, named.get(_GEOGRAPHIC_KEY))
    text = tags[_NO_DATA][0].split(b"\0")[0].strip() if _NO_DATA in tags else b""
    return Header(
        width, height, one(_SAMPLES, 1), np.dtype(f"{order}{kind}{bits // 8}"), one(_COMPRESSION, 1), one(_PREDICTOR, 1),
        one(_PLANAR, 1) == 2, size, blocks,
        tags[_BLOCK_OFFSETS if blocks else _STRIP_OFFSETS], tags[_BLOCK_SIZES if blocks else _STRIP_SIZES],
        float(text) if text else None, f"EPSG:{code}" if code else None,
        (tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1]), (scale[0], scale[1]),
    )


def _block(file, header: Header, index: int, rows: int) -> np.ndarray:
    """One strip or block as (rows, columns, samples)."""
    data = file.read_at(header.sizes[index], header.offsets[index])
    if header.compression in _DEFLATE:
        data = zlib.decompress(data)
    samples = 1 if header.separate else header.bands
    cells = np.frombuffer(data, header.dtype, rows * header.block[0] * samples).reshape(rows, header.block[0], samples)
    return np.cumsum(cells, axis=1, dtype=cells.dtype) if header.predictor == 2 else cells


def read_window(path: str, bands: Sequence[int], x: int, y: int, cols: int, rows: int) -> list[np.ndarray]:
    """Cells of a window per band, NaN for NoData and beyond the edge of the image."""
    header = read_header(path)
    out = [np.full((rows, cols), np.nan) for _ in bands]
    bw, bh = header.block
    across, down = -(-header.width // bw), -(-header.height // bh)
    right, bottom = min(x + cols, header.width), min(y + rows, header.height)
    with _open(path) as file:
        for j in range(y // bh, -(-bottom // bh)):
            stored = bh if header.padded else min(bh, header.height - j * bh)
            for i in range(x // bw, -(-right // bw)):
                x0, x1 = max(x, i * bw), min(right, (i + 1) * bw)
                y0, y1 = max(y, j * bh), min(bottom, (j + 1) * bh)
                shared = None if header.separate else _block(file, header, j * across + i, stored)
                for target, b in zip(out, bands):
                    if header.separate:
                        cells = _block(file, header, (b * down + j) * across + i, stored)[..., 0]
                    else:
                        cells = shared[..., b]
                    target[y0 - y : y1 - y, x0 - x : x1 - x] = cells[y0 - j * bh : y1 - j * bh, x0 - i * bw : x1 - i * bw]
    if header.no_data is not None:
        for target in out:
            target[target == header.no_data] = np.nan
    return out


_KEY_TYPE = pa.struct([("col", pa.int32()), ("row", pa.int32())])
_EXTENT_TYPE = pa.struct([(n, pa.float64()) for n in ("xmin", "ymin", "xmax", "ymax")])


def _tile_array(cells: np.ndarray) -> pa.Array:
    """One tile as an Arrow array of length one."""
    rows, cols = cells.shape
    flat = cells.reshape(-1)
    values = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat, mask=np.isnan(flat)))
    return pa.StructArray.from_arrays(
        [pa.array([cols], pa.int32()), pa.array([rows], pa.int32()), values], ["cols", "rows", "cells"]
    )


def read_raster(
    spark: SparkSession,
    path: str,
    bands: Sequence[int] | None = None,
    tile_dims: tuple[int, int] = (256, 256),
    crs: str | None = None,
) -> DataFrame:
    """Files as ``path, spatial_key, crs, extent, band_1, ...``, one row per tile.

    ``bands`` are zero-based indexes, all by default; tile columns are named from one.
    Edge tiles are padded with NoData. ``crs`` replaces what the files say.
    """
    cols, rows = tile_dims
    files = spark.read.format("binaryFile").load(path).select("path")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                header = read_header(name)
                places = [
                    (c, r) for r in range(-(-header.height // rows)) for c in range(-(-header.width // cols))
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * len(places)), pa.array([c for c, _ in places], pa.int32()),
                        pa.array([r for _, r in places], pa.int32()), pa.array([header.bands] * len(places), pa.int32()),
                    ],
                    ["path", "col", "row", "n_bands"],
                )

    planned = files.mapInArrow(windows, "path string, col int, row int, n_bands int")
    if bands is None:
        bands = list(range(planned.agg(F.min("n_bands").alias("n")).first().n))
    chosen = list(bands)
    names = [f"band_{b + 1}" for b in chosen]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                header = read_header(row["path"])
                x, y = row["col"] * cols, row["row"] * rows
                left, top = header.origin[0] + x * header.cell[0], header.origin[1] - y * header.cell[1]
                extent = {
                    "xmin": left, "ymin": top - rows * header.cell[1], "xmax": left + cols * header.cell[0], "ymax": top,
                }
                place = [
                    pa.array([row["path"]]), pa.array([{"col": row["col"], "row": row["row"]}], _KEY_TYPE),
                    pa.array([crs or header.crs], pa.string()), pa.array([extent], _EXTENT_TYPE),
                ]
                tiles = [_tile_array(t) for t in read_window(row["path"], chosen, x, y, cols, rows)]
                yield pa.RecordBatch.from_arrays([*place, *tiles], ["path", KEY, "crs", "extent", *names])

    ddl = f"path string, {KEY} struct<col:int,row:int>, crs string, extent {BOX_DDL}, " + ", ".join(
        f"{n} {TILE_DDL}" for n in names
    )
    # A fixed number of partitions: the rows are small, but the work behind each is not.
    spread = planned.repartition(4 * spark.sparkContext.defaultParallelism, "path", "col", "row")
    return spread.mapInArrow(decode, ddl)
