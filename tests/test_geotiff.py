import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakework.operators import cells, layers
from lakework.operators.layers import KEY
from lakework.sources import geotiff


def write_tiff(path, image, order="<", block=None, strip_rows=5, deflate=False, predictor=1, separate=False, no_data=None, compression=None):
    """A small GeoTIFF of an array (bands, rows, columns), in EPSG:32617 with cells of 30 from (1000, 9000)."""
    bands, height, width = image.shape
    kind = {"u": 1, "i": 2, "f": 3}[image.dtype.kind]
    bw, bh = block or (width, strip_rows)
    segments = []
    planes = [image[b : b + 1] for b in range(bands)] if separate else [image]
    for plane in planes:
        for y in range(0, height, bh):
            for x in range(0, width, bw):
                part = plane[:, y : y + bh, x : x + bw]
                if block:
                    part = np.pad(part, ((0, 0), (0, bh - part.shape[1]), (0, bw - part.shape[2])))
                part = np.moveaxis(part, 0, -1)
                if predictor == 2:
                    part = np.diff(part, axis=1, prepend=np.zeros_like(part[:, :1]))
                data = np.ascontiguousarray(part).astype(image.dtype.newbyteorder(order)).tobytes()
                segments.append(zlib.compress(data) if deflate else data)
    body, offsets = b"", []
    for s in segments:
        offsets.append(8 + len(body))
        body += s
    sizes = [len(s) for s in segments]
    tags = {
        256: ("I", [width]), 257: ("I", [height]), 258: ("H", [image.dtype.itemsize * 8] * bands),
        259: ("H", [compression or (8 if deflate else 1)]), 277: ("H", [bands]), 284: ("H", [2 if separate else 1]),
        317: ("H", [predictor]), 339: ("H", [kind] * bands), 33550: ("d", [30.0, 30.0, 0.0]),
        33922: ("d", [0.0, 0.0, 0.0, 1000.0, 9000.0, 0.0]), 34735: ("H", [1, 1, 0, 1, 3072, 0, 1, 32617]),
    }
    if block:
        tags |= {322: ("I", [bw]), 323: ("I", [bh]), 324: ("I", offsets), 325: ("I", sizes)}
    else:
        tags |= {273: ("I", offsets), 278: ("I", [strip_rows]), 279: ("I", sizes)}
    if no_data is not None:
        tags[42113] = ("s", [no_data.encode() + b"\0"])
    types = {"H": 3, "I": 4, "d": 12, "s": 2}
    start = 8 + len(body)
    extra_at, entries, extra = start + 2 + 12 * len(tags) + 4, b"", b""
    for tag, (code, values) in sorted(tags.items()):
        raw = values[0] if code == "s" else struct.pack(f"{order}{len(values)}{code}", *values)
        count = len(raw) if code == "s" else len(values)
        if len(raw) > 4:
            place, extra = struct.pack(f"{order}I", extra_at + len(extra)), extra + raw
        else:
            place = raw.ljust(4, b"\0")
        entries += struct.pack(f"{order}HHI", tag, types[code], count) + place
    magic = (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, start)
    path.write_bytes(magic + body + struct.pack(f"{order}H", len(tags)) + entries + struct.pack(f"{order}I", 0) + extra)


RNG = np.random.default_rng(3)
VARIANTS = {
    "strips": dict(dtype="uint8"),
    "big endian": dict(dtype="int16", order=">"),
    "blocks": dict(dtype="float32", block=(16, 16)),
    "deflate": dict(dtype="uint16", deflate=True, predictor=2),
    "deflate blocks": dict(dtype="int32", deflate=True, predictor=2, block=(32, 16), order=">"),
    "separate": dict(dtype="float64", separate=True),
}


@pytest.mark.parametrize("variant", sorted(VARIANTS))
def test_layouts_decode(tmp_path, variant):
    options = dict(VARIANTS[variant])
    image = RNG.integers(0, 100, (2, 37, 45)).astype(options.pop("dtype"))
    path = tmp_path / "x.tif"
    write_tiff(path, image, **options)
    got = geotiff.read_window(f"file:{path}", [1, 0], 10, 7, 20, 40)
    for target, b in zip(got, (1, 0)):
        assert np.array_equal(target[:30], image[b, 7:37, 10:30])
        assert np.isnan(target[30:]).all()


def test_raster_of_186_by_169(spark, tmp_path):
    image = RNG.integers(1, 20000, (3, 169, 186)).astype("uint16")
    image[1, 0, :5] = 7
    image[1][image[1] == 0] = 1
    write_tiff(tmp_path / "scene.tif", image, deflate=True, no_data="7")
    raster = geotiff.read_raster(spark, str(tmp_path), bands=[1], tile_dims=(128, 128)).cache()
    assert raster.columns == ["path", KEY, "crs", "extent", "band_2"]
    assert raster.count() == 4
    corner = raster.where(f"{KEY}.col = 1 AND {KEY}.row = 0").first()
    assert corner.crs == "EPSG:32617"
    assert tuple(corner.extent) == (1000 + 128 * 30, 9000 - 128 * 30, 1000 + 256 * 30, 9000)
    known = cells.explode_tiles(raster, ["band_2"]).where("band_2 IS NOT NULL")
    expected = image[1].astype(float)
    missing = int((expected == 7).sum())
    assert missing >= 5 and known.count() == 169 * 186 - missing
    assert known.agg(F.sum("band_2")).first()[0] == expected[expected != 7].sum()
    assert layers.layer_metadata(raster).first().xmax == 1000 + 256 * 30


def test_all_bands_by_default_and_crs_argument(spark, tmp_path):
    write_tiff(tmp_path / "a.tif", RNG.integers(0, 9, (3, 20, 20)).astype("uint8"))
    raster = geotiff.read_raster(spark, str(tmp_path / "a.tif"), tile_dims=(16, 16), crs="EPSG:3857")
    assert [c for c in raster.columns if c.startswith("band")] == ["band_1", "band_2", "band_3"]
    assert raster.select("crs").distinct().collect()[0].crs == "EPSG:3857"


def test_what_is_not_supported_is_said(tmp_path):
    path = tmp_path / "x.tif"
    write_tiff(path, np.zeros((1, 4, 4), "uint8"), compression=5)
    with pytest.raises(ValueError, match="compression 5"):
        geotiff.read_header(f"file:{path}")
    other = tmp_path / "y.tif"
    other.write_bytes(b"not an image at all")
    with pytest.raises(ValueError, match="not a TIFF"):
        geotiff.read_header(f"file:{other}")
