"""Points, boxes, rings and coordinate systems as native columns.

A point is ``struct<x,y>``, a box ``struct<xmin,ymin,xmax,ymax>`` and a polygon a
closed ring ``array<struct<x,y>>``. Predicates expand to plain comparisons, which
Catalyst pushes to the scan wherever the coordinates are stored columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Radius of the Web-Mercator sphere and metres per degree on it.
EARTH_RADIUS = 6378137.0
MERCATOR_LIMIT = math.pi * EARTH_RADIUS
MERCATOR_LATITUDE = math.degrees(2 * math.atan(math.exp(math.pi)) - math.pi / 2)
# The WGS84 ellipsoid and the scale on a UTM central meridian.
WGS84_FLATTENING = 1 / 298.257223563
UTM_SCALE = 0.9996
UTM_FALSE_EASTING = 500000.0
UTM_FALSE_NORTHING_SOUTH = 10000000.0

POINT_DDL = "struct<x:double,y:double>"
BOX_DDL = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"
RING_DDL = f"array<{POINT_DDL}>"


def _col(value: Column | str | float | int) -> Column:
    if isinstance(value, str):
        return F.col(value)
    return value if isinstance(value, Column) else F.lit(float(value))


def st_point(x, y) -> Column:
    return F.struct(_col(x).cast("double").alias("x"), _col(y).cast("double").alias("y"))


def st_make_box2d(p1: Column, p2: Column) -> Column:
    """The box spanned by two opposite corners, in any order."""
    return make_box(
        F.least(p1["x"], p2["x"]),
        F.least(p1["y"], p2["y"]),
        F.greatest(p1["x"], p2["x"]),
        F.greatest(p1["y"], p2["y"]),
    )


def make_box(xmin, ymin, xmax, ymax) -> Column:
    return F.struct(
        _col(xmin).cast("double").alias("xmin"),
        _col(ymin).cast("double").alias("ymin"),
        _col(xmax).cast("double").alias("xmax"),
        _col(ymax).cast("double").alias("ymax"),
    )


def ring_of(points: list[tuple[float, float]]) -> Column:
    """A literal polygon; the ring is closed when the last point is not the first."""
    closed = list(points) if points[0] == points[-1] else [*points, points[0]]
    return F.array(*[st_point(float(x), float(y)) for x, y in closed])


def st_contains(area: Column | str, point: Column | str, kind: str = "box") -> Column:
    """True where the point lies inside the area; the boundary is outside.

    ``kind`` is ``box`` or ``polygon``, the shape of ``area``.
    """
    area, point = _col(area), _col(point)
    if kind == "box":
        return (
            (point["x"] > area["xmin"])
            & (point["x"] < area["xmax"])
            & (point["y"] > area["ymin"])
            & (point["y"] < area["ymax"])
        )
    if kind != "polygon":
        raise ValueError(f"unknown area kind {kind!r}")
    return _inside_ring(area, point["x"], point["y"])


def ring_edges(ring: Column) -> Column:
    """The edges of a ring as ``array<struct<p,q>>``, from each point to the next."""
    starts = F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0)))
    ends = F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0)))
    return F.zip_with(starts, ends, lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def inside_edges(edges: Column, x: Column, y: Column) -> Column:
    """Even-odd rule over edges, minus the points on an edge.

    A point's ray runs to larger x, so edges wholly to its left, above or below it may be left out.
    """

    def test(e: Column) -> Column:
        p, q = e["p"], e["q"]
        side = (q["x"] - p["x"]) * (y - p["y"]) - (q["y"] - p["y"]) * (x - p["x"])
        upward = q["y"] > p["y"]
        crossed = ((p["y"] > y) != (q["y"] > y)) & ((upward & (side > 0)) | (~upward & (side < 0)))
        touches = (
            (side == 0)
            & x.between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"]))
            & y.between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))
        )
        return F.struct(crossed.alias("crossed"), touches.alias("touches"))

    # One pass: a negative count marks a touched edge.
    crossings = F.aggregate(
        F.transform(edges, test),
        F.lit(0),
        lambda n, e: F.when((n < 0) | e["touches"], F.lit(-1)).otherwise(n + e["crossed"].cast("int")),
    )
    return (crossings > 0) & (crossings % 2 == 1)


def _inside_ring(ring: Column, x: Column, y: Column) -> Column:
    return inside_edges(ring_edges(ring), x, y)


def st_contains_polygon(points: list[tuple[float, float]], point: Column | str) -> Column:
    """Containment in a literal polygon, with its bounding box as a cheap first test.

    The box comparisons come first and are pushed to stored coordinates, so the
    ring is walked only for the rows near the polygon.
    """
    point = _col(point)
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    box = (
        (point["x"] > F.lit(float(min(xs))))
        & (point["x"] < F.lit(float(max(xs))))
        & (point["y"] > F.lit(float(min(ys))))
        & (point["y"] < F.lit(float(max(ys))))
    )
    return box & _inside_ring(ring_of(points), point["x"], point["y"])


def st_buffer_point(point: Column | str, metres, segments: int = 32) -> Column:
    """A closed ring of ``segments`` vertices at a distance in metres, for lon/lat points."""
    point, metres = _col(point), _col(metres)
    dy = F.degrees(metres / EARTH_RADIUS)
    dx = F.degrees(metres / (F.cos(F.radians(point["y"])) * EARTH_RADIUS))

    def vertex(i: Column) -> Column:
        angle = (i % segments) * (2 * math.pi / segments)
        return st_point(point["x"] + dx * F.cos(angle), point["y"] + dy * F.sin(angle))

    return F.transform(F.sequence(F.lit(0), F.lit(segments)), vertex)


def st_geometry(extent: Column | str) -> Column:
    """The closed ring around an extent."""
    e = _col(extent)
    return F.array(
        st_point(e["xmin"], e["ymin"]),
        st_point(e["xmin"], e["ymax"]),
        st_point(e["xmax"], e["ymax"]),
        st_point(e["xmax"], e["ymin"]),
        st_point(e["xmin"], e["ymin"]),
    )


def st_extent(ring: Column | str) -> Column:
    """The bounding box of a ring."""
    xs = F.transform(_col(ring), lambda p: p["x"])
    ys = F.transform(_col(ring), lambda p: p["y"])
    return make_box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def _xy_text(p: Column) -> Column:
    return F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))


def st_as_text(geometry: Column | str, kind: str = "point") -> Column:
    """Well-known text of a point or polygon."""
    g = _col(geometry)
    if kind == "point":
        return F.concat(F.lit("POINT ("), _xy_text(g), F.lit(")"))
    if kind == "polygon":
        return F.concat(F.lit("POLYGON (("), F.array_join(F.transform(g, _xy_text), ", "), F.lit("))"))
    raise ValueError(f"unknown geometry kind {kind!r}")


def st_geom_from_text(text: Column | str, kind: str = "point") -> Column:
    """Parse well-known text; text of another kind gives NULL."""
    t = _col(text)

    def parse(pair: Column) -> Column:
        parts = F.split(F.trim(pair), r"\s+")
        return st_point(F.get(parts, F.lit(0)).cast("double"), F.get(parts, F.lit(1)).cast("double"))

    if kind == "point":
        pattern = r"(?i)^\s*POINT\s*\(([^()]*)\)\s*$"
        return F.when(t.rlike(pattern), parse(F.regexp_extract(t, pattern, 1)))
    if kind == "polygon":
        pattern = r"(?i)^\s*POLYGON\s*\(\s*\(([^()]*)\)\s*\)\s*$"
        return F.when(t.rlike(pattern), F.transform(F.split(F.regexp_extract(t, pattern, 1), ","), parse))
    raise ValueError(f"unknown geometry kind {kind!r}")


def _to_lonlat(x: Column, y: Column, crs: str) -> tuple[Column, Column]:
    if crs == "EPSG:4326":
        return x, y
    if crs == "EPSG:3857":
        lon = F.degrees(x / EARTH_RADIUS)
        lat = F.degrees(2 * F.atan(F.exp(y / EARTH_RADIUS)) - math.pi / 2)
        return lon, lat
    return _utm_inverse(x, y, *_utm_zone(crs))


def _from_lonlat(lon: Column, lat: Column, crs: str) -> tuple[Column, Column]:
    if crs == "EPSG:4326":
        return lon, lat
    if crs == "EPSG:3857":
        x = F.radians(lon) * EARTH_RADIUS
        y = F.ln(F.tan(math.pi / 4 + F.radians(lat) / 2)) * EARTH_RADIUS
        return x, y
    return _utm_forward(lon, lat, *_utm_zone(crs))


def _utm_zone(crs: str) -> tuple[int, bool]:
    code = crs.removeprefix("EPSG:")
    if len(code) == 5 and code[:3] in ("326", "327") and 1 <= int(code[3:]) <= 60:
        return int(code[3:]), code[:3] == "327"
    raise ValueError(f"not supported CRS {crs!r}")


def _series() -> tuple[float, list[float], list[float]]:
    """Rectifying radius and the forward and inverse series of the transverse Mercator projection."""
    n = WGS84_FLATTENING / (2 - WGS84_FLATTENING)
    radius = EARTH_RADIUS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16,
        13 * n**2 / 48 - 3 * n**3 / 5,
        61 * n**3 / 240,
    ]
    inverse = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96,
        n**2 / 48 + n**3 / 15,
        17 * n**3 / 480,
    ]
    return radius, forward, inverse


def _utm_forward(lon: Column, lat: Column, zone: int, south: bool) -> tuple[Column, Column]:
    radius, forward, _ = _series()
    e = math.sqrt(WGS84_FLATTENING * (2 - WGS84_FLATTENING))
    lam = F.radians(lon - (zone * 6 - 183))
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, c in enumerate(forward, start=1):
        east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    offset = UTM_FALSE_NORTHING_SOUTH if south else 0.0
    return UTM_FALSE_EASTING + UTM_SCALE * radius * east, offset + UTM_SCALE * radius * north


def _utm_inverse(x: Column, y: Column, zone: int, south: bool) -> tuple[Column, Column]:
    radius, _, inverse = _series()
    e2 = WGS84_FLATTENING * (2 - WGS84_FLATTENING)
    offset = UTM_FALSE_NORTHING_SOUTH if south else 0.0
    xi = (y - offset) / (UTM_SCALE * radius)
    eta = (x - UTM_FALSE_EASTING) / (UTM_SCALE * radius)
    xi0, eta0 = xi, eta
    for j, c in enumerate(inverse, start=1):
        xi0 = xi0 - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta0 = eta0 - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi0) / F.cosh(eta0))
    # Conformal to geodetic latitude, by the series in e^2.
    lat = (
        chi
        + (e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360) * F.sin(2 * chi)
        + (7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520) * F.sin(4 * chi)
        + (7 * e2**3 / 120 + 81 * e2**4 / 1120) * F.sin(6 * chi)
        + (4279 * e2**4 / 161280) * F.sin(8 * chi)
    )
    lon = F.degrees(F.atan2(F.sinh(eta0), F.cos(xi0))) + (zone * 6 - 183)
    return lon, F.degrees(lat)


def reproject(x, y, src: str, dst: str) -> tuple[Column, Column]:
    """Coordinates in another CRS: EPSG:4326, EPSG:3857 and the UTM zones 326zz and 327zz."""
    x, y = _col(x), _col(y)
    if src == dst:
        return x, y
    return _from_lonlat(*_to_lonlat(x, y, src), dst)


def reproject_extent(extent: Column | str, src: str, dst: str) -> Column:
    """The box around the four reprojected corners and side midpoints."""
    e = _col(extent)
    if src == dst:
        return e
    low, high = e["ymin"], e["ymax"]
    if src == "EPSG:4326" and dst == "EPSG:3857":
        # The square of Web Mercator ends there; the poles themselves lie at infinity.
        low, high = (F.greatest(F.lit(-MERCATOR_LATITUDE), F.least(F.lit(MERCATOR_LATITUDE), y)) for y in (low, high))
    mx, my = (e["xmin"] + e["xmax"]) / 2, (low + high) / 2
    xs, ys = [], []
    for px in (e["xmin"], mx, e["xmax"]):
        for py in (low, my, high):
            qx, qy = reproject(px, py, src, dst)
            xs.append(qx)
            ys.append(qy)
    return make_box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def bbox_during(
    df: DataFrame,
    xmin: float,
    ymin: float,
    xmax: float,
    ymax: float,
    t1: str,
    t2: str,
    geom: str = "geom",
    time: str = "dtg",
) -> DataFrame:
    """Features whose point is in a box, edges included, strictly between two instants."""
    return df.where(
        F.col(f"{geom}.x").between(xmin, xmax)
        & F.col(f"{geom}.y").between(ymin, ymax)
        & (F.col(time) > F.lit(t1).cast("timestamp"))
        & (F.col(time) < F.lit(t2).cast("timestamp"))
    )


# Even-odd rule over the edges of the ring ``r``; -1 marks a point on an edge, which is outside.
_RING_CONTAINS = """
(aggregate(
  zip_with(slice(r, 1, size(r) - 1), slice(r, 2, size(r) - 1), (a, b) -> named_struct('a', a, 'b', b,
    's', (b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x))),
  0, (n, e) -> CASE
    WHEN n < 0 OR e.s = 0 AND p.x BETWEEN least(e.a.x, e.b.x) AND greatest(e.a.x, e.b.x)
      AND p.y BETWEEN least(e.a.y, e.b.y) AND greatest(e.a.y, e.b.y) THEN -1
    WHEN (e.a.y > p.y) <> (e.b.y > p.y) AND (e.b.y > e.a.y AND e.s > 0 OR e.b.y <= e.a.y AND e.s < 0) THEN n + 1
    ELSE n END, n -> n > 0 AND n % 2 = 1))
"""


def register_sql_functions(spark: SparkSession) -> None:
    """Make the spatial and tile functions callable from SQL text.

    They are SQL functions: Catalyst inlines their bodies, so a predicate such as
    ``st_contains(st_make_box2d(...), geom)`` still reaches the scan as comparisons.
    """
    tile = "struct<cols:int,rows:int,cells:array<double>>"
    bodies = {
        "st_point(x DOUBLE, y DOUBLE)": (POINT_DDL, "named_struct('x', x, 'y', y)"),
        f"st_make_box2d(p {POINT_DDL}, q {POINT_DDL})": (
            BOX_DDL,
            "named_struct('xmin', least(p.x, q.x), 'ymin', least(p.y, q.y),"
            " 'xmax', greatest(p.x, q.x), 'ymax', greatest(p.y, q.y))",
        ),
        f"st_geometry(e {BOX_DDL})": (
            RING_DDL,
            "array(named_struct('x', e.xmin, 'y', e.ymin), named_struct('x', e.xmin, 'y', e.ymax),"
            " named_struct('x', e.xmax, 'y', e.ymax), named_struct('x', e.xmax, 'y', e.ymin),"
            " named_struct('x', e.xmin, 'y', e.ymin))",
        ),
        f"st_extent(r {RING_DDL})": (
            BOX_DDL,
            "named_struct('xmin', array_min(transform(r, p -> p.x)), 'ymin', array_min(transform(r, p -> p.y)),"
            " 'xmax', array_max(transform(r, p -> p.x)), 'ymax', array_max(transform(r, p -> p.y)))",
        ),
        f"st_contains(b {BOX_DDL}, p {POINT_DDL})": (
            "BOOLEAN",
            "p.x > b.xmin AND p.x < b.xmax AND p.y > b.ymin AND p.y < b.ymax",
        ),
        f"st_as_text(p {POINT_DDL})": (
            "STRING",
            "concat('POINT (', cast(p.x AS string), ' ', cast(p.y AS string), ')')",
        ),
        f"st_buffer_point(p {POINT_DDL}, metres DOUBLE)": (
            RING_DDL,
            "transform(sequence(0, 32), i -> named_struct("
            f"'x', p.x + degrees(metres / (cos(radians(p.y)) * {EARTH_RADIUS})) * cos((i % 32) * {math.pi / 16}),"
            f"'y', p.y + degrees(metres / {EARTH_RADIUS}) * sin((i % 32) * {math.pi / 16})))",
        ),
        f"st_tile_sum(t {tile})": (
            "DOUBLE",
            "aggregate(t.cells, cast(0 AS double), (s, x) -> s + coalesce(x, cast(0 AS double)))",
        ),
        f"st_no_data_cells(t {tile})": ("INT", "size(filter(t.cells, x -> x IS NULL))"),
        f"st_mask(t {tile}, m {tile})": (
            tile,
            "named_struct('cols', t.cols, 'rows', t.rows, 'cells',"
            " zip_with(t.cells, m.cells, (x, y) -> CASE WHEN y IS NOT NULL THEN x END))",
        ),
        f"st_local_less(t {tile}, bound DOUBLE)": (
            tile,
            "named_struct('cols', t.cols, 'rows', t.rows, 'cells', transform(t.cells, x -> cast(x < bound AS double)))",
        ),
        f"st_rgb_composite(r {tile}, g {tile}, b {tile})": (
            tile,
            "named_struct('cols', r.cols, 'rows', r.rows, 'cells',"
            " zip_with(zip_with(r.cells, g.cells, (x, y) -> CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN"
            " floor(least(greatest(x, 0D), 255D)) * 65536 + floor(least(greatest(y, 0D), 255D)) * 256 END),"
            " b.cells, (h, z) -> CASE WHEN z IS NOT NULL THEN cast(h + floor(least(greatest(z, 0D), 255D)) AS double) END))",
        ),
        f"st_log(t {tile})": (
            tile,
            "named_struct('cols', t.cols, 'rows', t.rows, 'cells',"
            " transform(t.cells, x -> CASE WHEN x > 0 THEN ln(x) END))",
        ),
    }
    # Two names are usual without the underscore as well; SQL ignores the case.
    for name, usual in (("st_make_box2d", "st_makeBox2d"), ("st_buffer_point", "st_bufferPoint")):
        signature = next(s for s in bodies if s.startswith(f"{name}("))
        bodies[signature.replace(name, usual)] = bodies[signature]
    # Signatures of the same name differ by type, so these have names of their own, as has the polygon.
    bodies[f"st_contains_polygon(r {RING_DDL}, p {POINT_DDL})"] = ("BOOLEAN", _RING_CONTAINS)
    bodies[f"st_tile(t {tile})"] = (tile, "t")
    # A table function: with LATERAL the cells of every tile are rows, and Spark's own aggregates work on them.
    bodies[f"st_explode_tile(t {tile})"] = (
        "TABLE (column_index INT, row_index INT, value DOUBLE)",
        "SELECT CAST(pos % t.cols AS INT), CAST(pos DIV t.cols AS INT), col FROM posexplode(t.cells)",
    )
    operators = {"add": "x + y", "subtract": "x - y", "multiply": "x * y", "divide": "try_divide(x, y)"}
    for name, expression in operators.items():
        bodies[f"st_local_{name}(a {tile}, b {tile})"] = (
            tile,
            "named_struct('cols', a.cols, 'rows', a.rows, 'cells',"
            f" zip_with(a.cells, b.cells, (x, y) -> {expression}))",
        )
        bodies[f"st_local_{name}_scalar(a {tile}, y DOUBLE)"] = (
            tile,
            f"named_struct('cols', a.cols, 'rows', a.rows, 'cells', transform(a.cells, x -> {expression}))",
        )
    for signature, (returns, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {returns} RETURN {body}")
