"""Vector features: feature types by name, their specs, and GeoJSON."""

from __future__ import annotations

import json
import warnings
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakework.functions.curves import curve_ranges, in_ranges, interleave, place, place_of
from lakework.functions.geometry import bbox_during, st_point
from lakework.operators.pyramid import z_key
from lakework.sources import hadoop

FID = "__fid__"
POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RING = T.ArrayType(POINT)

# Attribute types of a feature spec and the Spark types they stand for.
_SPEC_TYPES: dict[str, T.DataType] = {
    "String": T.StringType(),
    "Integer": T.IntegerType(),
    "Long": T.LongType(),
    "Double": T.DoubleType(),
    "Float": T.FloatType(),
    "Boolean": T.BooleanType(),
    "Date": T.TimestampType(),
    "Point": POINT,
    "Polygon": RING,
}
_GEOMETRIES = ("Point", "Polygon")


def spec_to_schema(spec: str) -> T.StructType:
    """``name:String:index=true,*geom:Point:srid=4326`` as a schema; options become metadata."""
    fields = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        name, kind, *options = part.split(":")
        if kind not in _SPEC_TYPES:
            raise ValueError(f"unknown attribute type {kind!r}")
        metadata: dict[str, object] = dict(o.split("=", 1) for o in options)
        if name.startswith("*"):
            name, metadata["default"] = name[1:], "true"
        fields.append(T.StructField(name, _SPEC_TYPES[kind], True, metadata))
    return T.StructType(fields)


def schema_to_spec(schema: T.StructType, name: str | None = None) -> str:
    """The spec of a schema; the first geometry is the default one unless another is marked.

    The feature id is no attribute. ``name`` puts the type name in front.
    """
    kinds = {t.simpleString(): k for k, t in reversed(_SPEC_TYPES.items())}
    kinds["timestamp_ntz"] = "Date"
    fields = [f for f in schema if f.name != FID]
    geometries = [f.name for f in fields if kinds.get(f.dataType.simpleString()) in _GEOMETRIES]
    marked = [f.name for f in fields if f.metadata.get("default") == "true"]
    default = (marked or geometries or [None])[0]
    parts = []
    for f in fields:
        kind = kinds.get(f.dataType.simpleString())
        if kind is None:
            raise ValueError(f"no attribute type for {f.dataType.simpleString()}")
        options = {k: v for k, v in f.metadata.items() if k != "default"}
        if kind in _GEOMETRIES:
            options.setdefault("srid", "4326")
        star = "*" if f.name == default else ""
        parts.append(":".join([f"{star}{f.name}", kind, *[f"{k}={v}" for k, v in options.items()]]))
    text = ",".join(parts)
    return f"{name}={text}" if name else text


def _place(root: str, feature: str) -> str:
    return f"{root.rstrip('/')}/feature={feature}"


def create_feature(spark: SparkSession, root: str, feature: str, spec: str) -> None:
    """Declare a feature type by its spec."""
    hadoop.write_text_once(spark, f"{_place(root, feature)}/_spec", spec)


_BIN, _CELL = "_bin", "_cell"
_BITS = 20  # of each of x, y and the time within its bin
BOUNDS = (-180.0, -90.0, 180.0, 90.0)
WEEK = 7 * 24 * 3600


def write_features(
    df: DataFrame, root: str, feature: str, create: bool = False, time: str | None = None,
    bounds: tuple[float, float, float, float] = BOUNDS, period: int = WEEK,
) -> None:
    """Append features to a type that exists; ``create`` declares it from the frame first.

    Features without an id get a random one. Rows are ranged by the Z key of the point, so
    every file covers a small box and box filters skip the others by their statistics. With
    ``time``, a column that the type then keeps as its index, they are ranged by place and time
    instead: by bins of ``period`` seconds, and within a bin by a curve over x, y and the time,
    whose key is stored. Place outside ``bounds`` counts as their edge.
    """
    spark = df.sparkSession
    if not hadoop.exists(spark, f"{_place(root, feature)}/_spec"):
        if not create:
            raise FileNotFoundError(f"feature type {feature!r} does not exist")
        if time is not None:
            index = {"time": time, "bounds": list(bounds), "period": period}
            hadoop.write_text_once(spark, f"{_place(root, feature)}/_index", json.dumps(index))
        create_feature(spark, root, feature, schema_to_spec(df.schema))
    schema = spec_to_schema(hadoop.read_text(spark, f"{_place(root, feature)}/_spec"))
    index = _index_of(spark, root, feature)
    if time is not None and (index is None or index["time"] != time):
        raise ValueError(f"feature type {feature!r} has no index by {time!r}")
    given = F.col(FID).cast("string") if FID in df.columns else F.lit(None).cast("string")
    rows = df.select(
        F.coalesce(given, F.uuid()).alias(FID),
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema],
    )
    point = _point_of(schema)
    if index is not None:
        keyed = rows.withColumns(_space_time_key(F.col(f"{point}.x"), F.col(f"{point}.y"), F.unix_micros(F.col(index["time"])), index))
        rows = keyed.repartitionByRange(_BIN, _CELL).sortWithinPartitions(_BIN, _CELL)
    elif point:
        rows = rows.withColumn("_z", _point_key(F.col(f"{point}.x"), F.col(f"{point}.y")))
        rows = rows.repartitionByRange("_z").sortWithinPartitions("_z").drop("_z")
    rows.write.mode("append").parquet(_place(root, feature))


def _point_of(schema: T.StructType) -> str | None:
    return next((f.name for f in schema if f.dataType == POINT), None)


def _index_of(spark: SparkSession, root: str, feature: str) -> dict | None:
    path = f"{_place(root, feature)}/_index"
    return json.loads(hadoop.read_text(spark, path)) if hadoop.exists(spark, path) else None


def _space_time_key(x: Column, y: Column, micros: Column, index: dict) -> dict[str, Column]:
    """The bin of a time, and the position of (x, y, time in the bin) on the curve; NULL where one is NULL."""
    (x0, y0, x1, y1), width = index["bounds"], index["period"] * 1_000_000
    bin_ = F.floor(micros / width)
    within = place(F.pmod(micros, F.lit(width)), 0, width, _BITS)
    known = x.isNotNull() & y.isNotNull() & micros.isNotNull()
    cell = interleave([place(x, x0, x1, _BITS), place(y, y0, y1, _BITS), within], _BITS)
    return {_BIN: F.when(known, bin_.cast("int")), _CELL: F.when(known, cell)}


def during_ranges(index: dict, box: tuple[float, float, float, float], first: int, last: int, max_ranges: int = 32):
    """(first bin, last bin, key ranges) that cover a box and the microseconds from ``first`` to ``last``.

    The first and the last bin have ranges of their own, all between them share one set.
    """
    (x0, y0, x1, y1), width = index["bounds"], index["period"] * 1_000_000
    low = [place_of(box[0], x0, x1, _BITS), place_of(box[1], y0, y1, _BITS)]
    high = [place_of(box[2], x0, x1, _BITS), place_of(box[3], y0, y1, _BITS)]
    whole = (0, (1 << _BITS) - 1)
    start, stop = (place_of(t % width, 0, width, _BITS) for t in (first, last))
    a, b = first // width, last // width
    spans = [(a, a, start, stop)] if a == b else [(a, a, start, whole[1]), (a + 1, b - 1, *whole), (b, b, whole[0], stop)]
    return [(u, v, curve_ranges((*low, s), (*high, e), _BITS, max_ranges)) for u, v, s, e in spans if u <= v]


def read_during(
    spark: SparkSession, root: str, feature: str, xmin: float, ymin: float, xmax: float, ymax: float, t1: str, t2: str, max_ranges: int = 32
) -> DataFrame:
    """The features of an indexed type in a box, edges included, strictly between two instants.

    Bins and key ranges are compared in the scan, so files and row groups elsewhere in place or time
    are skipped; the features' own place and time decide what is left.
    """
    index = _index_of(spark, root, feature)
    if index is None:
        raise ValueError(f"feature type {feature!r} has no index by place and time")
    schema = spec_to_schema(hadoop.read_text(spark, f"{_place(root, feature)}/_spec"))
    stored = T.StructType([T.StructField(FID, T.StringType()), *schema.fields, T.StructField(_BIN, T.IntegerType()), T.StructField(_CELL, T.LongType())])
    rows = spark.read.schema(stored).parquet(_place(root, feature))
    first, last = spark.range(1).select(*(F.unix_micros(F.lit(t).cast("timestamp")) for t in (t1, t2))).first()
    if first is None or last is None or first >= last or xmin > xmax or ymin > ymax:
        near = rows.where(F.lit(False))
    else:
        spans = during_ranges(index, (xmin, ymin, xmax, ymax), first, last, max_ranges)
        near = rows.where(reduce(or_, [F.col(_BIN).between(a, b) & in_ranges(F.col(_CELL), ranges) for a, b, ranges in spans]))
    return bbox_during(near, xmin, ymin, xmax, ymax, t1, t2, _point_of(schema), index["time"]).drop(_BIN, _CELL)


def _point_key(x: Column, y: Column) -> Column:
    """Z key of a point on a grid of a thousandth of a unit, with zero on a coarse line of the curve.

    What lies outside the grid counts as its edge.
    """
    def place(v: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit((1 << 31) - 1), F.floor((v + (1 << 20)) * 1000).cast("long")))

    return F.coalesce(z_key(place(x), place(y)), F.lit(-1))


def read_features(spark: SparkSession, root: str, feature: str) -> DataFrame:
    """The features of a type: id, attributes, geometry."""
    path = _place(root, feature)
    if not hadoop.exists(spark, f"{path}/_spec"):
        raise FileNotFoundError(f"feature type {feature!r} does not exist")
    schema = spec_to_schema(hadoop.read_text(spark, f"{path}/_spec"))
    full = T.StructType([T.StructField(FID, T.StringType(), True), *schema.fields])
    return spark.read.schema(full).parquet(path)


_BROKEN = "_broken"


def _json_values(spark: SparkSession, path: str, schema: T.StructType, strict: bool) -> DataFrame:
    """The JSON values of every file, each with its own layout: one value in all, or one a line.

    A file whose first line is a whole value with a type has one a line. Any other is one value if
    it parses as such, and else lines of which the first is broken. The driver sees one row of counts.
    """
    kept = T.StructType([*schema.fields, T.StructField(_BROKEN, T.StringType())])
    read = spark.read.schema(kept).option("columnNameOfCorruptRecord", _BROKEN)
    place, columns = F.col("_metadata.file_path").alias("_file"), [f.name for f in schema]
    lines = read.json(path).select("*", place, F.col("_metadata.file_block_start").alias("_at"))
    numbered = lines.withColumn("_line", F.struct("_at", F.monotonically_increasing_id()))
    files = numbered.groupBy("_file").agg(
        F.min_by(F.col(_BROKEN).isNull() & F.col("type").isNotNull(), "_line").alias("whole"), F.count_if(F.col(_BROKEN).isNotNull()).alias("broken")
    )
    once = read.json(path, multiLine=True).select("*", place).where(F.col(_BROKEN).isNull() & F.col("type").isNotNull())
    once = once.join(files.where("NOT whole").select("_file"), "_file", "left_semi")
    apart = once.select("_file")

    def counts(files: DataFrame):
        faulty = F.col("broken") > 0
        return files.agg(
            F.count_if(~F.col("whole")).alias("others"), F.sum("broken").alias("lines"), F.count_if(faulty).alias("files"),
            F.min(F.when(faulty, F.col("_file"))).alias("one"),
        ).first()

    found = counts(files)
    mixed = found.others > 0
    if mixed:
        found = counts(files.join(apart, "_file", "left_anti"))
    if found.lines:
        said = f"{found.lines} lines in {found.files} files are no JSON, as in {found.one}"
        if strict:
            raise ValueError(said)
        warnings.warn(f"{said}; they are left out", stacklevel=3)
    values = lines.where(F.col(_BROKEN).isNull())
    if not mixed:
        return values.select(columns)
    return values.join(apart, "_file", "left_anti").select(columns).unionAll(once.select(columns))


def read_geojson(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Features of GeoJSON: a FeatureCollection per file, or one feature per line.

    ``id`` (of the feature, or of its properties), ``type`` of the geometry, ``geom`` the
    outer ring of a polygon, ``polygons`` all polygons with all their rings (holes follow
    the outer one), ``points`` the positions of points and lines, ``geometry`` its JSON text
    and ``properties`` all properties as text. Each file is told apart by itself. A collection
    over several lines is one JSON value, so a file of it is read by one task; large sets come as
    lines. Lines that are no JSON are counted in a warning and left out, or raise if ``strict``.
    """
    position = T.ArrayType(T.DoubleType())
    ring = T.ArrayType(position)
    rings = T.ArrayType(ring)
    geometry = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])
    feature = T.StructType(
        [
            T.StructField("id", T.StringType()), T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
            T.StructField("geometry", T.StringType()),
        ]
    )
    schema = T.StructType([*feature.fields, T.StructField("type", T.StringType()), T.StructField("features", T.ArrayType(feature))])
    one = F.array(F.struct("id", "properties", "geometry"))
    read = _json_values(spark, path, schema, strict)
    features = read.select(F.explode(F.coalesce("features", F.when(F.col("type") == "Feature", one))).alias("f"))
    parsed = features.select("f.id", "f.properties", F.col("f.geometry").alias("geometry"), F.from_json("f.geometry", geometry).alias("g"))
    kind, text = F.col("g.type"), F.col("g.coordinates")

    def points(ring: Column) -> Column:
        return F.transform(ring, lambda p: st_point(F.get(p, F.lit(0)), F.get(p, F.lit(1))))

    def polygon(value: Column) -> Column:
        return F.transform(value, points)

    polygons = F.when(kind == "Polygon", F.array(polygon(F.from_json(text, rings)))).when(
        kind == "MultiPolygon", F.transform(F.from_json(text, T.ArrayType(rings)), polygon)
    )
    spots = (
        F.when(kind == "Point", points(F.array(F.from_json(text, position))))
        .when(kind.isin("MultiPoint", "LineString"), points(F.from_json(text, ring)))
        .when(kind == "MultiLineString", F.flatten(polygon(F.from_json(text, rings))))
    )
    return parsed.select(
        F.coalesce(F.try_element_at("properties", F.lit("id")), "id").try_cast("long").alias("id"),
        kind.alias("type"), F.get(F.get(polygons, F.lit(0)), F.lit(0)).alias("geom"),
        polygons.alias("polygons"), spots.alias("points"), "geometry", "properties",
    )
