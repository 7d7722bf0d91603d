"""Vector queries over points made of customers and events."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakework.functions import geometry
from lakework.plans import frames
from lakework.plans.frames import POINTS
from lakework.plans.registry import query, table
from lakework.session import scratch_dir
from lakework.sources import features


def event_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a feature with a time and a place."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("__fid__"), F.col("event_type").alias("name"),
        F.col("ts").cast("timestamp").alias("dtg"),
        geometry.st_point(
            F.expr("CAST(event_id * 7919 % 3600 AS DOUBLE) / 10 - 180"),
            F.expr("CAST(event_id * 104729 % 1700 AS DOUBLE) / 10 - 85"),
        ).alias("geom"),
    )


_EVENTS = """
SELECT CAST(event_id AS VARCHAR) AS __fid__, event_type AS name, ts AS dtg, CAST(event_id * 7919 % 3600 AS DOUBLE) / 10 - 180 AS x,
       CAST(event_id * 104729 % 1700 AS DOUBLE) / 10 - 85 AS y FROM events
"""


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.customer_points(spark, sf_dir).withColumn("geom", geometry.st_point("x", "y"))


@query("points_in_box", f"SELECT c_custkey, x, y FROM ({POINTS}) WHERE x > -60 AND x < 75 AND y > -10 AND y < 55")
def _(spark, sf_dir):
    box = geometry.st_make_box2d(geometry.st_point(75, -10), geometry.st_point(-60, 55))
    return _points(spark, sf_dir).where(geometry.st_contains(box, "geom")).select("c_custkey", "geom.x", "geom.y")


@query("points_in_box_sql_text", f"SELECT c_custkey, x, y FROM ({POINTS}) WHERE x > -60 AND x < 75 AND y > -10 AND y < 55")
def _(spark, sf_dir):
    geometry.register_sql_functions(spark)
    _points(spark, sf_dir).createOrReplaceTempView("customer_points")
    return spark.sql(
        "SELECT c_custkey, geom.x, geom.y FROM customer_points"
        " WHERE st_contains(st_make_box2d(st_point(-60, -10), st_point(75, 55)), geom)"
    )


_STAR = [(-100.05, -50.05), (120.05, -40.05), (20.05, 5.05), (90.05, 70.05), (-80.05, 60.05), (-20.05, 10.05)]


def _ring_sql() -> str:
    """Even-odd crossings of the literal ring, summed edge by edge; no point lies on an edge."""
    parts = []
    for (x1, y1), (x2, y2) in zip(_STAR, [*_STAR[1:], _STAR[0]]):
        at = f"({x2 - x1}::DOUBLE) * (y - ({y1})) / ({y2 - y1}::DOUBLE) + ({x1})"
        parts.append(f"CASE WHEN ({y1} > y) <> ({y2} > y) AND x < {at} THEN 1 ELSE 0 END")
    return " + ".join(parts)


@query("points_in_polygon", f"SELECT c_custkey, x, y FROM ({POINTS}) WHERE ({_ring_sql()}) % 2 = 1")
def _(spark, sf_dir):
    inside = geometry.st_contains_polygon(_STAR, "geom")
    return _points(spark, sf_dir).where(inside).select("c_custkey", "geom.x", "geom.y")


@query(
    "point_buffers",
    f"""
SELECT c_custkey, CAST(i AS INTEGER) AS vertex,
       round(x + degrees(1000.0::DOUBLE / (cos(radians(y)) * {geometry.EARTH_RADIUS})) * cos((i % 32) * {2 * math.pi / 32}), 6) + 0 AS vx,
       round(y + degrees(1000.0::DOUBLE / {geometry.EARTH_RADIUS}) * sin((i % 32) * {2 * math.pi / 32}), 6) + 0 AS vy
FROM ({POINTS}), range(0, 33) t(i)
""",
)
def _(spark, sf_dir):
    ring = geometry.st_buffer_point("geom", 1000.0)
    vertices = _points(spark, sf_dir).select("c_custkey", F.posexplode(ring).alias("vertex", "p"))
    return vertices.select(
        "c_custkey", "vertex", (F.round("p.x", 6) + 0).alias("vx"), (F.round("p.y", 6) + 0).alias("vy")
    )


@query(
    "features_bbox_during",
    f"SELECT __fid__, name, x, y FROM ({_EVENTS}) WHERE x BETWEEN -90 AND 60 AND y BETWEEN -40.5 AND 52"
    " AND dtg > TIMESTAMP '2024-01-05 00:00:00' AND dtg < TIMESTAMP '2024-01-20 12:00:00'",
)
def _(spark, sf_dir):
    found = geometry.bbox_during(
        event_features(spark, sf_dir), -90, -40.5, 60, 52, "2024-01-05 00:00:00", "2024-01-20 12:00:00"
    )
    return found.select("__fid__", "name", "geom.x", "geom.y")


@query("feature_store_round_trip", f"SELECT __fid__, name, dtg, x, y FROM ({_EVENTS})")
def _(spark, sf_dir):
    root = scratch_dir(spark, "features")
    features.write_features(event_features(spark, sf_dir), root, "events", create=True)
    stored = features.read_features(spark, root, "events")
    return stored.select("__fid__", "name", F.col("dtg").cast("timestamp_ntz").alias("dtg"), "geom.x", "geom.y")


@query(
    "features_during_by_index",
    f"SELECT __fid__, name, x, y FROM ({_EVENTS}) WHERE x BETWEEN -90 AND 60 AND y BETWEEN -40.5 AND 52"
    " AND dtg > TIMESTAMP '2024-01-05 00:00:00' AND dtg < TIMESTAMP '2024-01-20 12:00:00'",
)
def _(spark, sf_dir):
    """The same box and time, asked of a feature type with an index by place and time."""
    root = scratch_dir(spark, "features")
    features.write_features(event_features(spark, sf_dir), root, "events", create=True, time="dtg", period=24 * 3600)
    found = features.read_during(spark, root, "events", -90, -40.5, 60, 52, "2024-01-05 00:00:00", "2024-01-20 12:00:00")
    return found.select("__fid__", "name", "geom.x", "geom.y")


@query("feature_count", "SELECT 2 * count(*) AS n, 2 * count(DISTINCT event_type) AS names FROM events")
def _(spark, sf_dir):
    """Appended twice without ids: every feature gets one of its own."""
    root = scratch_dir(spark, "features")
    anonymous = event_features(spark, sf_dir).drop("__fid__")
    features.write_features(anonymous, root, "events", create=True)
    features.write_features(anonymous, root, "events")
    stored = features.read_features(spark, root, "events")
    return stored.agg(
        F.count_distinct("__fid__").alias("n"), (2 * F.count_distinct("name")).alias("names")
    )


@query(
    "buffers_to_feature_type",
    f"SELECT c_custkey, CAST(33 AS INTEGER) AS corners, round(y - degrees(500.0::DOUBLE / {geometry.EARTH_RADIUS}), 6) AS ymin FROM ({POINTS})",
)
def _(spark, sf_dir):
    """Points from the store, buffered, written as another type, and read back."""
    root = scratch_dir(spark, "features")
    features.write_features(_points(spark, sf_dir).select("c_custkey", "geom"), root, "places", create=True)
    places = features.read_features(spark, root, "places")
    rings = places.select("c_custkey", geometry.st_buffer_point("geom", 500.0).alias("geom"))
    features.write_features(rings, root, "buffer", create=True)
    stored = features.read_features(spark, root, "buffer")
    return stored.select(
        "c_custkey", F.size("geom").alias("corners"), F.round(geometry.st_extent("geom")["ymin"], 6).alias("ymin")
    )


_SPEC = "name:String,dtg:Date,*geom:Point:srid=4326"


@query("feature_type_from_spec", f"SELECT __fid__, name, x, y, '{_SPEC}' AS spec FROM ({_EVENTS})")
def _(spark, sf_dir):
    """A feature type declared by its spec, filled, and read back with the spec that its columns give."""
    root = scratch_dir(spark, "features")
    features.create_feature(spark, root, "events", _SPEC)
    features.write_features(event_features(spark, sf_dir), root, "events")
    stored = features.read_features(spark, root, "events")
    return stored.select("__fid__", "name", "geom.x", "geom.y", F.lit(features.schema_to_spec(stored.schema)).alias("spec"))


@query(
    "geojson_features",
    "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'Polygon' ELSE 'Point' END AS kind, s_name AS name,"
    " CAST(CASE WHEN s_suppkey % 2 = 0 THEN 4 ELSE 1 END AS INTEGER) AS corners, s_suppkey % 360 - 180.0::DOUBLE AS x FROM supplier",
)
def _(spark, sf_dir):
    """Suppliers as GeoJSON, one feature a line, areas and points in turn, read back as features."""
    path = scratch_dir(spark, "geojson")
    lon, lat = F.expr("CAST(s_suppkey % 360 - 180 AS DOUBLE)"), F.expr("CAST(s_suppkey % 170 - 85 AS DOUBLE)")
    ring = F.array(*[F.array(lon + dx, lat + dy) for dx, dy in ((0.0, 0.0), (0.5, 0.0), (0.5, 0.5), (0.0, 0.0))])
    area = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))
    spot = F.to_json(F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")))
    shape = F.when(F.expr("s_suppkey % 2 = 0"), area).otherwise(spot)
    properties = F.to_json(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))
    line = F.concat(F.lit('{"type":"Feature","properties":'), properties, F.lit(',"geometry":'), shape, F.lit("}"))
    table(spark, sf_dir, "supplier").select(line).write.text(path)
    read = features.read_geojson(spark, path)
    corners = F.coalesce("geom", "points")
    return read.select("id", F.col("type").alias("kind"), F.col("properties")["name"].alias("name"), F.size(corners).alias("corners"), corners[0]["x"].alias("x"))


@query(
    "well_known_text",
    f"SELECT c_custkey, round(x, 6) AS px, round(y, 6) AS py, CAST(33 AS INTEGER) AS corners FROM ({POINTS})",
)
def _(spark, sf_dir):
    points = _points(spark, sf_dir).withColumn("ring", geometry.st_buffer_point("geom", 1000.0))
    texts = points.select(
        "c_custkey", geometry.st_as_text("geom").alias("p"), geometry.st_as_text("ring", "polygon").alias("r")
    )
    back = texts.select(
        "c_custkey", geometry.st_geom_from_text("p").alias("p"), geometry.st_geom_from_text("r", "polygon").alias("r")
    )
    return back.select(
        "c_custkey", F.round("p.x", 6).alias("px"), F.round("p.y", 6).alias("py"), F.size("r").alias("corners")
    )
