import json

import pytest
from pyspark.sql import functions as F

from lakework.functions import geometry as g
from lakework.functions.tiles import TILE_DDL
from lakework.operators import layers, pyramid, resample
from lakework.operators.layers import KEY
from lakework.plans import frames
from lakework.sources import features


def test_boundary_is_outside(spark):
    points = spark.createDataFrame([(0.0, 0.0), (2.0, 2.0), (4.0, 2.0), (2.0, 0.0), (3.9, 3.9)], "x double, y double")
    square = [(0, 0), (4, 0), (4, 4), (0, 4)]
    points = points.withColumn("p", g.st_point("x", "y"))
    box = g.st_make_box2d(g.st_point(4, 0), g.st_point(0, 4))
    inside = [(2.0, 2.0), (3.9, 3.9)]
    for condition in (
        g.st_contains(box, "p"),
        g.st_contains(g.ring_of(square), "p", "polygon"),
        g.st_contains_polygon(square, "p"),
    ):
        assert [tuple(r) for r in points.where(condition).select("x", "y").collect()] == inside


def test_ten_points_in_documented_box(spark):
    rows = [(str(i), 40.0 + i, 50.0 + i) for i in range(10)]
    df = spark.createDataFrame(rows, "name string, x double, y double").withColumn("geom", g.st_point("x", "y"))
    df = df.withColumn("dtg", F.expr("timestamp'2014-01-01 00:00:01' + make_dt_interval(cast(name as int))"))
    box = g.st_make_box2d(g.st_point(35, 45), g.st_point(55, 65))
    assert df.where(g.st_contains(box, "geom")).count() == 10
    found = g.bbox_during(df, 38, 48, 52, 62, "2014-01-01 00:00:00", "2014-01-09 00:00:00")
    assert sorted(r.name for r in found.collect()) == [str(i) for i in range(8)]


def test_buffer_radius_shrinks_with_latitude(spark):
    ring = spark.range(1).select(g.st_buffer_point(g.st_point(40, 50), 10.0).alias("r")).first().r
    assert len(ring) == 33 and ring[0] == ring[-1]
    assert round(ring[0].x, 4) == 40.0001


def test_box_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "points")
    spark.range(10).select(g.st_point(F.col("id"), F.col("id")).alias("geom")).write.parquet(path)
    box = g.st_make_box2d(g.st_point(1, 1), g.st_point(5, 5))
    plan = spark.read.parquet(path).where(g.st_contains(box, "geom"))._jdf.queryExecution().toString()
    assert "GreaterThan(geom.x,1.0)" in plan


def test_well_known_text(spark):
    df = spark.createDataFrame([("POINT (1.5 -2)",), ("POLYGON ((0 0, 1 0, 1 1, 0 0))",), ("nonsense",)], "t string")
    rows = df.select(g.st_geom_from_text("t").alias("p"), g.st_geom_from_text("t", "polygon").alias("r")).collect()
    assert (rows[0].p.x, rows[0].p.y, rows[0].r) == (1.5, -2.0, None)
    assert len(rows[1].r) == 4 and rows[1].p is None
    assert rows[2].p is None and rows[2].r is None


@pytest.mark.parametrize("crs", ["EPSG:3857", "EPSG:32617", "EPSG:32733"])
def test_reprojection_comes_back(spark, crs):
    df = spark.createDataFrame([(-80.0, 38.4), (-78.6, -12.0), (16.2, -33.9)], "x double, y double")
    df = df.where("x < 0" if crs != "EPSG:32733" else "x > 0")
    x, y = g.reproject("x", "y", "EPSG:4326", crs)
    lon, lat = g.reproject(x, y, crs, "EPSG:4326")
    for r in df.select("x", "y", lon.alias("lon"), lat.alias("lat")).collect():
        assert abs(r.x - r.lon) < 1e-8 and abs(r.y - r.lat) < 1e-8


def test_utm_of_a_central_meridian(spark):
    x, y = g.reproject(F.lit(-81.0), F.lit(0.0), "EPSG:4326", "EPSG:32617")
    row = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert abs(row.x - 500000) < 1e-6 and abs(row.y) < 1e-6
    with pytest.raises(ValueError):
        g.reproject(F.lit(0.0), F.lit(0.0), "EPSG:4326", "EPSG:1234")


def one_tile(spark, key, extent, values, name, crs="EPSG:3857"):
    side = int(len(values) ** 0.5)
    ddl = f"{KEY} struct<col:int,row:int>, crs string, extent {g.BOX_DDL}, {name} {TILE_DDL}"
    return spark.createDataFrame([(key, crs, extent, (side, side, values))], ddl)


def test_raster_join_keeps_unmatched_left_tiles(spark):
    left = one_tile(spark, (0, 0), (0.0, 0.0, 2.0, 2.0), [1.0, 2.0, 3.0, 4.0], "a").unionByName(
        one_tile(spark, (9, 9), (90.0, 90.0, 92.0, 92.0), [5.0] * 4, "a")
    )
    right = one_tile(spark, (0, 0), (0.0, 0.0, 1.0, 2.0), [10.0, 20.0, 30.0, 40.0], "b")
    joined = {r[KEY].col: r.b for r in resample.raster_join(left, right).collect()}
    assert joined[9] is None
    # The right tile covers the left half; its cells are half as wide and as high.
    assert joined[0].cells == [20.0, None, 40.0, None]
    assert resample.raster_join(left, right, how="inner").count() == 1
    once = {r[KEY].col: r.b for r in resample.raster_join(left, right, unique=True).collect()}
    assert once == joined


def test_raster_join_with_an_empty_side(spark):
    left = one_tile(spark, (0, 0), (0.0, 0.0, 2.0, 2.0), [1.0] * 4, "a")
    right = one_tile(spark, (0, 0), (0.0, 0.0, 2.0, 2.0), [1.0] * 4, "b")
    assert resample.raster_join(left, right.limit(0)).first().b is None
    assert resample.raster_join(left.limit(0), right).count() == 0


def test_raster_join_is_never_a_nested_loop(spark, sf_dir):
    other = frames.other_grid(spark, sf_dir, (40.0, -12.0), 1.25)
    plan = resample.raster_join(frames.plain_layer(spark, sf_dir), other)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_one_huge_tile_does_not_widen_the_buckets(spark):
    def grid(n, name, value):
        return spark.range(n).select(
            F.struct(F.col("id").cast("int").alias("col"), F.lit(0).alias("row")).alias(KEY), F.lit("EPSG:3857").alias("crs"),
            g.make_box(F.col("id") * 2, F.lit(0.0), F.col("id") * 2 + 2, F.lit(2.0)).alias("extent"),
            F.struct(F.lit(1).alias("cols"), F.lit(1).alias("rows"), F.array(value.cast("double")).alias("cells")).alias(name),
        )

    huge = one_tile(spark, (0, 9), (-4096.0, -4096.0, 8192.0, 8192.0), [-1.0], "b")
    left = grid(600, "a", F.lit(1))
    right = grid(500, "b", F.when(F.col("id") % 2 == 0, F.col("id"))).unionByName(huge)
    rows = resample.raster_join(left, right).select(f"{KEY}.col", F.get("b.cells", F.lit(0)).alias("v")).collect()
    want = {i: (float(i) if i < 500 and i % 2 == 0 else -1.0) for i in range(600)}
    assert {r.col: r.v for r in rows} == want


def test_a_stack_of_sources_on_one_target_settles_by_order(spark):
    left = one_tile(spark, (0, 0), (0.0, 0.0, 2.0, 2.0), [0.0] * 4, "a")
    right = one_tile(spark, (0, 0), (0.0, 0.0, 2.0, 2.0), [0.0] * 4, "b")
    stack = spark.range(300).select(
        F.struct(F.col("id").cast("int").alias("col"), F.lit(0).alias("row")).alias(KEY), F.lit("EPSG:3857").alias("crs"),
        g.make_box(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(2.0)).alias("extent"),
        F.struct(
            F.lit(2).alias("cols"), F.lit(2).alias("rows"),
            F.array(F.when(F.col("id") > 5, F.col("id")).cast("double"), *[F.col("id").cast("double")] * 3).alias("cells"),
        ).alias("b"),
    )
    assert right.schema["b"].dataType.names == stack.schema["b"].dataType.names
    assert resample.raster_join(left, stack).first().b.cells == [6.0, 0.0, 0.0, 0.0]


def test_layers_of_mixed_crs_are_refused(spark):
    left = one_tile(spark, (0, 0), (0.0, 0.0, 2.0, 2.0), [0.0] * 4, "a")
    mixed = left.unionByName(one_tile(spark, (1, 0), (2.0, 0.0, 4.0, 2.0), [0.0] * 4, "a", "EPSG:4326"))
    with pytest.raises(ValueError):
        resample.to_zoomed_layout(mixed)


def test_zoom_keeps_the_detail():
    assert resample.zoom_for(resample.mercator_cell(7, 256), 256) == 7
    assert resample.zoom_for(resample.mercator_cell(7, 256) * 1.01, 256) == 7
    assert resample.zoom_for(resample.mercator_cell(7, 256) * 0.99, 256) == 8


def test_pyramid_parent_averages_data_cells(spark):
    rows = [((0, 0), (2, 2, [1.0, 3.0, None, None])), ((1, 1), (2, 2, [None] * 4))]
    layer = spark.createDataFrame(rows, f"{KEY} struct<col:int,row:int>, v {TILE_DDL}")
    out = pyramid.build_pyramid(layer, max_zoom=1)
    assert out.where("zoom = 0").select("v.cells").first()[0] == [2.0, None, None, None]
    assert out.count() == 3


def test_z_key_interleaves(spark):
    row = spark.range(1).select(pyramid.z_key(F.lit(3), F.lit(5)).alias("z")).first()
    assert row.z == 0b100111


def test_mosaic_resampling_names_are_checked(spark):
    with pytest.raises(ValueError):
        layers.to_raster(one_tile(spark, (0, 0), (0.0, 0.0, 2.0, 2.0), [0.0] * 4, "a"), "a", 4, 4, "cubic")


def test_feature_spec_round_trip():
    spec = "species:String:index=true,seen:Date,count:Integer,*spot:Point:srid=4326"
    schema = features.spec_to_schema(spec)
    assert schema.names == ["species", "seen", "count", "spot"]
    assert features.schema_to_spec(schema) == spec
    assert features.schema_to_spec(schema, "people").startswith("people=")
    with pytest.raises(ValueError):
        features.spec_to_schema("a:Blob")


def test_features_need_their_type_first(spark, tmp_path):
    df = spark.range(3).select(F.col("id"), g.st_point(F.col("id"), F.col("id")).alias("geom"))
    with pytest.raises(FileNotFoundError):
        features.write_features(df, str(tmp_path), "places")
    features.create_feature(spark, str(tmp_path), "places", "id:Long,*geom:Point:srid=4326")
    features.write_features(df, str(tmp_path), "places")
    stored = features.read_features(spark, str(tmp_path), "places")
    assert stored.count() == 3 and stored.select("__fid__").distinct().count() == 3


def test_geojson_polygons(spark, tmp_path):
    path = tmp_path / "zones.geojson"
    ring = "[[0.0,0.0],[4.0,0.0],[4.0,4.0],[0.0,0.0]]"
    feature = '{"type":"Feature","properties":{"id":%d},"geometry":{"type":"Polygon","coordinates":[' + ring + "]}}"
    path.write_text('{"type":"FeatureCollection",\n"features":[\n%s,\n%s\n]}' % (feature % 0, feature % 1))
    rows = features.read_geojson(spark, str(path)).orderBy("id").collect()
    assert [r.id for r in rows] == [0, 1]
    assert [(p.x, p.y) for p in rows[0].geom] == [(0, 0), (4, 0), (4, 4), (0, 0)]


def test_geojson_keeps_holes_parts_and_properties(spark, tmp_path):
    features_ = [
        {"type": "Feature", "properties": {"id": 7, "crop": "rye", "area": 2.5}, "geometry": {"type": "Polygon", "coordinates": [
            [[0, 0], [9, 0], [9, 9], [0, 0]], [[2, 1], [3, 1], [3, 2], [2, 1]]]}},
        {"type": "Feature", "properties": None, "id": "8", "geometry": {"type": "MultiPolygon", "coordinates": [
            [[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]], [[5.2, 5.1], [5.3, 5.1], [5.3, 5.2], [5.2, 5.1]]]]}},
        {"type": "Feature", "properties": {"id": 9}, "geometry": {"type": "LineString", "coordinates": [[1, 2], [3, 4]]}},
        {"type": "Feature", "properties": {"id": 10}, "geometry": {"type": "Point", "coordinates": [1.5, 2.5]}},
        {"type": "Feature", "properties": {"id": 11}, "geometry": None},
    ]
    whole, lines = tmp_path / "whole.geojson", tmp_path / "lines.geojson"
    whole.write_text(json.dumps({"type": "FeatureCollection", "features": features_}, indent=1))
    lines.write_text("\n".join(json.dumps(f) for f in features_))
    for path in (whole, lines):
        rows = {r.id: r for r in features.read_geojson(spark, str(path)).collect()}
        assert sorted(rows) == [7, 8, 9, 10, 11]
        assert [[len(ring) for ring in p] for p in rows[7].polygons] == [[4, 4]] and rows[7].polygons[0][1][1].x == 3
        assert rows[7].properties == {"id": "7", "crop": "rye", "area": "2.5"} and len(rows[7].geom) == 4
        assert [[len(ring) for ring in p] for p in rows[8].polygons] == [[4], [4, 4]]
        assert [(p.x, p.y) for p in rows[9].points] == [(1, 2), (3, 4)] and [(p.x, p.y) for p in rows[10].points] == [(1.5, 2.5)]
        assert rows[11].type is None and rows[11].polygons is None


def test_a_small_box_reads_few_files(spark, tmp_path):
    points = spark.range(40_000).select(
        F.col("id"), g.st_point(F.expr("CAST(id * 7919 % 3600 AS DOUBLE) / 10 - 180"), F.expr("CAST(id * 104729 % 1700 AS DOUBLE) / 10 - 85")).alias("geom")
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        features.write_features(points.repartition(8), str(tmp_path), "places", create=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    stored = features.read_features(spark, str(tmp_path), "places")
    name = F.col("_metadata.file_name")
    box = stored.groupBy(name.alias("f")).agg(F.min("geom.x").alias("x0"), F.max("geom.x").alias("x1"), F.min("geom.y").alias("y0"), F.max("geom.y").alias("y1"))
    files = box.collect()
    met = [f for f in files if f.x0 <= 21 and f.x1 >= 20 and f.y0 <= 41 and f.y1 >= 40]
    assert len(files) >= 6 and 2 * len(met) < len(files)


def test_poles_are_drawn_to_the_edge(spark):
    row = spark.sql("SELECT struct(-180D AS xmin, -90D AS ymin, 180D AS xmax, 90D AS ymax) AS e").select(g.reproject_extent("e", "EPSG:4326", "EPSG:3857").alias("b")).first()
    assert [round(v / g.MERCATOR_LIMIT, 9) for v in row.b] == [-1, -1, 1, 1]


def test_tiles_beyond_the_mercator_square_have_no_place(spark):
    """A tile past the pole, and one that all but ends at the edge, say nothing of the detail."""
    inside = one_tile(spark, (0, 0), (0.0, 0.0, 10.0, 10.0), [1.0, 2.0, 3.0, 4.0], "a", "EPSG:4326")
    sliver = one_tile(spark, (0, 1), (0.0, -95.0, 10.0, 1e-7 - g.MERCATOR_LATITUDE), [5.0] * 4, "a", "EPSG:4326")
    past = one_tile(spark, (0, 2), (0.0, -200.0, 10.0, -190.0), [6.0] * 4, "a", "EPSG:4326")
    want = sorted(resample.to_zoomed_layout(inside, 16).select("zoom", "spatial_key", "a.cells").collect())
    for more in (past, sliver.unionByName(past)):
        assert sorted(resample.to_zoomed_layout(inside.unionByName(more), 16).select("zoom", "spatial_key", "a.cells").collect()) == want
    assert resample.to_zoomed_layout(past, 16).count() == 0


def test_repeated_keys_are_one_tile(spark):
    a = one_tile(spark, (0, 0), (0.0, 0.0, 2.0, 2.0), [1.0, None, 3.0, None], "a").select("spatial_key", "a")
    b = one_tile(spark, (0, 0), (0.0, 0.0, 2.0, 2.0), [None, 2.0, None, None], "a").select("spatial_key", "a")
    both = a.unionByName(b)
    (row,) = pyramid.parent_level(both, 2, 2).collect()
    assert row.a.cells[0] == 2.0
    assert sorted(r.value for r in layers.to_raster(both, "a", 2, 2).collect()) == [1.0, 2.0, 3.0]
    from lakework.operators.cells import focal_mean

    (row,) = focal_mean(both, "a", 1, 2, 2).collect()
    assert row.a.cells == [2.0] * 4


def test_mixed_layers_have_no_metadata(spark):
    a = one_tile(spark, (0, 0), (0.0, 0.0, 2.0, 2.0), [1.0] * 4, "a").withColumn("crs", F.lit("EPSG:4326"))
    with pytest.raises(Exception, match="more than one CRS"):
        layers.layer_metadata(a.unionByName(a.withColumn("crs", F.lit("EPSG:3857")))).collect()


def test_literal_extents_can_be_laid_out(spark):
    tile = one_tile(spark, (0, 0), (0.0, 0.0, 10.0, 10.0), [1.0, 2.0, 3.0, 4.0], "a").select("spatial_key", "a")
    literal = tile.withColumns({"crs": F.lit("EPSG:4326"), "extent": F.expr("named_struct('xmin', 0D, 'ymin', 0D, 'xmax', 10D, 'ymax', 10D)")})
    web = resample.to_zoomed_layout(literal, 16, zoom=3)
    assert web.select(F.explode("a.cells").alias("v")).where("v IS NOT NULL").count() > 4


def test_sql_names_for_scalars_and_polygons(spark):
    from lakework.functions import tiles

    g.register_sql_functions(spark)
    one_tile(spark, (0, 0), (0.0, 0.0, 2.0, 2.0), [1.0, 2.0, None, 4.0], "a").createOrReplaceTempView("scalar_tile")
    row = spark.sql(
        "SELECT st_local_add_scalar(a, 2D).cells AS plus, st_local_divide_scalar(a, 0D).cells AS none, st_tile(a).cells AS same FROM scalar_tile"
    ).first()
    want = spark.table("scalar_tile").select(tiles.st_local_add("a", 2)["cells"].alias("p"), tiles.st_local_divide("a", 0)["cells"].alias("n")).first()
    assert row.plus == want.p == [3.0, 4.0, None, 6.0] and row.none == want.n and row.same == [1.0, 2.0, None, 4.0]
    ring = [(0, 0), (6, 0), (6, 6), (3, 2), (0, 6)]
    points = spark.createDataFrame([(x / 2, y / 2) for x in range(-1, 14) for y in range(-1, 14)], "x double, y double")
    both = points.select(
        g.st_contains(g.ring_of(ring), g.st_point("x", "y"), "polygon").alias("a"),
        F.call_function("st_contains_polygon", g.ring_of(ring), g.st_point("x", "y")).alias("b"),
    )
    assert both.where("a <> b").count() == 0 and both.where("b").count() > 20


def test_sql_functions_equal_the_column_functions(spark):
    from lakework.functions import tiles

    g.register_sql_functions(spark)
    df = one_tile(spark, (0, 0), (0.0, 0.0, 2.0, 4.0), [1.0, 300.0, -5.0, None], "a")
    df.createOrReplaceTempView("one_tile")
    row = spark.sql(
        "SELECT st_local_less(a, 2.0D).cells AS less, st_rgb_composite(a, a, a).cells AS rgb, st_log(a).cells AS log,"
        " st_extent(st_geometry(extent)) AS box, st_contains(st_makeBox2D(st_point(-7, 3), st_point(11, 29)), st_point(2, 17)) AS inside"
        ", size(ST_BufferPoint(st_point(2, 17), 5)) AS corners FROM one_tile"
    ).first()
    want = df.select(
        tiles.st_local_less("a", 2)["cells"].alias("less"), tiles.st_rgb_composite("a", "a", "a")["cells"].alias("rgb"),
        tiles.st_log("a")["cells"].alias("log"), g.st_extent(g.st_geometry("extent")).alias("box"),
    ).first()
    assert (row.less, row.rgb, row.log, row.box) == tuple(want) and row.inside and row.corners == 33


def test_geojson_files_keep_their_own_layout(spark, tmp_path):
    def line(i):
        return json.dumps({"type": "Feature", "id": i, "properties": {"n": i}, "geometry": {"type": "Point", "coordinates": [i, 1]}})

    def pretty(*ids):
        return '{\n"type": "FeatureCollection",\n"features": [\n' + ",\n".join(map(line, ids)) + "\n]\n}\n"

    folder = tmp_path / "mixed set"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join([line(1), "", line(2), '{"type": "Feature", "prop', line(3)]))
    (folder / "b.json").write_text("\n".join(['{"type":', line(4), line(5)]))
    (folder / "c.json").write_text(pretty(6, 7))
    (folder / "d.json").write_text(json.dumps(json.loads(pretty(8, 9))))
    with pytest.warns(UserWarning, match="2 lines in 2 files"):
        assert sorted(r.id for r in features.read_geojson(spark, str(folder)).collect()) == list(range(1, 10))
    with pytest.raises(ValueError, match="2 lines"):
        features.read_geojson(spark, str(folder), strict=True)
    assert sorted(r.id for r in features.read_geojson(spark, str(folder / "c.json"), strict=True).collect()) == [6, 7]
