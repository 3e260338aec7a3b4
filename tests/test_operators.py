"""Edge cases that the derived world does not have."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from tidemark.functions import cells, env, geo
from tidemark.operators import climate, cover, graph, lines, ports, routing, sailing
from tidemark.sources import files
from tidemark.streaming import incremental


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_unknown_numbers(spark):
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    r = one(spark, a=env.clean(nan), b=env.clean(inf, 1.0), c=env.clean(F.lit(2.0)), d=env.clean(F.lit(None).cast("double"), 3.0))
    assert tuple(r) == (None, 1.0, 2.0, 3.0)


def test_visibility_limits(spark):
    x = lambda v: F.lit(v).cast("double")
    r = one(spark, clear=env.visibility_m(x(0.0), x(0.0), x(0.0)), humid=env.visibility_m(x(99_999.0), x(0.0), x(0.0)), cloud=env.visibility_m(x(5.0), x(0.0), x(None)), wet=env.visibility_m(x(None), x(-1.0), x(1.0)))
    assert (r.clear, r.humid, r.cloud) == (20_000.0, 10.0, None) and abs(r.wet - 5000 / 1.01) < 1e-9
    odd = one(spark, nan=env.visibility_m(x(float("nan")), x(0.0), x(0.0)), inf=env.visibility_m(x(0.0), x(0.0), x(float("inf"))), rain=env.visibility_m(x(0.0), x(float("inf")), x(0.0)))
    assert tuple(odd) == (20_000.0, None, 20_000.0)


def test_daylight(spark):
    r = one(spark, equator=env.daylight_ratio(F.lit(0.0), F.lit(80)), night=env.daylight_ratio(F.lit(85.0), F.lit(355)), day=env.daylight_ratio(F.lit(85.0), F.lit(172)), summer=env.daylight_ratio(F.lit(51.5), F.lit(172)))
    assert abs(r.equator - 0.505) < 0.003 and r.night == 0.0 and r.day == 1.0 and abs(r.summer * 24 - 16.6) < 0.15


def test_directions(spark):
    east, north = geo.edge_vector(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    r = one(spark, east=F.round(east, 9), north=F.round(north, 9) + 0, none=geo.vector_from(F.lit(None).cast("double"))[0], km=geo.great_circle(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0), 1.0))
    assert (r.east, abs(r.north), r.none) == (-1.0, 0.0, None) and abs(r.km - 3.14159265) < 1e-6


def test_penalties(spark):
    d = lambda v: F.lit(v).cast("double")
    p = env.directional_penalty
    r = one(spark, along=p(d(1), d(0), d(2), d(0)), against=p(d(1), d(0), d(-3), d(0)), none=p(d(1), d(0), d(None), d(1)), still=p(d(1), d(0), d(0), d(0)), dark=env.darkness_penalty(d(0.5), d(None), d(1)), day=env.darkness_penalty(d(1), d(5), d(1)))
    assert tuple(r) == (1.0, 2.0, 1.0, 1.0, 4.5, 0.0)


def test_tiles_and_wkt(spark):
    lng, lat = geo.point_from_wkt(F.lit("Point(-1.5 50.25)"))
    bad = geo.point_from_wkt(F.lit("LINESTRING (1 2)"))[0]
    r = one(spark, lng=lng, lat=lat, bad=bad, x=geo.tile_x(F.lit(0.0), 1), y=geo.tile_y(F.lit(0.0), 1), pole=geo.tile_y(F.lit(90.0), 3), north=F.round(geo.tile_north(F.lit(1), 1), 6))
    assert tuple(r) == (-1.5, 50.25, None, 1, 1, None, 0.0)


def test_cell_bits(spark):
    i = cells.from_hex(F.lit("85283083fffffff"))
    r = one(spark, kids=F.transform(cells.children(i, 6), cells.to_hex), coarser=cells.parent(i, 9), up=F.transform(cells.children(i, 6), lambda c: cells.to_hex(cells.parent(c, 5))))
    assert len(set(r.kids)) == 7 and set(r.up) == {"85283083fffffff"} and r.coarser is None and all(k.startswith("8628308") for k in r.kids)


def test_speed_cases(spark):
    """No length, a current that outweighs the wind, no wind at all."""
    rows = [(1, None, 1.0, 0.0, 0.0), (2, 100.0, 1.0, 0.0, -9.0), (3, 100.0, 0.0, 0.0, 0.0), (4, 0.0, 1.0, 0.0, 0.0)]
    e = spark.createDataFrame(rows, "id int, length_m double, dx double, dy double, s_current_x double")
    for c in [f"{p}_{v}" for p in "st" for v in sailing.ENV] + ["bathymetry", "daylight_ratio", "clear_land"]:
        if c not in e.columns:
            e = e.withColumn(c, F.lit(None).cast("double"))
    out = {r.id: r for r in sailing.sailing(e.crossJoin(sailing.vessels(spark, ["default"]))).collect()}
    inf = float("inf")
    assert (out[1].time_s, out[2].time_s, out[4].time_s) == (inf, inf, inf)
    assert abs(out[3].speed_ms - 0.6 * 0.9) < 1e-9 and out[3].cost == pytest.approx(out[3].time_s * 100) and out[3].route_cost == pytest.approx(out[3].cost * 1000)


def test_labels(spark):
    label = lambda s: sailing.duration_label(F.lit(float(s)))
    r = one(spark, a=label(1800), b=label(86400 + 3600), c=label(2 * 86400))
    assert tuple(r) == ("0.5 hrs", "1 day 1 hr", "2 days 0 hrs")


def test_unreachable_and_unknown_nodes(spark):
    costs = spark.createDataFrame([(1, "v", 1, 2, 5.0, 10.0, 1.0), (1, "v", 3, 4, float("inf"), 10.0, 1.0), (1, "v", 4, 3, 1.0, 1.0, 1.0)], "month int, vessel string, source long, target long, route_cost double, length_m double, time_s double")
    asked = spark.createDataFrame([(1, 1, 2, 1, "v"), (2, 1, 4, 1, "v"), (3, 1, 99, 1, "v"), (4, 2, 2, 1, "v"), (5, 1, 2, 7, "v")], "query_id long, origin long, goal long, month int, vessel string")
    out = {r.query_id: r for r in routing.totals(routing.routes(asked, costs), costs).collect()}
    assert (out[1].reached, out[1].cost, out[1].n_nodes, out[1].total_length_m) == (True, 5.0, 2, 10.0)
    assert not any(out[k].reached for k in (2, 3, 5)) and (out[4].reached, out[4].cost, out[4].n_nodes) == (True, 0.0, 1)


def test_upserts(spark):
    a, b = spark.createDataFrame([(1, "old")], "k int, v string"), spark.createDataFrame([(1, "new"), (2, "new")], "k int, v string")
    assert sorted(map(tuple, graph.keep_existing(a, b, "k").collect())) == [(1, "old"), (2, "new")]


def test_port_names_and_types(spark):
    rows = [("a", "Q12", "Point(1 2)", "x", "port", 1), ("b", "Quay", "Point(1 2)", "x", " port ", 1), ("b", "Later", "Point(9 9)", "y", "ruins", 2), ("c", "C", "nowhere", "x", "port", 1), ("d", None, "Point(1 2)", "x", "unknown", 1), ("e", None, "POINT(1 2)", None, "dock", 1)]
    out = {r.port: r for r in ports.styled(ports.classified(ports.grouped(spark.createDataFrame(rows, "port string, label string, coord string, country string, type string, seq int"), "seq"))).collect()}
    assert set(out) == {"b", "e"} and out["b"].name == "Quay" and out["b"].categories == ["historical", "seaport"] and (out["b"].colour, out["b"].radius) == ("red", 7)


def test_lines(spark):
    pts = lambda *p: F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in p))
    df = spark.range(1).select(F.lit(1).alias("k"), pts((0, 0), (1, 0.001), (2, 0), (2, 2)).alias("line"), pts((0, 0), (1, 1)).alias("short"))
    r = lines.simplified(df, "k", "line", 0.01).first()
    assert [(p.x, p.y) for p in r.line] == [(0, 0), (2, 0), (2, 2)]
    s = df.select(F.size(lines.smoothed(F.col("line"))).alias("n"), F.size(lines.smoothed(F.col("short"))).alias("m"), lines.feature(F.col("short"), F.struct("k")).alias("f")).first()
    assert (s.n, s.m) == (32, 2) and json.loads(s.f)["geometry"]["coordinates"] == [[0.0, 0.0], [1.0, 1.0]]


def test_files(spark, tmp_path):
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"geometry": {"type": "Point", "coordinates": [1.0, 2.0]}, "properties": {"name": "n"}}]}))
    r = files.read_geojson(spark, str(tmp_path / "a.geojson"), "struct<type:string,coordinates:array<double>>", "struct<name:string>").first()
    assert r.geometry.coordinates == [1.0, 2.0] and r.properties.name == "n"
    with sqlite3.connect(tmp_path / "x.gpkg") as db:
        db.executescript("CREATE TABLE gpkg_contents (table_name); INSERT INTO gpkg_contents VALUES ('hexes_r5'), ('edges_r5'); CREATE TABLE hexes_r5 (fid, geom BLOB, h3_id); INSERT INTO hexes_r5 VALUES (1, x'00ff', 'abc'); CREATE TABLE edges_r5 (fid);")
    spark.dataSource.register(files.GeoPackage)
    rows = spark.read.format("geopackage").option("path", str(tmp_path / "x.gpkg")).option("prefix", "hexes").load().collect()
    assert [(r.layer, r.attributes["h3_id"], bytes(r.geometry)) for r in rows] == [("hexes_r5", "abc", b"\x00\xff")]
    assert files.resolution_of("hexes_r7") == 7 and files.resolution_of("hexes") is None
    layer = spark.createDataFrame([(5, "a"), (6, "b")], "resolution int, id string")
    files.write_layer(layer, str(tmp_path / "layers"))
    files.write_layer(layer.where("resolution = 6").withColumn("id", F.lit("c")), str(tmp_path / "layers"))
    assert sorted((r.resolution, r.id) for r in spark.read.parquet(str(tmp_path / "layers")).collect()) == [(5, "a"), (6, "c")]


def test_incremental_runs_add_nothing_twice(spark, tmp_path):
    items = spark.range(10).withColumnRenamed("id", "k")
    path = str(tmp_path / "done")
    work = lambda df: df.withColumn("v", F.col("k") * 2)
    assert incremental.append_new(spark, items.where("k < 4"), path, "k", work) == 4
    assert incremental.append_new(spark, items, path, "k", work) == 6
    assert incremental.append_new(spark, items, path, "k", work) == 0
    items.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        incremental.follow(spark, str(tmp_path / "in"), "k long", str(tmp_path / "out"), str(tmp_path / "cp"), "k", work).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_resampled_lines(spark):
    pts = lambda *p: F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in p))
    df = spark.range(1).select(F.lit(1).alias("k1"), pts((0, 0), (3, 0), (3, 2)).alias("line")).unionByName(spark.range(1).select(F.lit(2).alias("k1"), pts((7, 7)).alias("line")))
    out = sorted((r.k1, r.k, r.x, r.y) for r in lines.resampled(df, "k1", "line", 2.0).collect())
    assert out == [(1, 0, 0.0, 0.0), (1, 1, 2.0, 0.0), (1, 2, 3.0, 1.0), (1, 3, 3.0, 2.0), (2, 0, 7.0, 7.0)]


def test_tiles_of_a_box(spark):
    from tidemark.operators import cover

    box = spark.createDataFrame([(1, -10.0, -10.0, 10.0, 10.0)], "cell int, south double, west double, north double, east double")
    assert sorted((r.x, r.y) for r in cover.tiles(box, 1).collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_stamped_tables_and_retries(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    path = str(tmp_path / "kept")
    for version in ("1", "1", "2"):
        assert incremental.stamped(spark, path, version, make).count() == 3
    assert len(made) == 2


def test_lines_from_text_and_their_ends(spark):
    texts = ["LINESTRING (1 2, 3 4, 5 6)", "linestring(1 2,3 4)", "LINESTRING (1 2)", "LINESTRING EMPTY", "LINESTRING (1 2, x 4)", "POINT (1 2)", "", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, wkt string").withColumn("line", lines.from_wkt(F.col("wkt")))
    rows = {r.k: (r.lng1, r.lat1, r.lng2, r.lat2) for r in graph.with_endpoints(df, "line").collect()}
    assert rows == {0: (1, 2, 5, 6), 1: (1, 2, 3, 4)} | dict.fromkeys(range(2, 8), (None,) * 4)


def test_mean_edges_of_known_resolutions_only(spark):
    df = spark.createDataFrame([(0,), (15,), (16,), (-1,), (None,)], "r int")
    assert [r[0] for r in df.select(cells.mean_edge_m(F.col("r"))).collect()] == [cells.MEAN_EDGE_M[0], cells.MEAN_EDGE_M[15], None, None, None]


def test_stitches_of_empty_levels(spark):
    one = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 0.0)], "node_id long, x double, y double")
    other = spark.createDataFrame([(3, 1.0, 0.0), (4, 500.0, 0.0)], "node_id long, x double, y double")
    assert cover.stitched(one, other.limit(0), 2, 100.0).collect() == []
    assert sorted(map(tuple, cover.stitched(one, other, 1, 100.0).collect())) == [(1, 3), (2, 3)]


def test_weights_that_are_not_positive_are_refused(spark):
    from tidemark.operators import routing

    costs = spark.createDataFrame([(1, "v", 1, 2, 1.0), (1, "v", 2, 3, 0.0), (1, "v", 3, 2, 0.0)], "month int, vessel string, source long, target long, route_cost double")
    asked = spark.createDataFrame([(1, 1, 3, 1, "v")], "query_id long, origin long, goal long, month int, vessel string")
    with pytest.raises(Exception, match="weights must be positive"):
        routing.routes(asked, costs).collect()


def test_a_nearest_point_of_a_set_far_away(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, 9e6, -4e6)], "left_id long, lx double, ly double")
    right = spark.createDataFrame([(10, 3.0, 4.0), (11, -3.0, 4.0), (12, 100.0, 0.0)], "right_id long, rx double, ry double")
    assert sorted(map(tuple, cover.nearest_any(left, right, 50.0).collect())) == [(1, 10, 5.0), (2, 12, round(((9e6 - 100) ** 2 + 16e12) ** 0.5, 3))]
    assert cover.nearest_any(left, right.limit(0), 50.0).collect() == []


def test_snapping_to_cells(spark):
    from tidemark.functions import hexgrid

    table = spark.createDataFrame([(50.0, -5.0), (51.0, -5.0)], "lat double, lng double").select(hexgrid.cell_at(F.col("lat"), F.col("lng"), 6).alias("cell"))
    points = spark.createDataFrame([(1, 50.0, -5.0), (2, 50.1, -5.0), (3, 55.0, 0.0), (4, None, 0.0)], "point_id long, lat double, lng double")
    found = {r.point_id: (r.cell is None, r.ring) for r in cover.snapped_to_cells(points, table, 6, 3).collect()}
    assert found[1] == (False, 0) and found[2][0] is False and found[2][1] in (1, 2) and found[3] == found[4] == (True, None)


def test_helper_columns_take_free_names(spark):
    """A user's own columns of the names that operators use inside come through."""
    rows = spark.createDataFrame([(1, 5, "a"), (1, 6, "b"), (2, 7, "c")], "k int, n int, turn string")
    assert sorted(map(tuple, graph.first_wins(rows, ["k"], ["n"]).collect())) == [(1, 5, "a"), (2, 7, "c")]
    assert sorted(map(tuple, graph.merged([rows.where("n < 7"), rows.where("n = 7").withColumn("k", F.lit(1))], ["k"]).collect())) == [(1, 7, "c")]
    points = spark.createDataFrame([(1.5, 1, "lo", "a")], "lat double, month int, lo string, at_lo string")
    table = spark.createDataFrame([(1, 1, 2.0), (2, 1, 4.0)], "ilat long, month int, ratio double")
    (r,) = climate.interpolated(points, table, "ratio").collect()
    assert (r.lo, r.at_lo, r.ratio) == ("lo", "a", 3.0)


def test_geometries_of_a_geopackage(spark, tmp_path):
    """Blobs with a GeoPackage header are read to rings; broken ones are counted as invalid."""
    import sqlite3
    import struct

    from tidemark.functions import geometry

    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 3.0), (0.0, 0.0)]
    body = b"\x01" + struct.pack("<III", 3, 1, 4) + b"".join(struct.pack("<dd", *p) for p in square)
    header = b"GP\x00\x01" + struct.pack("<i", 4326)
    with sqlite3.connect(tmp_path / "g.gpkg") as db:
        db.execute("CREATE TABLE gpkg_contents (table_name TEXT)")
        for name in ("hexes_r10", "hexes_r9"):
            db.execute("INSERT INTO gpkg_contents VALUES (?)", (name,))
            db.execute(f"CREATE TABLE {name} (h3_id TEXT, geom BLOB)")
            db.execute(f"INSERT INTO {name} VALUES ('a', ?), ('b', ?)", (header + body, header + body[:-4]))
    spark.dataSource.register(files.GeoPackage)
    rows = spark.read.format("geopackage").option("path", str(tmp_path / "g.gpkg")).load().withColumn("rings", geometry.from_wkb(F.col("geometry")))
    assert rows.agg(F.count_if(~geometry.valid(F.col("rings"))).alias("bad")).collect()[0].bad == 2
    (r,) = rows.where("layer = 'hexes_r9' and rings is not null").collect()
    assert [(p.x, p.y) for p in r.rings[0].points] == square
    assert [r.layer for r in files.catalogue(rows.select("layer"), "hexes").orderBy("place").collect()] == ["hexes_r9", "hexes_r10"]


def test_datasets_merged_with_nulls(spark):
    a = spark.createDataFrame([(1, 1, 2.0, 5.0), (1, 2, None, 6.0)], "k int, turn int, x double, y double")
    b = spark.createDataFrame([(1, 1, None, 9.0), (2, 1, 3.0, 8.0)], "k int, turn int, y double, z double")
    assert sorted(map(tuple, climate.merged_datasets([a, b], ["k", "turn"]).select("k", "turn", "x", "y", "z").collect()), key=repr) == [(1, 1, 2.0, 5.0, 9.0), (1, 2, None, 6.0, None), (2, 1, None, 3.0, 8.0)]
