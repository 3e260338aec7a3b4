"""Polygons against brute force, geometries in bytes and text, and a cover that is taken up again."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from tidemark.functions import cells, geometry, hexgrid
from tidemark.operators import polygons

POINTS = "array<struct<x: double, y: double>>"


def star(rng, x, y, size, n=9):
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return [(x + size * rng.uniform(0.4, 1) * math.cos(t), y + size * rng.uniform(0.4, 1) * math.sin(t)) for t in turns]


def is_in(p, rings):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (y1 <= p[1]) != (y2 <= p[1]) and p[0] < x1 + (p[1] - y1) / (y2 - y1) * (x2 - x1):
                odd = not odd
    return odd


@pytest.fixture(scope="module")
def world():
    rng = random.Random(8)
    shapes = {k: [star(rng, rng.uniform(-4, 4), rng.uniform(-4, 4), rng.choice([0.05, 0.3, 2.5]))] for k in range(25)}
    shapes[100] = [[(-5.1, -5.2), (5.3, -5.1), (5.2, 5.4), (-5.3, 5.1)], [(-1.1, -1.2), (1.3, -1.1), (1.2, 1.4), (-1.3, 1.1)], star(rng, 3, 3, 0.7)]
    return shapes


def rings_of(spark, shapes):
    return spark.createDataFrame([(k, n, ring) for k, rings in shapes.items() for n, ring in enumerate(rings)], f"poly_id long, ring int, points {POINTS}")


@pytest.mark.parametrize("side", [0.07, 0.5, 20.0])
def test_points_inside(spark, world, side):
    rng = random.Random(1)
    points = [(k, rng.uniform(-6, 6), rng.uniform(-6, 6)) for k in range(1500)]
    got = {tuple(r) for r in polygons.inside(spark.createDataFrame(points, "point_id long, x double, y double"), rings_of(spark, world), side).select("point_id", "poly_id").collect()}
    assert got == {(k, s) for k, x, y in points for s, rings in world.items() if is_in((x, y), rings)}


def test_nearest_segment(spark, world):
    rng = random.Random(2)
    points = [(k, rng.uniform(-9, 9), rng.uniform(-9, 9)) for k in range(300)] + [(300, 100.0, 50.0)]
    sides = [(a, b) for rings in world.values() for ring in rings for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]

    def far(p, a, b):
        t = max(0, min(1, ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / ((b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2)))
        return math.dist(p, (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))

    for side in (0.05, 1.0):
        coast = polygons.pyramid(polygons.segments(rings_of(spark, world)), side)
        got = {r.point_id: r for r in polygons.nearest_segment(spark.createDataFrame(points, "point_id long, x double, y double"), coast).collect()}
        for k, x, y in points:
            want = min(far((x, y), a, b) for a, b in sides)
            assert abs(got[k].d - want) < 1e-9 and abs(math.dist((x, y), (got[k].x, got[k].y)) - want) < 1e-9
    none = polygons.pyramid(polygons.segments(rings_of(spark, {1: []})), 1.0)
    assert polygons.nearest_segment(spark.createDataFrame(points, "point_id long, x double, y double"), none).count() == 0


def test_meeting(spark):
    box = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    land = {1: [box(0.0, 0.0, 4.0), box(1.0, 1.0, 2.0)], 2: [box(10.0, 10.0, 1.0)]}
    asked = {10: [box(0.2, 0.2, 0.5)], 11: [box(1.5, 1.5, 0.5)], 12: [box(3.5, 3.5, 1.0)], 13: [box(9.0, 9.0, 3.0)], 14: [box(0.5, 0.5, 3.0)], 15: [box(20.0, 0.0, 1.0)]}
    got = sorted(tuple(r) for r in polygons.meeting(rings_of(spark, asked), rings_of(spark, land), 0.7).collect())
    assert got == [(10, 1, False, True), (12, 1, True, False), (13, 2, False, False), (14, 1, False, False)]


def test_filled_and_its_holes(spark):
    shapes = {1: [[(-1.2, 50.1), (-0.2, 50.15), (-0.3, 50.7), (-1.1, 50.8)], [(-0.9, 50.3), (-0.5, 50.3), (-0.5, 50.5), (-0.9, 50.5)]]}
    got = {r.cell for r in polygons.filled(rings_of(spark, shapes), 6, 0.25).collect()}
    grid = spark.range(130 * 90).select((F.lit(50.0) + 0.01 * (F.col("id") % 90)).alias("lat"), (F.lit(-1.3) + 0.01 * F.floor(F.col("id") / 90)).alias("lng"))
    every = grid.select(hexgrid.cell_at(F.col("lat"), F.col("lng"), 6).alias("cell")).distinct().withColumn("at", hexgrid.center(F.col("cell"))).collect()
    assert got == {r.cell for r in every if is_in((r.at.lng, r.at.lat), shapes[1])} and len(got) > 50


def test_parts_of_tiles_add_up(spark, world):
    parts = polygons.cut_by_tiles(rings_of(spark, world), 0.5).withColumn("a", polygons.area(F.col("points")))
    area = lambda ring: sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True)) / 2
    got = {(r.poly_id, r.ring): r.a for r in parts.groupBy("poly_id", "ring").agg(F.sum("a").alias("a")).collect()}
    assert got.keys() == {(k, n) for k, rings in world.items() for n in range(len(rings))}
    assert all(abs(a - area(world[k][n])) < 1e-9 for (k, n), a in got.items())
    outside = F.exists("points", lambda p: (p["x"] < F.col("c") * 0.5 - 1e-9) | (p["x"] > F.col("c") * 0.5 + 0.5 + 1e-9) | (p["y"] < F.col("r") * 0.5 - 1e-9) | (p["y"] > F.col("r") * 0.5 + 0.5 + 1e-9))
    assert parts.where(outside).count() == 0


def packed(order, kind, *body):
    return (b"\x01" if order == "<" else b"\x00") + struct.pack(order + "I", kind) + b"".join(body)


def run(order, points, *more):
    return struct.pack(order + "I", len(points)) + b"".join(struct.pack(order + "dd", *p) + struct.pack(order + f"{len(more)}d", *more) for p in points)


def test_bytes_of_geometries(spark):
    rng = random.Random(1)
    rings = [[(rng.uniform(-180, 180), rng.choice([0.1, -0.0, 5e-324, 1e308, -3.25e-7, float("inf")])) for _ in range(5)] for _ in range(3)]
    count = lambda o, n: struct.pack(o + "I", n)
    polygon = lambda o, some: packed(o, 3, count(o, len(some)), *(run(o, r) for r in some))
    header = b"GP\x00\x03" + struct.pack("<i", 4326) + bytes(32)
    deep = packed("<", 1003, count("<", 3), *(run("<", r, 7.0) for r in rings))
    tagged = b"\x01" + struct.pack("<II", 0x20000003, 4326) + count("<", 1) + run("<", rings[0])
    blobs = [polygon("<", rings), polygon(">", rings[:1]), deep, packed(">", 2, run(">", rings[0])), packed("<", 6, count("<", 2), polygon(">", rings[:2]), polygon("<", rings[2:])), header + polygon("<", rings), tagged]
    blobs += [polygon("<", rings)[:-3], packed("<", 1, struct.pack("<dd", 1, 2)), None, b"", polygon("<", [])]
    all3, first = [(0, k, r) for k, r in enumerate(rings)], [(0, 0, rings[0])]
    want = [all3, first, all3, first, [(0, 0, rings[0]), (0, 1, rings[1]), (1, 0, rings[2])], all3, first, None, None, None, None, []]
    out = spark.createDataFrame([(n, b) for n, b in enumerate(blobs)], "n int, b binary").select("n", geometry.from_wkb(F.col("b")).alias("r")).withColumn("ok", geometry.valid(F.col("r"))).orderBy("n").collect()
    assert [None if o.r is None else [(x.part, x.ring, [(p.x, p.y) for p in x.points]) for x in o.r] for o in out] == want
    assert not out[-1].ok and not out[7].ok


def test_text_of_geometries(spark):
    texts = {
        "POLYGON ((0 0, 1 0, 1.5e1 -2, 0 0), (0.1 .2, 3 4, 5 6))": [(0, 0, 4), (0, 1, 3)], "multipolygon(((0 0,1 1,2 2)),((3 3,4 4,5 5),(6 6,7 7,8 8)))": [(0, 0, 3), (1, 0, 3), (1, 1, 3)],
        "LINESTRING Z (1 2 3, 4 5 6)": [(0, 0, 2)], "MULTILINESTRING ((0 0,1 1),(2 2,3 3))": [(0, 0, 2), (1, 0, 2)], "LINESTRING EMPTY": None, "POLYGON ((0 0, 1))": None, "POINT (1 2)": None, "": None,
    }
    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", geometry.from_wkt(F.col("t")).alias("r")).collect()
    assert {o.t: None if o.r is None else [(x.part, x.ring, len(x.points)) for x in o.r] for o in out} == texts


def test_lines_cut_at_crossings(spark):
    rows = [(1, 0, 0.0, 0.0, 4.0, 0.0), (2, 0, 1.0, -1.0, 1.0, 1.0), (3, 0, 2.0, 0.0, 2.0, 3.0), (4, 0, 9.0, 9.0, 9.5, 9.0)]
    got = polygons.split_at_crossings(spark.createDataFrame(rows, "id long, k int, x1 double, y1 double, x2 double, y2 double"), 0.3).collect()
    assert sorted((r.id, r.piece, r.x1, r.x2) for r in got if r.id == 1) == [(1, 0, 0.0, 1.0), (1, 1, 1.0, 2.0), (1, 2, 2.0, 4.0)]
    assert {r.id: sum(x.id == r.id for x in got) for r in got} == {1: 3, 2: 2, 3: 1, 4: 1}


def test_a_cover_goes_on_after_its_last_whole_layer(spark, tmp_path):
    from tidemark.plans import adaptive

    land = rings_of(spark, {1: [[(-9.0, 50.0), (-8.6, 50.02), (-8.7, 50.3), (-8.95, 50.25)]]})
    first = spark.createDataFrame([(50.1, -8.8), (50.9, -7.0)], "lat double, lng double").select(hexgrid.cell_at(F.col("lat"), F.col("lng"), 3).alias("cell"))
    rules = adaptive.Rules(last=5, land_level=4)
    whole = adaptive.cover_sea(spark, first, 3, land, str(tmp_path / "a"), rules)
    assert list(whole) == [3, 4, 5] and whole[5].where("refined").count() == 0
    rows = {k: sorted(tuple(r) for r in t.select("cell", "sea_only", "refined").collect()) for k, t in whole.items()}
    for k in (3, 4):
        whole[k].write.parquet(str(tmp_path / "b" / f"hexes_r{k}"))
    (tmp_path / "b" / "hexes_r4" / "_SUCCESS").unlink()
    again = adaptive.cover_sea(spark, first, 3, land, str(tmp_path / "b"), rules)
    assert {k: sorted(tuple(r) for r in t.select("cell", "sea_only", "refined").collect()) for k, t in again.items()} == rows
    parents = whole[4].where("refined").select("cell")
    assert whole[5].select(cells.parent(F.col("cell"), 4).alias("cell")).distinct().join(parents, "cell", "left_anti").count() == 0
