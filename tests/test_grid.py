"""Cells on the globe: published ids and positions, pentagons, the antimeridian, disks and unions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import cells, hexgrid
from tidemark.functions import icosahedron as ico
from tidemark.operators import components, cover, polygons


def ids(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "h string").select(cells.from_hex(F.col("h")).alias("cell"))


def every_cell(spark, level):
    base = spark.range(122).select((F.lit(1 << 59) + F.shiftleft("id", 45) + F.lit((1 << 45) - 1)).alias("cell"))
    for k in range(1, level + 1):
        base = base.select(F.explode(cells.children(F.col("cell"), k)).alias("cell"))
    return base


def test_published_ids_and_positions(spark):
    at = spark.createDataFrame([(37.3615593, -122.0553238, 5), (37.775938728915946, -122.41795063018799, 9), (37.3615593, -122.0553238, 7)], "lat double, lng double, res int")
    assert [r.h for r in at.select(cells.to_hex(hexgrid.cell_at(F.col("lat"), F.col("lng"), F.col("res"))).alias("h")).collect()] == ["85283473fffffff", "8928308280fffff", "87283472bffffff"]
    two = ids(spark, "8928308280fffff", "85283473fffffff").select(hexgrid.center(F.col("cell")).alias("at"), hexgrid.boundary(F.col("cell")).alias("ring")).collect()
    assert [(round(r.at.lat, 10), round(r.at.lng, 10)) for r in two] == [(37.7767023494, -122.4184593232), (37.3457933754, -121.9763759726)]
    published = [(37.271355866731895, -121.91508032705622), (37.353926450852256, -121.86222328902491), (37.42834118609435, -121.9235499963016), (37.42012867767778, -122.0377349642703), (37.33755608435298, -122.09042892904395), (37.26319797461824, -122.02910130919)]
    assert all(math.dist(p, (q.lat, q.lng)) < 1e-9 for p, q in zip(published, two[1].ring, strict=True))
    ring = ids(spark, "8928308280fffff").select(F.transform(hexgrid.ring(F.col("cell"), 1), cells.to_hex).alias("r")).collect()[0].r
    assert sorted(ring) == ["89283082803ffff", "89283082807ffff", "8928308280bffff", "8928308283bffff", "89283082873ffff", "89283082877ffff"]


def test_position_and_cell_agree_everywhere(spark):
    rng = random.Random(1)
    points = [(math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180), res) for res in (0, 1, 2, 5, 8, 15) for _ in range(800)]
    points += [(lat, lng, 6) for lat in (-90.0, 90.0, 0.0, 64.7, -64.7) for lng in (-180.0, 180.0, 179.9999, 10.5361, -169.4639)]
    df = spark.createDataFrame(points, "lat double, lng double, res int").withColumn("cell", hexgrid.cell_at(F.col("lat"), F.col("lng"), F.col("res")))
    again = df.withColumn("at", hexgrid.center(F.col("cell"))).withColumn("again", hexgrid.cell_at(F.col("at.lat"), F.col("at.lng"), F.col("res")))
    assert again.where("cell is null or cell <> again").count() == 0
    three = df.where("lat = 0").select("cell", "lng").collect()
    assert len({r.cell for r in three if abs(r.lng) == 180.0}) == 1


def test_no_position_no_cell(spark):
    rows = spark.createDataFrame([(None, 1.0), (1.0, None), (91.0, 0.0), (float("nan"), 0.0), (0.0, float("inf"))], "lat double, lng double")
    assert all(r.c is None for r in rows.select(hexgrid.cell_at(F.col("lat"), F.col("lng"), 5).alias("c")).collect())
    none = spark.createDataFrame([(None,)], "cell long").select(hexgrid.center(F.col("cell")).alias("a"), hexgrid.boundary(F.col("cell")).alias("b"), hexgrid.neighbour(F.col("cell"), 0).alias("c")).collect()[0]
    assert list(none) == [None, None, None]


@pytest.mark.parametrize("level", [0, 1, 2])
def test_neighbours_of_all_cells(spark, level):
    table = every_cell(spark, level).withColumn("n", hexgrid.neighbours(F.col("cell"))).withColumn("five", cells.is_pentagon(F.col("cell"))).collect()
    assert len(table) == len({r.cell for r in table}) == 2 + 120 * 7**level
    of = {r.cell: set(r.n) for r in table}
    assert all(r.cell in of[n] for r in table for n in r.n)
    assert sum(r.five for r in table) == 12 and all(len(r.n) == (5 if r.five else 6) and r.cell not in r.n for r in table)


def test_neighbours_are_the_nearest_cells(spark):
    """Around a pentagon and far from one: the cells of a disk by steps are those that a search over all pairs finds."""
    table = every_cell(spark, 2).withColumn("at", hexgrid.center(F.col("cell"))).withColumn("n", hexgrid.neighbours(F.col("cell"))).collect()
    point = {r.cell: (math.cos(math.radians(r.at.lat)) * math.cos(math.radians(r.at.lng)), math.cos(math.radians(r.at.lat)) * math.sin(math.radians(r.at.lng)), math.sin(math.radians(r.at.lat))) for r in table}
    for r in random.Random(4).sample(table, 60) + [r for r in table if len(r.n) == 5]:
        near = sorted((c for c in point if c != r.cell), key=lambda c: math.dist(point[c], point[r.cell]))[: len(r.n)]
        assert set(near) == set(r.n)


def test_rings_and_disks(spark):
    around = ids(spark, "85283473fffffff", "8009fffffffffff", "820807fffffffff").select(F.transform(hexgrid.rings(F.col("cell"), 3), lambda r: F.size(r)).alias("n"), F.size(hexgrid.disk(F.col("cell"), 2)).alias("d")).collect()
    assert around[0].n == [1, 6, 12, 18] and around[0].d == 19
    assert around[1].n[:3] == [1, 5, 10] and around[2].n == [1, 5, 10, 15]


def test_boundaries_close_up(spark):
    """Every corner of a level's cells belongs to three of them, pentagons' too."""
    corners = every_cell(spark, 1).select(F.explode(hexgrid.boundary(F.col("cell"))).alias("p")).groupBy(F.round("p.lat", 7), F.round("p.lng", 7)).count()
    assert [(r["count"], r.n) for r in corners.groupBy("count").agg(F.count("*").alias("n")).collect()] == [(3, (6 * 842 - 12) // 3)]


def test_children_of_a_pentagon(spark):
    kids = ids(spark, "8009fffffffffff").select(F.explode(cells.children(F.col("cell"), 1)).alias("c")).select(cells.to_hex(F.col("c")).alias("h"), cells.is_pentagon(F.col("c")).alias("five")).collect()
    assert len(kids) == 6 and [r.five for r in kids].count(True) == 1


def test_outlines_of_a_ring_of_cells(spark):
    """Six cells around a hole, and a cell apart: three rings, the hole clockwise."""
    ring = ids(spark, "85283473fffffff").select(F.explode(hexgrid.ring(F.col("cell"), 1)).alias("cell"))
    far = ids(spark, "85283473fffffff").select(hexgrid.ring(F.col("cell"), 3)[0].alias("cell"))
    got = components.outlines(ring.unionByName(far).withColumn("g", F.lit(1)), "g", "cell").select(F.size("points").alias("n"), (polygons.area(F.col("points")) > 0).alias("left")).collect()
    assert sorted((r.n, r.left) for r in got) == [(6, False), (6, True), (18, True)]


def test_edges_of_cells_on_all_sides(spark):
    disk = ids(spark, "85283473fffffff").select(F.explode(hexgrid.disk(F.col("cell"), 2)).alias("cell"))
    assert cover.adjacent(disk, "cell").count() == 42
    parts = cover.frontier_parts(disk, "cell").collect()
    assert len(parts) == 12 and len({r.part for r in parts}) == 1


def test_connected_parts_and_cycles(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(50)]
    nodes = [*range(300), 5000, *range(1000, 1051)]
    up = {i: i for i in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    found = components.connected(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges, "source long, target long"))
    assert {r.node: r.part for r in found.collect()} == {n: top(n) for n in nodes}
    turn = list(range(60))
    rng.shuffle(turn)
    want = {}
    for i in range(60):
        j, k = i, 0
        while j not in want:
            want[j] = (i, k)
            j, k = turn[j], k + 1
    got = components.cycles(spark.createDataFrame(list(enumerate(turn)), "node long, after long"))
    assert {r.node: (r.cycle, r.position) for r in got.collect()} == want


def test_tables_of_the_grid():
    assert len(ico.BASE_CELLS) == 122 and [n for n, b in enumerate(ico.BASE_CELLS) if b.pentagon] == cells.PENTAGONS
