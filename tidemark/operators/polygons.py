"""Polygons, lines and points in the plane, joined by tiles.

A polygon is rows of rings (poly_id, ring, points); its sides become segments, and segments are
dealt to the tiles they touch, so a polygon of any size is spread over tasks and nothing is
compared but within a tile. What lies inside is told by even and odd: along the middle line of
each row of tiles the crossings are counted in an aggregation, which gives the state of every
tile's line; a point needs only the segments of its own tile besides. Holes are rings like
others. On which side a point falls that lies on a polygon's very edge is not defined.
"""

from __future__ import annotations


from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tidemark.functions import cells, hexgrid
from tidemark.session import Tables

OFF = 0.0123456789  # tiles begin off round numbers, so that no usual vertex lies on their lines
TOP_TILES = 64  # a pyramid ends with a level of so many tiles or fewer
MOST_BROADCAST = 100_000  # tiles of a level


def segments(rings: DataFrame) -> DataFrame:
    """(poly_id, ring, k, x1, y1, x2, y2): the sides of rings of (x, y); the last point is joined to the first. Sides without length go."""
    p = F.col("points")
    ends = F.transform(p, lambda a, i: F.struct(i.alias("k"), a.alias("a"), F.get(p, F.pmod(i + 1, F.size(p))).alias("b")))
    out = rings.select("poly_id", "ring", F.explode(ends).alias("s")).select("poly_id", "ring", "s.k", F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))
    return out.where("x1 <> x2 or y1 <> y2")


def _u(x: Column, side: float) -> Column:
    return (x + OFF) / side


def tiled(sides: DataFrame, side: float) -> DataFrame:
    """Each segment with the tiles (c, r) it touches, in tile units (u1, v1, u2, v2); ``crosses``: it crosses the row's middle line in that tile."""
    out = sides.withColumns({"u1": _u(F.col("x1"), side), "v1": _u(F.col("y1"), side), "u2": _u(F.col("x2"), side), "v2": _u(F.col("y2"), side)}).drop("x1", "y1", "x2", "y2")
    low, high = F.least("v1", "v2"), F.greatest("v1", "v2")
    out = out.withColumn("r", F.explode(F.sequence(F.floor(low), F.floor(high))))
    along = lambda v: F.when(F.col("v1") == F.col("v2"), F.col("u1")).otherwise(F.col("u1") + (v - F.col("v1")) / F.nullif(F.col("v2") - F.col("v1"), F.lit(0.0)) * (F.col("u2") - F.col("u1")))
    a, b = along(F.greatest(F.col("r").cast("double"), low)), F.when(F.col("v1") == F.col("v2"), F.col("u2")).otherwise(along(F.least(F.col("r") + 1.0, high)))
    middle = F.col("r") + 0.5
    at = F.when((F.col("v1") <= middle) != (F.col("v2") <= middle), F.floor(along(middle)))
    out = out.withColumns({"a": a, "b": b, "at": at})
    out = out.withColumn("c", F.explode(F.sequence(F.floor(F.least("a", "b") - 1e-9), F.floor(F.greatest("a", "b") + 1e-9))))
    return out.withColumn("crosses", F.coalesce(F.col("at") == F.col("c"), F.lit(False))).drop("a", "b", "at")


def states(dealt: DataFrame) -> DataFrame:
    """(poly_id, c, r, border, odd): tiles that a polygon's edge touches, and those within it.

    ``odd``: whether the middle line is inside the polygon where it enters the tile from the west.
    """
    events = dealt.groupBy("poly_id", "r", "c").agg(F.count_if("crosses").alias("n"))
    row = Window.partitionBy("poly_id", "r").orderBy("c")  # no longer than the polygon is wide
    upto = events.withColumn("before", F.coalesce(F.sum("n").over(row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("next", F.lead("c").over(row))
    border = upto.select("poly_id", "c", "r", F.lit(True).alias("border"), (F.col("before") % 2 == 1).alias("odd"))
    gap = upto.where("(before + n) % 2 = 1 and next > c + 1")
    within = gap.select("poly_id", F.explode(F.sequence(F.col("c") + 1, F.col("next") - 1)).alias("c"), "r", F.lit(False).alias("border"), F.lit(True).alias("odd"))
    return border.unionByName(within)


def _left_of(u: Column, v: Column) -> Column:
    """Whether a place lies to the left of a segment, seen from its first end."""
    return (F.col("u2") - F.col("u1")) * (v - F.col("v1")) - (F.col("v2") - F.col("v1")) * (u - F.col("u1")) > 0


def inside(points: DataFrame, rings: DataFrame, side: float) -> DataFrame:
    """(point_id, poly_id) of the points (point_id, x, y) inside polygons. Point ids are different from each other.

    The way to a point goes along the middle line of its row, then straight up or down; it is
    inside if that crosses the polygon's edge an odd number of times.
    """
    return _inside(points, tiled(segments(rings), side), side)


def _inside(points: DataFrame, dealt: DataFrame, side: float) -> DataFrame:
    known = states(dealt)
    placed = points.select("point_id", _u(F.col("x"), side).alias("u"), _u(F.col("y"), side).alias("v")).withColumns({"c": F.floor("u"), "r": F.floor("v")})
    whole = placed.join(known.where("not border").select("poly_id", "c", "r"), ["c", "r"]).select("point_id", "poly_id")
    middle = F.col("r") + 0.5
    turn, there = _left_of(F.col("u"), middle), _left_of(F.col("u"), F.col("v"))
    west = F.col("crosses") & (F.when(F.col("v2") > F.col("v1"), ~turn).otherwise(turn))
    upright = ((F.col("u1") <= F.col("u")) != (F.col("u2") <= F.col("u"))) & (turn != there)
    near = placed.join(dealt.join(known.where("border").select("poly_id", "c", "r", "odd"), ["poly_id", "c", "r"]), ["c", "r"])
    flips = near.groupBy("point_id", "poly_id").agg(F.sum(west.cast("int") + upright.cast("int")).alias("n"), F.first("odd").alias("odd"))
    return whole.unionByName(flips.where((F.col("n") + F.col("odd").cast("int")) % 2 == 1).select("point_id", "poly_id"))


_BOXED = " and ".join(f"greatest({p}{i}, {p}{i + 2}) >= least({q}{i}, {q}{i + 2})" for p, q in ("ab", "ba") for i in (1, 2))


def _turn(p: tuple[str, str], q: tuple[str, str], r: tuple[str, str]) -> Column:
    """Whether r lies to the left of the way from p to q, or to the right, or on it: 1, -1, 0."""
    (px, py), (qx, qy), (rx, ry) = [(F.col(x), F.col(y)) for x, y in (p, q, r)]
    return F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))


def _touching(one: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of tiled segments that touch or cross, each once; of ``keys`` of either, prefixed by a and b, and their ends a1 to a4 and b1 to b4."""
    ends = {f"{u}{i}": n for n, (u, i) in enumerate((("u", 1), ("v", 1), ("u", 2), ("v", 2)), 1)}
    a, b = (t.select("c", "r", *(F.col(k).alias(f"{p}_{k}") for k in keys), *(F.col(e).alias(f"{p}{n}") for e, n in ends.items())) for t, p in ((one, "a"), (other, "b")))
    a_from, a_to, b_from, b_to = ("a1", "a2"), ("a3", "a4"), ("b1", "b2"), ("b3", "b4")
    split = (_turn(a_from, a_to, b_from) * _turn(a_from, a_to, b_to) <= 0) & (_turn(b_from, b_to, a_from) * _turn(b_from, b_to, a_to) <= 0)
    return a.join(b, ["c", "r"]).where(F.expr(_BOXED) & split).drop("c", "r")


def crossings(one: DataFrame, other: DataFrame, side: float) -> DataFrame:
    """Pairs of segments (a_id, a_k, b_id, b_k, and their ends in tile units) of two sets (id, k, x1, y1, x2, y2) that touch or cross, each once."""
    return _touching(tiled(one, side), tiled(other, side), ["id", "k"]).dropDuplicates(["a_id", "a_k", "b_id", "b_k"])


def _corners(rings: DataFrame) -> DataFrame:
    return rings.where(F.size("points") > 0).select(F.struct("poly_id", "ring").alias("point_id"), F.col("points")[0]["x"].alias("x"), F.col("points")[0]["y"].alias("y"))


def meeting(one: DataFrame, other: DataFrame, side: float) -> DataFrame:
    """(a_id, b_id, touch, within) of polygons of two sets that share a point.

    ``touch``: their edges do; ``within``: the first lies in the second and does not touch its edge.

    Polygons meet if their edges do, or if a ring's corner lies inside the other. Rings and
    their tiles are written once and read for each of the three.
    """
    tables = Tables(one.sparkSession)
    rings = [tables.keep(t, "rings") for t in (one, other)]
    dealt = [tables.keep(tiled(segments(t), side), "dealt") for t in rings]
    yes = F.lit(True)
    touch = _touching(*dealt, ["poly_id"]).select(F.col("a_poly_id").alias("a_id"), F.col("b_poly_id").alias("b_id")).distinct().withColumn("touch", yes)
    a_in_b = _inside(_corners(rings[0]), dealt[1], side).select(F.col("point_id.poly_id").alias("a_id"), F.col("poly_id").alias("b_id")).distinct().withColumn("a_in_b", yes)
    b_in_a = _inside(_corners(rings[1]), dealt[0], side).select(F.col("point_id.poly_id").alias("b_id"), F.col("poly_id").alias("a_id")).distinct().withColumn("b_in_a", yes)
    every = touch.join(a_in_b, ["a_id", "b_id"], "full").join(b_in_a, ["a_id", "b_id"], "full")
    return every.select("a_id", "b_id", F.col("touch").isNotNull().alias("touch"), (F.col("touch").isNull() & F.col("a_in_b").isNotNull() & F.col("b_in_a").isNull()).alias("within"))


def cell_rings(table: DataFrame, col: str = "cell") -> DataFrame:
    """Cells as polygons of (lng, lat); cells over the antimeridian are not cut."""
    corners = F.transform(hexgrid.boundary(F.col(col)), lambda p: F.struct(p["lng"].alias("x"), p["lat"].alias("y")))
    return table.select(F.col(col).alias("poly_id"), F.lit(0).alias("ring"), corners.alias("points"))


def filled(rings: DataFrame, level: int, side: float) -> DataFrame:
    """(poly_id, cell) of the cells of a level whose centres lie inside polygons of (lng, lat).

    Scan lines over tiles so small that each centre's cell holds the middle of the centre's
    tile: those on the edge and those inside name the candidates, whose centres are then tried.
    """
    small = 0.8 * cells.MEAN_EDGE_M[level] / 111_195
    tiles = states(tiled(segments(rings), small)).select("poly_id", "c", "r")
    named = tiles.select("poly_id", hexgrid.cell_at((F.col("r") + 0.5) * small - OFF, (F.col("c") + 0.5) * small - OFF, level).alias("cell")).where("cell is not null").distinct()
    at = named.select("poly_id", "cell", hexgrid.center(F.col("cell")).alias("at"))
    points = at.select("cell", "at").dropDuplicates(["cell"]).select(F.col("cell").alias("point_id"), F.col("at.lng").alias("x"), F.col("at.lat").alias("y"))
    return inside(points, rings, side).withColumnRenamed("point_id", "cell").select("poly_id", "cell")


def _to_box(u: Column, v: Column, c: Column, r: Column, size: Column | float) -> tuple[Column, Column]:
    """Least and greatest distance of a place from a tile, in units of the smallest tiles."""
    lo_u, lo_v = c * size, r * size
    gap = lambda p, lo: F.greatest(lo - p, p - lo - size, F.lit(0.0))
    far = lambda p, lo: F.greatest(F.abs(p - lo), F.abs(p - lo - size))
    return F.hypot(gap(u, lo_u), gap(v, lo_v)), F.hypot(far(u, lo_u), far(v, lo_v))


class Pyramid(NamedTuple):
    """Segments dealt to tiles, the tiles that hold any, and how many of these there are at each level of tiles twice as wide."""

    side: float
    dealt: DataFrame
    tiles: DataFrame
    counts: list[int]
    top: list[Row]

    def level(self, k: int) -> DataFrame:
        return self.tiles.select(_wider("c", k).alias("c"), _wider("r", k).alias("r")).distinct() if k else self.tiles


def _wider(c: str, k: int) -> Column:
    return F.floor(F.col(c) / (1 << k))


def pyramid(sides: DataFrame, side: float) -> Pyramid:
    """The pyramid over segments (x1, y1, x2, y2), written once; its top level has TOP_TILES tiles or fewer, or tiles as wide as all."""
    tables = Tables(sides.sparkSession)
    dealt = tables.keep(tiled(sides, side).drop("crosses"), "dealt")
    tiles = tables.keep(dealt.select("c", "r").distinct(), "tiles")
    span = tiles.agg(F.max(F.greatest(F.abs("c"), F.abs("r"))).alias("span")).collect()[0].span or 0
    most = span.bit_length() + 1
    every = tiles.select(F.explode(F.sequence(F.lit(0), F.lit(most))).alias("k"), "c", "r").select("k", F.floor(F.col("c") / F.pow(F.lit(2.0), F.col("k"))).alias("c"), F.floor(F.col("r") / F.pow(F.lit(2.0), F.col("k"))).alias("r"))
    counts = [r.n for r in every.distinct().groupBy("k").agg(F.count("*").alias("n")).orderBy("k").collect()]
    height = next((k for k, n in enumerate(counts) if n <= TOP_TILES), most)
    found = Pyramid(side, dealt, tiles, counts[: height + 1], [])
    return found._replace(top=found.level(height).collect()) if counts else found


def nearest_segment(points: DataFrame, sides: Pyramid, decimals: int | None = None) -> DataFrame:
    """(point_id, d, x, y, id): for each point (point_id, x, y) the nearest place on any segment, in the plane, and the segment's id if segments have one.

    Distances are compared exactly, or to ``decimals``; of equal ones the least id, then the least (x, y) is taken.

    Branch and bound down a pyramid of the tiles that hold segments. Every tile holds a place
    of a segment, so its farthest corner bounds the distance; tiles that begin beyond the best
    bound are left, the others are opened. The tiles that hold points are asked, in tiles as wide
    as those of each level, and all points of one share its answer; then a point compares itself
    with the segments of the few tiles that remain. Without segments there are no rows.
    """
    side, dealt = sides.side, sides.dealt
    top = [F.struct(F.lit(x.c).alias("c"), F.lit(x.r).alias("r")) for x in sides.top]
    if not top:
        return points.select("point_id", *(F.lit(0.0).alias(c) for c in ("d", "x", "y")), F.lit(0).cast("long").alias("id")).limit(0)
    place = points.select("point_id", _u(F.col("x"), side).alias("u"), _u(F.col("y"), side).alias("v")).withColumns({"pc": F.floor("u"), "pr": F.floor("v")})
    homes = Tables(points.sparkSession).keep(place.where("u is not null and v is not null").select("pc", "pr").distinct(), "homes")
    wide = lambda k: homes.select(_wider("pc", k).alias("pc"), _wider("pr", k).alias("pr")).distinct() if k else homes
    height = len(sides.counts) - 1
    tiles = wide(height).withColumn("t", F.explode(F.array(*top))).select("pc", "pr", "t.c", "t.r")
    for k in range(height, -1, -1):
        gap = [F.greatest(F.abs(F.col(p) - F.col(t)) - 1, F.lit(0)) for p, t in (("pc", "c"), ("pr", "r"))]
        reach = [F.abs(F.col(p) - F.col(t)) + 1 for p, t in (("pc", "c"), ("pr", "r"))]
        square = lambda x: x[0] * x[0] + x[1] * x[1]
        bounded = tiles.groupBy("pc", "pr").agg(F.min(square(reach)).alias("bound"), F.collect_list(F.struct(square(gap).alias("least"), "c", "r")).alias("tiles"))
        held = bounded.select("pc", "pr", F.filter("tiles", lambda t: t["least"] <= F.col("bound")).alias("tiles"))
        if k:
            finer = sides.level(k - 1).select(F.col("c").alias("fc"), F.col("r").alias("fr"), _wider("c", 1).alias("c"), _wider("r", 1).alias("r"))
            finer = F.broadcast(finer) if sides.counts[k - 1] <= MOST_BROADCAST else finer
            parts = wide(k - 1).select(F.col("pc").alias("qc"), F.col("pr").alias("qr"), _wider("pc", 1).alias("pc"), _wider("pr", 1).alias("pr"))
            opened = held.select("pc", "pr", F.explode("tiles").alias("t")).select("pc", "pr", "t.c", "t.r").join(finer, ["c", "r"])
            tiles = opened.join(parts, ["pc", "pr"]).select(F.col("qc").alias("pc"), F.col("qr").alias("pr"), F.col("fc").alias("c"), F.col("fr").alias("r"))
    box = lambda t: _to_box(F.col("u"), F.col("v"), t["c"], t["r"], 1.0)
    asked = place.join(held, ["pc", "pr"]).select("point_id", "u", "v", F.transform("tiles", lambda t: F.struct(box(t)[0].alias("least"), box(t)[1].alias("most"), t["c"].alias("c"), t["r"].alias("r"))).alias("tiles"))
    asked = asked.withColumn("bound", F.array_min(F.transform("tiles", lambda t: t["most"])) + 1e-6)
    tiles = asked.select("point_id", "u", "v", "bound", F.explode(F.filter("tiles", lambda t: t["least"] <= F.col("bound"))).alias("t")).select("point_id", "u", "v", "bound", "t.c", "t.r")
    du, dv = F.col("u2") - F.col("u1"), F.col("v2") - F.col("v1")
    along = ((F.col("u") - F.col("u1")) * du + (F.col("v") - F.col("v1")) * dv) / F.nullif(du * du + dv * dv, F.lit(0.0))
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(along, F.lit(0.0))))
    near = tiles.repartition(96, "c", "r").join(dealt, ["c", "r"]).withColumn("share", share).withColumns({"nu": F.col("u1") + F.col("share") * du, "nv": F.col("v1") + F.col("share") * dv})
    far = F.hypot(F.col("nu") - F.col("u"), F.col("nv") - F.col("v")) * side
    which = F.col("id") if "id" in dealt.columns else F.lit(None).cast("long")
    near = near.where(far <= (F.col("bound") + 1e-6) * side)
    best = near.groupBy("point_id").agg(F.min(F.struct((far if decimals is None else F.round(far, decimals)).alias("d"), which.alias("id"), "nu", "nv")).alias("b"))
    return best.select("point_id", "b.d", (F.col("b.nu") * side - OFF).alias("x"), (F.col("b.nv") * side - OFF).alias("y"), "b.id")


def _half_plane(points: Column, kept: Column | float, axis: str, above: bool) -> Column:
    """A ring cut along x or y = ``kept``; what is above stays, or what is below."""
    bound = F.lit(kept) if not isinstance(kept, Column) else kept
    stays = lambda p: p[axis] >= bound if above else p[axis] <= bound
    other = "y" if axis == "x" else "x"

    def step(p: Column, i: Column) -> Column:
        q = F.get(points, F.pmod(i + 1, F.size(points)))
        cut = p[other] + (bound - p[axis]) / (q[axis] - p[axis]) * (q[other] - p[other])
        at = F.struct(*(x.alias(n) for n, x in sorted(((axis, bound), (other, cut)))))
        none = F.slice(F.array(p), 1, 0)
        return F.concat(F.when(stays(p), F.array(p)).otherwise(none), F.when(stays(p) != stays(q), F.array(at)).otherwise(none))

    return F.flatten(F.transform(points, step))


def area(points: Column) -> Column:
    """Of a ring, positive if it runs counterclockwise."""
    twice = F.transform(points, lambda p, i: p["x"] * F.get(points, F.pmod(i + 1, F.size(points)))["y"] - F.get(points, F.pmod(i + 1, F.size(points)))["x"] * p["y"])
    return F.aggregate(twice, F.lit(0.0), lambda s, x: s + x) / 2


def cut_by_tiles(rings: DataFrame, side: float) -> DataFrame:
    """(poly_id, ring, c, r, points): each ring's part in each tile of ``side``, tiles counted from 0 at the origin.

    Tiles within a ring are whole. A ring is cut into rows first, then its rows into columns,
    so that no tile looks at the whole ring. A part keeps its ring's sense; where a ring enters
    a tile more than once, its parts there are joined along the tile's edge.
    """
    named = rings.withColumn("poly_id", F.struct("poly_id", "ring"))
    shifted = named.withColumn("points", F.transform("points", lambda p: F.struct((p["x"] - OFF).alias("x"), (p["y"] - OFF).alias("y"))))
    known = states(tiled(segments(shifted), side))
    box = lambda c, r: [F.struct((x * side).alias("x"), (y * side).alias("y")) for x, y in ((c, r), (c + 1, r), (c + 1, r + 1), (c, r + 1))]
    corners = box(F.col("c"), F.col("r"))
    sense = named.select("poly_id", (area(F.col("points")) > 0).alias("left"))
    whole = known.where("not border").join(sense, "poly_id").select("poly_id", "c", "r", F.when(F.col("left"), F.array(*corners)).otherwise(F.array(*reversed(corners))).alias("points"))
    edge = known.where("border").select("poly_id", "c", "r")
    spans = edge.groupBy("poly_id", "r").agg(F.collect_set("c").alias("cs"))
    bands = named.select("poly_id", F.transform("points", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points")).join(spans, "poly_id")
    for bound, above in ((F.col("r") * side, True), ((F.col("r") + 1) * side, False)):
        bands = bands.withColumn("points", _half_plane(F.col("points"), bound, "y", above))
    parts = bands.withColumn("c", F.explode("cs"))
    for bound, above in ((F.col("c") * side, True), ((F.col("c") + 1) * side, False)):
        parts = parts.withColumn("points", _half_plane(F.col("points"), bound, "x", above))
    out = whole.unionByName(parts.where(F.size("points") > 2).select("poly_id", "c", "r", "points"))
    return out.select("poly_id.poly_id", "poly_id.ring", "c", "r", "points")


def split_at_crossings(lines: DataFrame, side: float) -> DataFrame:
    """(id, k, piece, x1, y1, x2, y2): segments (id, k, x1, y1, x2, y2) cut wherever one of another line crosses them; pieces go along the segment.

    A pair that meets in two tiles gives the same place twice, which the set of a segment's places takes once.
    """
    dealt = tiled(lines, side)
    pairs = _touching(dealt, dealt, ["id", "k"]).where("a_id <> b_id")
    a, b, c, d = (F.col(f"a{i}") for i in range(1, 5))
    e, f, g, h = (F.col(f"b{i}") for i in range(1, 5))
    turn = (c - a) * (h - f) - (d - b) * (g - e)
    share = F.when(turn != 0, ((e - a) * (h - f) - (f - b) * (g - e)) / turn)
    cuts = pairs.withColumn("share", F.round(share, 12)).where("share > 0 and share < 1").groupBy(F.col("a_id").alias("id"), F.col("a_k").alias("k")).agg(F.array_sort(F.collect_set("share")).alias("cuts"))
    whole = lines.join(cuts, ["id", "k"], "left").withColumn("cuts", F.concat(F.array(F.lit(0.0)), F.coalesce("cuts", F.array().cast("array<double>")), F.array(F.lit(1.0))))
    piece = whole.select("*", F.posexplode(F.slice("cuts", 2, 1_000_000_000)).alias("piece", "to")).withColumn("since", F.get("cuts", F.col("piece")))
    at = lambda t, p, q: F.col(p) + t * (F.col(q) - F.col(p))
    return piece.select("id", "k", "piece", at(F.col("since"), "x1", "x2").alias("x1"), at(F.col("since"), "y1", "y2").alias("y1"), at(F.col("to"), "x1", "x2").alias("x2"), at(F.col("to"), "y1", "y2").alias("y2"))
