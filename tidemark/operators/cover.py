"""Cells in rings and levels: neighbours, frontiers, sight of land, edges between resolutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import hexgrid
from tidemark.functions.cells import is_pentagon, lattice_distance, neighbours
from tidemark.functions.geo import great_circle, tile_x, tile_y
from tidemark.operators import polygons
from tidemark.operators.components import connected
from tidemark.session import Tables

_SPREAD = 96  # tasks for what is dear for each row, however few bytes the rows have


def disk(cells: DataFrame, k: int) -> DataFrame:
    """Each cell (node_id, r, c) with all places (nr, nc) up to k steps away and their distance; ring k alone has distance k.

    A disk has 3k(k + 1) + 1 places, made by Spark's own sequence and filter.
    """
    steps = F.sequence(F.lit(-k), F.lit(k))
    around = cells.withColumn("nr", F.explode(F.transform(steps, lambda d: F.col("r") + d))).withColumn("nc", F.explode(F.transform(F.sequence(F.lit(-k - 1), F.lit(k + 1)), lambda d: F.col("c") + d)))
    return around.withColumn("distance", lattice_distance(F.col("r"), F.col("c"), F.col("nr"), F.col("nc"))).where(F.col("distance") <= k)


def neighbour_pairs(cells: DataFrame) -> DataFrame:
    """(source, target), the smaller first, of adjacent cells."""
    around = cells.select(F.col("node_id").alias("source"), F.explode(neighbours(F.col("r"), F.col("c"))).alias("n")).select("source", F.col("n.r").alias("r"), F.col("n.c").alias("c"))
    return around.join(cells.select(F.col("node_id").alias("target"), "r", "c"), ["r", "c"]).where("source < target").select("source", "target")


def adjacent(cells: DataFrame, col: str) -> DataFrame:
    """(source, target), the smaller first, of adjacent cell ids."""
    own = cells.select(F.col(col).alias("source")).distinct()
    around = own.withColumn("target", F.explode(hexgrid.neighbours(F.col("source")))).where("source < target")
    return around.join(own.select(F.col("source").alias("target")), "target", "left_semi").select("source", "target")


def frontier(cells: DataFrame) -> DataFrame:
    """Cells with fewer than six neighbours, and how many."""
    pairs = neighbour_pairs(cells)
    both = pairs.select(F.col("source").alias("node_id")).unionByName(pairs.select(F.col("target").alias("node_id")))
    n = both.groupBy("node_id").agg(F.count("*").alias("n"))
    return cells.select("node_id").join(n, "node_id", "left").select("node_id", F.coalesce("n", F.lit(0)).alias("n_neighbours")).where("n_neighbours < 6")


def sight_of_land(sea: DataFrame, land: DataFrame, rings: int = 13) -> DataFrame:
    """node_id, the nearest land cell that is visible, and its distance to the millimetre (of equal ones the least id).

    Land (node_id, r, c, lat, lng, sight_m) is visible within its own sight distance. Sea and
    land meet in blocks of the lattice that are rings + 1 wide: land goes to the blocks that its
    rings touch, at most nine, and a cell of the sea is in one. A block has a bounded number of
    places, so the join is never a broadcast of what the land was spread to.
    """
    side = rings + 1
    block = lambda c: F.floor(c / side).cast("long")
    touched = lambda c, more: F.explode(F.sequence(block(F.col(c) - rings - more), block(F.col(c) + rings + more)))
    seen = land.select(F.col("node_id").alias("land_id"), F.col("lat").alias("llat"), F.col("lng").alias("llng"), "sight_m", F.col("r").alias("lr"), F.col("c").alias("lc"))
    seen = seen.withColumn("block_r", touched("lr", 0)).withColumn("block_c", touched("lc", 1)).hint("merge")
    placed = sea.select("node_id", "lat", "lng", "r", "c", block(F.col("r")).alias("block_r"), block(F.col("c")).alias("block_c"))
    near = placed.join(seen, ["block_r", "block_c"]).where(lattice_distance(F.col("lr"), F.col("lc"), F.col("r"), F.col("c")) <= rings)
    pairs = near.withColumn("d", great_circle(F.col("lat"), F.col("lng"), F.col("llat"), F.col("llng"))).where("d < sight_m")
    best = pairs.groupBy("node_id").agg(F.min(F.struct(F.round("d", 3).alias("d"), "land_id")).alias("best"))
    return best.select("node_id", F.col("best.d").alias("distance_to_visible_land_m"), F.col("best.land_id").alias("visible_land_id"))


def _in_rows(places: DataFrame, cells: DataFrame, most: int) -> DataFrame:
    """For each place (pr, pc) of the lattice the cells of the first ring with any that may be nearest to a point there: pr, pc, distance and the cell.

    Each row of the lattice up to ``most`` rows away has its two last cells up to the place and its two
    first ones after it, by degrees: no other cell of the row is nearer to a point of the place, which lies
    a step away at most. Places are as many as the lattice has, however many points they hold.
    """
    rows = F.explode(F.transform(F.sequence(F.lit(-most), F.lit(most)), lambda d: F.col("pr") + d))
    middle = lambda r, c: F.col(c) + F.pmod(F.col(r), F.lit(2)) / 2
    asked = places.select("pr", "pc", rows.alias("r")).withColumn("x", middle("pr", "pc"))
    asked = asked.join(cells.select("r").distinct(), "r", "left_semi")  # rows without cells are not asked
    placed = cells.select("r", middle("r", "c").alias("x"), F.struct("node_id", "c", "lat", "lng").alias("cell"))
    by = Window.partitionBy("r")
    known = placed.withColumns({"two": F.array_compact(F.array(F.lag("cell").over(by.orderBy("x")), F.col("cell"))), "after": F.array_compact(F.array("cell", F.lead("cell").over(by.orderBy("x"))))})
    both = asked.unionByName(known.drop("cell"), allowMissingColumns=True)
    upto = lambda c, x: F.last(c, ignorenulls=True).over(by.orderBy(x, F.col("pc").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    near = both.withColumns({"a": upto("two", F.col("x").asc()), "b": upto("after", F.col("x").desc())}).where("pc is not null")
    each = near.select("pr", "pc", "r", F.explode(F.array_distinct(F.concat(*(F.coalesce(k, F.array().cast(known.schema["two"].dataType)) for k in ("a", "b"))))).alias("cell")).select("pr", "pc", "r", "cell.*")
    ring = each.withColumn("distance", lattice_distance(F.col("pr"), F.col("pc"), F.col("r"), F.col("c"))).where(F.col("distance") <= most)
    return ring.withColumn("first", F.min("distance").over(Window.partitionBy("pr", "pc"))).where("distance = first").drop("first")


def snapped(points: DataFrame, cells: DataFrame, most: int = 50, near: int = 3) -> DataFrame:
    """The graph cell nearest to each point (point_id, r, c, plat, plng): of the first ring with any, by squared degrees, then id.

    Rings up to ``near`` are looked up cell by cell. Places of points without a cell there look at the
    rows of the lattice up to ``most`` rings away; beyond that node_id and ring are null. Points lie within
    a step of their place in longitude.
    """
    cells, points = cells.select("node_id", "r", "c", "lat", "lng"), points.repartition(_SPREAD)
    d2 = F.pow(F.col("lat") - F.col("plat"), 2) + F.pow(F.col("lng") - F.col("plng"), 2)

    def best(candidates: DataFrame) -> DataFrame:
        return candidates.groupBy("point_id").agg(F.min(F.struct("distance", d2.alias("d2"), "node_id")).alias("best"))

    close = best(disk(points, min(near, most)).drop("r", "c").withColumnsRenamed({"nr": "r", "nc": "c"}).join(cells, ["r", "c"]))
    if most > near:
        far = points.join(close, "point_id", "left_anti").withColumnsRenamed({"r": "pr", "c": "pc"})
        close = close.unionByName(best(far.join(_in_rows(far.select("pr", "pc").distinct(), cells, most), ["pr", "pc"])))
    return points.select("point_id").join(close, "point_id", "left").select("point_id", F.col("best.node_id").alias("node_id"), F.col("best.distance").alias("ring"))


def snapped_to_cells(points: DataFrame, table: DataFrame, level: int, most: int = 3) -> DataFrame:
    """(point_id, cell, ring): the cell (cell) of a table nearest to each point (point_id, lat, lng): of the first ring around the point's own cell with any, by squared degrees, then id.

    Points without a cell up to ``most`` rings away get nulls. The first ring with any is the
    same for all points of a cell, so rings are made once for each cell that holds points and is
    not in the table itself, 3 most (most + 1) + 1 cells each; a point then meets one ring.
    """
    tables = Tables(points.sparkSession)
    asked = tables.keep(points.repartition(_SPREAD).select("point_id", "lat", "lng", hexgrid.cell_at(F.col("lat"), F.col("lng"), level).alias("own")), "asked")
    have = tables.keep(table.select("cell").where("cell is not null").distinct(), "cells")
    own = tables.keep(asked.where("own is not null").select("own").distinct().repartition(_SPREAD, "own"), "own")
    there = own.join(have.select(F.col("cell").alias("own")), "own", "left_semi").select("own", F.lit(0).alias("ring"), F.col("own").alias("cell"))
    away = own.join(have.select(F.col("cell").alias("own")), "own", "left_anti").repartition(_SPREAD, "own").select("own", F.posexplode(hexgrid.rings(F.col("own"), most)).alias("ring", "cells"))
    hits = away.select("own", "ring", F.explode("cells").alias("cell")).join(have, "cell")
    first = hits.groupBy("own").agg(F.min("ring").alias("ring"))
    near = hits.join(first, ["own", "ring"]).select("own", "ring", "cell").unionByName(there).withColumn("at", hexgrid.center(F.col("cell")))
    near = tables.keep(near.select("own", "ring", "cell", F.col("at.lat").alias("clat"), F.col("at.lng").alias("clng")), "near")
    d2 = F.pow(F.col("clat") - F.col("lat"), 2) + F.pow(F.col("clng") - F.col("lng"), 2)
    best = asked.join(near, "own").groupBy("point_id").agg(F.min(F.struct("ring", d2.alias("d2"), "cell")).alias("best"))
    return asked.select("point_id").join(best, "point_id", "left").select("point_id", "best.cell", "best.ring")


def cross_level_edges(cells: DataFrame, ancestors: list[tuple[Column, DataFrame]]) -> DataFrame:
    """Edges from cells with a missing neighbour to the coarse cell that holds the missing place.

    ``ancestors``: for the parent, the grandparent and so on, the coarse cell of a place (r, c)
    and the cells (cell) that this level has. The first level that has the cell is taken.
    """
    around = cells.select(F.col("node_id").alias("source"), F.explode(neighbours(F.col("r"), F.col("c"))).alias("n")).select("source", F.col("n.r").alias("r"), F.col("n.c").alias("c"))
    missing = around.join(cells.select("r", "c"), ["r", "c"], "left_anti")
    for k, (cell, level) in enumerate(ancestors):
        missing = missing.withColumn(f"cell{k}", cell).join(level.select(F.col("cell").alias(f"cell{k}"), F.lit(True).alias(f"there{k}")).distinct(), f"cell{k}", "left")
    target = F.coalesce(*(F.when(F.col(f"there{k}"), F.col(f"cell{k}")) for k in range(len(ancestors))))
    return missing.select("source", target.alias("target")).where("target is not null").distinct()


def classified(cells: DataFrame, diameter: Column, buffer: Column, within_land: Column) -> DataFrame:
    """sea_only, land_dem, land_only, littoral and whether a cell is refined at the next level.

    From dist_m (to the coast), intersects (the land) and closest_m (null unless it does).
    A comparison with an unknown distance is false.
    """
    true_ = lambda x: F.coalesce(x, F.lit(False))
    out = cells.withColumn("sea_only", true_((F.col("dist_m") > diameter) & ~F.col("intersects")))
    out = out.withColumn("land_dem", ~F.col("sea_only") & true_(F.col("closest_m") <= buffer)).withColumn("land_only", ~F.col("sea_only") & true_(F.col("closest_m") >= 0))
    out = out.withColumn("littoral", F.col("land_dem") & ~within_land)
    return out.withColumn("refined", (~F.col("sea_only") & ~F.col("land_only")) | F.col("littoral"))


def frontier_parts(table: DataFrame, col: str) -> DataFrame:
    """(cell, n_neighbours, part): cell ids with fewer neighbours in the table than on the globe, and the smallest cell of the frontier each is connected with."""
    own = table.select(F.col(col).alias("cell")).distinct()
    pairs = Tables(table.sparkSession).keep(adjacent(own, "cell"), "adjacent")
    n = pairs.select(F.explode(F.array("source", "target")).alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
    open_ = own.join(n, "cell", "left").select("cell", F.coalesce("n", F.lit(0)).alias("n_neighbours")).where(F.col("n_neighbours") < F.when(is_pentagon(F.col("cell")), 5).otherwise(6))
    edge = open_.select(F.col("cell").alias("source"))
    along = pairs.join(edge, "source", "left_semi").join(edge.withColumnRenamed("source", "target"), "target", "left_semi")
    return open_.join(connected(open_.select(F.col("cell").alias("node")), along).withColumnRenamed("node", "cell"), "cell")


def joined_parts(points: DataFrame, reach_m: float) -> DataFrame:
    """(part_a, part_b, source, target, d): for each two parts of planar points (node_id, part, x, y) within reach the two nearest points, to the millimetre, then by id."""
    cell = lambda c: F.floor(F.col(c) / reach_m).cast("long")
    placed = points.select(F.col("node_id").alias("target"), F.col("part").alias("part_b"), F.col("x").alias("tx"), F.col("y").alias("ty")).withColumns({"gx": cell("tx"), "gy": cell("ty")})
    spread = F.explode(F.array(*(F.struct((cell("x") + i).alias("gx"), (cell("y") + j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    asked = points.select(F.col("node_id").alias("source"), F.col("part").alias("part_a"), "x", "y").withColumn("g", spread).select("source", "part_a", "x", "y", "g.*")
    near = asked.join(placed, ["gx", "gy"]).where("part_a < part_b").withColumn("d", F.hypot(F.col("x") - F.col("tx"), F.col("y") - F.col("ty"))).where(F.col("d") <= reach_m)
    best = near.groupBy("part_a", "part_b").agg(F.min(F.struct(F.round("d", 3).alias("d"), "source", "target")).alias("b"))
    return best.select("part_a", "part_b", "b.source", "b.target", "b.d")


def knn(left: DataFrame, right: DataFrame, k: int, reach_m: float, cell_m: float) -> DataFrame:
    """(left_id, right_id, d) of the k nearest within reach, to the millimetre, then by id: planar (x, y) points meet in cells as wide as the reach."""
    cell = lambda c: F.floor(F.col(c) / cell_m).cast("long")
    span = int(-(-reach_m // cell_m))
    spread = F.explode(F.array(*(F.struct((cell("lx") + i).alias("gx"), (cell("ly") + j).alias("gy")) for i in range(-span, span + 1) for j in range(-span, span + 1))))
    asked = left.withColumn("g", spread).select("left_id", "lx", "ly", "g.*")
    placed = right.withColumns({"gx": cell("rx"), "gy": cell("ry")})
    close = asked.join(placed, ["gx", "gy"]).withColumn("d", F.sqrt(F.pow(F.col("lx") - F.col("rx"), 2) + F.pow(F.col("ly") - F.col("ry"), 2))).where(F.col("d") <= reach_m)
    order = Window.partitionBy("left_id").orderBy(F.round("d", 3), "right_id")
    return close.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("left_id", "right_id", "d")


def stitched(one: DataFrame, other: DataFrame, k: int, reach_m: float) -> DataFrame:
    """(source, target), the smaller first, between two levels of planar points (node_id, x, y): each point's k nearest of the other level within reach, from both sides."""
    left, right = (t.select("node_id", "x", "y") for t in (one, other))
    found = [knn(a.toDF("left_id", "lx", "ly"), b.toDF("right_id", "rx", "ry"), k, reach_m, reach_m) for a, b in ((left, right), (right, left))]
    return found[0].unionByName(found[1]).select(F.least("left_id", "right_id").alias("source"), F.greatest("left_id", "right_id").alias("target")).distinct()


def nearest_any(left: DataFrame, right: DataFrame, side_m: float) -> DataFrame:
    """(left_id, right_id, d) of the nearest, however far: to the millimetre, then by id. No rows for an empty right side.

    Branch and bound over a pyramid of tiles, the smallest ``side_m`` wide, see ``polygons``.
    """
    dots = right.select(F.col("right_id").alias("id"), F.col("rx").alias("x1"), F.col("ry").alias("y1"), F.col("rx").alias("x2"), F.col("ry").alias("y2"))
    near = polygons.nearest_segment(left.select(F.col("left_id").alias("point_id"), F.col("lx").alias("x"), F.col("ly").alias("y")), polygons.pyramid(dots, side_m), decimals=3)
    return near.select(F.col("point_id").alias("left_id"), F.col("id").alias("right_id"), "d")


def tiles(cells: DataFrame, zoom: int) -> DataFrame:
    """Each cell (cell, south, west, north, east) with all tiles (x, y) of a zoom that its box touches."""
    xs = F.sequence(tile_x(F.col("west"), zoom), tile_x(F.col("east"), zoom))
    ys = F.sequence(tile_y(F.col("north"), zoom), tile_y(F.col("south"), zoom))
    return cells.withColumn("x", F.explode(xs)).withColumn("y", F.explode(ys)).select("cell", "x", "y")
