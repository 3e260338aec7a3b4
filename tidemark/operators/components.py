"""Connected parts of a graph, and cycles taken apart, in rounds that grow with a logarithm."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import hexgrid
from tidemark.session import Tables


def _roots(parents: DataFrame, tables: Tables) -> DataFrame:
    """(node, parent) with each parent replaced by the end of its chain: pointers are doubled until none moves."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        doubled = parents.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("new"), "parent")
        doubled = tables.keep(doubled, "jump")
        moved = doubled.where("new <> parent").isEmpty()
        parents = doubled.select("node", F.col("new").alias("parent"))
        if moved:
            return parents


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, part): the smallest node that each of ``nodes`` (node) is connected with, by edges (source, target) of any sense.

    Each round hooks every node to its smallest neighbour, takes chains to their ends, and puts
    one node in place of each tree; what remains has at most half the nodes that had edges, or
    close to it. Edges whose ends are not among the nodes count as well. Each round is written.
    """
    tables = Tables(nodes.sparkSession)
    own = nodes.select("node").where("node is not null").distinct()
    left = tables.keep(edges.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct(), "edges")
    every = tables.keep(own.select("node", F.col("node").alias("part")).unionByName(left.select(F.explode(F.array("a", "b")).alias("node")).select("node", F.col("node").alias("part"))).distinct(), "parts")
    while not left.isEmpty():
        both = left.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(left.select(F.col("b").alias("node"), F.col("a").alias("other")))
        hooked = both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("parent"))
        roots = _roots(tables.keep(hooked, "hooked"), tables)
        every = tables.keep(every.join(roots.withColumnsRenamed({"node": "part", "parent": "root"}), "part", "left").select("node", F.coalesce("root", "part").alias("part")), "parts")
        a, b = roots.select(F.col("node").alias("a"), F.col("parent").alias("x")), roots.select(F.col("node").alias("b"), F.col("parent").alias("y"))
        joined = left.join(a, "a").join(b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        left = tables.keep(joined, "edges")
    return every.join(own, "node", "left_semi")


def cycles(links: DataFrame) -> DataFrame:
    """(node, cycle, position) of a permutation (node, after): the smallest node of each cycle, and how many steps from it.

    First the smallest node within 2, 4, 8 ... steps is passed along until none changes; then
    the steps back to it are added up over doubled pointers.
    """
    tables = Tables(links.sparkSession)
    seen = tables.keep(links.select("node", "after", F.least("node", "after").alias("cycle")), "links")
    reach = seen.select("node", F.col("after").alias("to"), "cycle")
    while True:
        ahead = reach.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("cycle").alias("other"))
        doubled = tables.keep(reach.join(ahead, "to").select("node", F.col("next").alias("to"), F.least("cycle", "other").alias("cycle"), (F.col("other") < F.col("cycle")).alias("changed")), "smallest")
        reach = doubled.drop("changed")
        if doubled.where("changed").isEmpty():
            break
    leader = tables.keep(reach.select("node", "cycle"), "leaders")
    # the way on to the leader: there it ends
    way = seen.select("node", "after").join(leader, "node").select("node", "cycle", F.when(F.col("node") == F.col("cycle"), F.col("node")).otherwise(F.col("after")).alias("to"), (F.col("node") != F.col("cycle")).cast("long").alias("steps"))
    way = tables.keep(way, "way")
    while not way.where("to <> cycle").isEmpty():
        on = way.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"))
        way = tables.keep(way.join(on, "to").select("node", "cycle", F.col("next").alias("to"), (F.col("steps") + F.col("more")).alias("steps")), "way")
    sizes = leader.groupBy("cycle").agg(F.count("*").alias("size"))
    return way.join(sizes, "cycle").select("node", "cycle", F.when(F.col("steps") == 0, 0).otherwise(F.col("size") - F.col("steps")).cast("long").alias("position"))


def outlines(table: DataFrame, group: str, cell: str) -> DataFrame:
    """(group, ring, points): the outlines of the union of each group's cells, as arrays of (x, y) = (lng, lat).

    A side between two cells of a group cancels; what is left is chained by its corners, which
    are named by the three cells that meet there, so no coordinate is compared. Outer rings run
    counterclockwise, holes clockwise. Cells over the antimeridian are not cut.
    """
    own = table.select(F.col(group).alias("grp"), F.col(cell).alias("cell")).distinct()
    tables = Tables(table.sparkSession)
    round_ = own.withColumns({"around": hexgrid.around(F.col("cell")), "corners": hexgrid.boundary(F.col("cell"))})
    n = F.col("around")
    key = lambda i: F.array_sort(F.array(F.col("cell"), F.get(n, F.pmod(i, F.size(n))), F.get(n, F.pmod(i + 1, F.size(n)))))
    sides = F.transform(n, lambda x, i: F.struct(x.alias("other"), key(i - 1).alias("since"), key(i).alias("to"), F.get(F.col("corners"), F.pmod(i - 1, F.size(n))).alias("at")))
    all_sides = round_.select("grp", "cell", F.explode(sides).alias("s")).select("grp", "cell", "s.*")
    outer = tables.keep(all_sides.join(own.withColumnRenamed("cell", "other"), ["grp", "other"], "left_anti"), "sides")
    node = lambda c: F.struct("grp", F.col(c).alias("corner"))
    found = cycles(outer.select(node("since").alias("node"), node("to").alias("after")))
    at = outer.select(node("since").alias("node"), F.struct(F.col("at.lng").alias("x"), F.col("at.lat").alias("y")).alias("p"))
    placed = found.join(at, "node").select("node.grp", "cycle", F.struct("position", "p").alias("q"))
    rings = placed.groupBy("grp", "cycle").agg(F.transform(F.array_sort(F.collect_list("q")), lambda q: q["p"]).alias("points"))
    return rings.select(F.col("grp").alias(group), F.col("cycle.corner").alias("ring"), "points")
