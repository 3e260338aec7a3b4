"""Searches of graphs in rounds, tile by tile.

A tile is a set of neighbouring nodes that one task holds with the edges that leave them. In
a round every tile that has news works out, from the costs that came in, the costs of its own
nodes, and sends costs on along edges to other tiles; the next round is for tiles that got
any. So rounds grow with the tiles that a path crosses and not with its nodes, and neither
a graph nor the queries of one graph have to fit in a task: queries are dealt over lanes, too.
Each round writes what it found to the shared folder, and reads of edges and costs the tiles
alone that it is for, so the work of all rounds grows with the tiles that they settle.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import Tables, workers_can_import

TILE_NODES = 1 << 17
LANE_QUERIES = 8  # queries of one graph that a task answers
COMPACT = 8  # tables of rounds, or of so many merged ones, that are kept apart
MOST_KEYS = 1000  # parts of a round that are named in its filters; rounds of more read all

GRAPH = ["month", "vessel"]
_FOUND = "query_id long, lane int, month int, vessel string, tile long, node_id long, cost double, inside boolean"


def by_id(node: Column) -> Column:
    """Tiles of consecutive ids; graphs whose ids are not near each other in space need tiles of their own."""
    return F.floor(node / TILE_NODES).cast("long")


def _spread(cost: np.ndarray, first: np.ndarray, to: np.ndarray, weight: np.ndarray, fresh: dict[int, float]) -> set[int]:
    """Lower the costs of a tile's nodes, from fresh ones; the nodes that got a lower one. Targets outside are -1."""
    heap = [(c, k) for k, c in fresh.items() if c < cost[k]]
    for c, k in heap:
        cost[k] = c
    heapq.heapify(heap)
    lowered = {k for _, k in heap}
    while heap:
        c, k = heapq.heappop(heap)
        if c > cost[k]:
            continue
        a, b = first[k], first[k + 1]
        for near, w in zip(to[a:b].tolist(), weight[a:b].tolist(), strict=True):
            if near >= 0 and c + w < cost[near]:
                cost[near] = c + w
                lowered.add(near)
                heapq.heappush(heap, (c + w, near))
    return lowered


def _relax(key, rows: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    month, vessel, tile, lane = key
    names = np.unique(np.concatenate([rows["node_id"].to_numpy(np.int64), edges["source"].to_numpy(np.int64)]))
    edges = edges.sort_values(["source", "target"])
    source, target, weight = (edges[c].to_numpy() for c in ("source", "target", "weight"))
    source, target = source.astype(np.int64), target.astype(np.int64)
    first = np.searchsorted(source, names, side="left")
    first = np.append(first, len(source))
    at = np.minimum(np.searchsorted(names, target), len(names) - 1)
    to = np.where((edges["target_tile"].to_numpy() == tile) & (names[at] == target), at, -1) if len(edges) else at
    out = []
    for query, own in rows.groupby("query_id"):
        cost = np.full(len(names), np.inf)
        known, news = own[~own["fresh"]], own[own["fresh"]]
        cost[np.searchsorted(names, known["node_id"])] = known["cost"]
        best: dict[int, float] = {}
        for k, c in zip(np.searchsorted(names, news["node_id"]).tolist(), news["cost"].tolist(), strict=True):
            best[k] = min(c, best.get(k, np.inf))
        lowered = np.array(sorted(_spread(cost, first, to, weight, best)), np.int64)
        n = first[lowered + 1] - first[lowered]
        leaving = np.repeat(first[lowered] - np.cumsum(n) + n, n) + np.arange(n.sum())
        leaving = leaving[to[leaving] < 0]
        begin = np.searchsorted(names, source[leaving])
        for inside, tiles, nodes, costs in ((True, np.full(len(lowered), tile), names[lowered], cost[lowered]), (False, edges["target_tile"].to_numpy()[leaving], target[leaving], cost[begin] + weight[leaving])):
            out.append(pd.DataFrame({"query_id": query, "lane": lane, "month": month, "vessel": vessel, "tile": tiles, "node_id": nodes, "cost": costs, "inside": inside}))
    return pd.concat(out) if out else pd.DataFrame({c.split()[0]: [] for c in _FOUND.split(", ")})


class _Pile:
    """Tables of many rounds as one: ``COMPACT`` of a size are merged into one of the next, so a row is written again only as often as sizes grow."""

    def __init__(self, tables: Tables, merged: Callable[[DataFrame], DataFrame]):
        self.tables, self.merged, self.levels = tables, merged, []

    def add(self, df: DataFrame, level: int = 0) -> None:
        if level == len(self.levels):
            self.levels.append([])
        own = self.levels[level]
        own.append(df)
        if len(own) > COMPACT:
            self.levels[level] = []
            self.add(self.tables.keep(self.merged(reduce(DataFrame.unionByName, own)).repartition("tile").sortWithinPartitions("tile"), "merged"), level + 1)

    def rows(self, where: Column | None = None) -> DataFrame | None:
        parts = [df if where is None else df.where(where) for own in self.levels for df in own]
        return self.merged(reduce(DataFrame.unionByName, parts)) if parts else None


def _active(news: DataFrame, keys: list[str]) -> tuple[DataFrame, Column] | None:
    """What a round is for, and a filter on its tiles; None if it is for nothing."""
    own = news.select(*keys).distinct()
    rows = own.limit(MOST_KEYS + 1).collect()
    if not rows:
        return None
    if len(rows) > MOST_KEYS:
        return own, F.lit(True)
    return F.broadcast(news.sparkSession.createDataFrame(rows, own.schema)), F.col("tile").isin(sorted({r["tile"] for r in rows}))


def prepared(edges: DataFrame, tables: Tables, tile: Callable[[Column], Column] = by_id) -> DataFrame:
    """Edges (month, vessel, source, target, weight) with the tiles of both ends, written once for all that follows.

    An infinite weight is no edge, and one that is not positive is an error.
    """
    positive = F.when(F.col("weight") > 0, F.col("weight")).otherwise(F.raise_error(F.lit("weights must be positive")).cast("double"))
    finite = edges.where(F.col("weight") < float("inf")).select(*GRAPH, "source", "target", positive.alias("weight"))
    placed = finite.withColumns({"tile": tile(F.col("source")), "target_tile": tile(F.col("target"))})
    return tables.keep(placed.repartition("tile", *GRAPH), "edges", "tile")


def least_costs(starts: DataFrame, edges: DataFrame, tables: Tables, tile: Callable[[Column], Column] = by_id) -> DataFrame:
    """query_id, month, vessel, node_id, cost: the least cost of every node that a query's origin reaches.

    ``starts``: query_id, origin, month, vessel. ``edges``: of ``prepared``, with the same
    tiles. An origin that the graph does not have reaches itself alone, at no cost.
    """
    workers_can_import(starts.sparkSession)
    keys = [*GRAPH, "tile", "lane"]
    starts = tables.keep(starts.select("query_id", "origin", *GRAPH), "starts")
    most = starts.groupBy(*GRAPH).count().agg(F.max("count")).collect()[0][0] or 1
    lane = F.pmod(F.xxhash64("query_id"), F.lit(-(-most // LANE_QUERIES))).cast("int")
    news = starts.select("query_id", lane.alias("lane"), *GRAPH, tile(F.col("origin")).alias("tile"), F.col("origin").alias("node_id"), F.lit(0.0).alias("cost"))
    least = [*GRAPH, "tile", "lane", "query_id", "node_id"]
    best = lambda df: df.groupBy(*least).agg(F.min("cost").alias("cost"))
    found = _Pile(tables, best)
    while True:
        if (now := _active(news, keys)) is None:
            every = found.rows()
            return (news if every is None else every).select("query_id", *GRAPH, "node_id", "cost")
        active, there = now
        rows = news.withColumn("fresh", F.lit(True))
        if (so_far := found.rows(there)) is not None:
            rows = rows.unionByName(so_far.join(active, keys, "left_semi").withColumn("fresh", F.lit(False)))
        graph = edges.where(there).join(active, [*GRAPH, "tile"])
        step = tables.keep(rows.groupBy(*keys).cogroup(graph.groupBy(*keys)).applyInPandas(_relax, _FOUND), "round")
        found.add(step.where("inside").drop("inside"))
        news = best(step.where("not inside"))


_STEP = "query_id long, month int, vessel string, tile long, position long, node_id long, inside boolean"


def _walk(key, rows: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """From the asked nodes of a tile back to where their costs come from, until a way leaves the tile or ends."""
    month, vessel, tile, query = key
    asked, costs, entries = (rows[rows["kind"] == k] for k in (0, 1, 2))
    costs = costs.sort_values("node_id")
    names, cost = costs["node_id"].to_numpy(np.int64), costs["cost"].to_numpy()

    def at(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.minimum(np.searchsorted(names, nodes), len(names) - 1)
        return k, names[k] == nodes

    none = np.iinfo(np.int64).max
    before, tiles = np.full(len(names), none), np.full(len(names), tile)
    if len(names):
        source, target = edges["source"].to_numpy(np.int64), edges["target"].to_numpy(np.int64)
        (s, has_s), (t, has_t) = at(source), at(target)
        good = has_s & has_t & (cost[s] + edges["weight"].to_numpy() == cost[t]) & (cost[s] < cost[t])
        np.minimum.at(before, t[good], source[good])
        t, has_t = at(entries["node_id"].to_numpy(np.int64))
        good = has_t & (entries["cost"].to_numpy() == cost[t]) & (entries["before"].to_numpy() < cost[t])
        for k, node, own in zip(t[good].tolist(), entries["source"].to_numpy(np.int64)[good].tolist(), entries["source_tile"].to_numpy(np.int64)[good].tolist(), strict=True):
            if node < before[k]:
                before[k], tiles[k] = node, own
    back = {n: (p, x) for n, p, x in zip(names.tolist(), before.tolist(), tiles.tolist(), strict=True) if p != none}
    out = []
    for node, position in zip(asked["node_id"].tolist(), asked["position"].astype(np.int64).tolist(), strict=True):
        where = tile
        while True:
            out.append((query, month, vessel, where, position, node, where == tile))
            if where != tile or node not in back:
                break
            (node, where), position = back[node], position + 1
    return pd.DataFrame(out, columns=[c.split()[0] for c in _STEP.split(", ")])


def by_tile(costs: DataFrame, tables: Tables, tile: Callable[[Column], Column] = by_id) -> DataFrame:
    """Costs of ``least_costs`` with their tiles, written by these."""
    return tables.keep(costs.withColumn("tile", tile(F.col("node_id"))).repartition("tile", *GRAPH, "query_id"), "least", "tile")


def paths(asked: DataFrame, costs: DataFrame, edges: DataFrame, tables: Tables, tile: Callable[[Column], Column] = by_id) -> DataFrame:
    """query_id, month, vessel, path: the nodes from origin to goal, for goals that are reached.

    ``asked``: query_id, goal, month, vessel. ``costs``: those of ``least_costs`` over the same ``edges``, from ``by_tile``.
    Before each node comes the neighbour that accounts for its cost, of several the one with the smallest
    id. Paths are walked from the goal, a tile in each round, which reads that tile's costs, its edges
    and what came in from other tiles.
    """
    workers_can_import(asked.sparkSession)
    own = [*GRAPH, "query_id"]
    keys, kinds = [*GRAPH, "tile", "query_id"], ["kind", "node_id", "position", "cost", "before", "source", "source_tile"]
    crossing = edges.where("tile <> target_tile").select(*GRAPH, "source", F.col("tile").alias("source_tile"), F.col("target").alias("node_id"), F.col("target_tile").alias("tile"), "weight")
    before = costs.select(*own, F.col("node_id").alias("source"), F.col("cost").alias("before"))
    entries = before.join(crossing, [*GRAPH, "source"]).select(*own, "tile", "node_id", (F.col("before") + F.col("weight")).alias("cost"), "before", "source", "source_tile")
    entries = tables.keep(entries.repartition("tile", *GRAPH), "entries", "tile")
    goals = asked.select("query_id", *GRAPH, F.col("goal").alias("node_id")).join(costs.select(*own, "node_id"), [*own, "node_id"], "left_semi")
    news = goals.withColumns({"tile": tile(F.col("node_id")), "position": F.lit(0).cast("long")})
    walked = _Pile(tables, lambda df: df)

    def as_kind(df: DataFrame, kind: int) -> DataFrame:
        types = {"kind": "int", "cost": "double", "before": "double"}
        return df.withColumn("kind", F.lit(kind)).select(*keys, *((F.col(c) if c in (*df.columns, "kind") else F.lit(None).cast(types.get(c, "long"))).alias(c) for c in kinds))

    while (now := _active(news, keys)) is not None:
        active, there = now
        held = [as_kind(news, 0), *(as_kind(df.where(there).join(active, keys, "left_semi"), k + 1) for k, df in enumerate((costs, entries)))]
        inner = edges.where(there).where("tile = target_tile").join(active, [*GRAPH, "tile"]).select(*keys, "source", "target", "weight")
        part = tables.keep(reduce(DataFrame.unionByName, held).groupBy(*keys).cogroup(inner.groupBy(*keys)).applyInPandas(_walk, _STEP), "walk")
        walked.add(part.where("inside"))
        news = part.where("not inside").drop("inside")
    steps = walked.rows()
    if steps is None:
        steps = news.select(*own, "position", "node_id")
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("position", "node_id")), asc=False), lambda p: p.node_id)
    return steps.groupBy("query_id", *GRAPH).agg(in_order.alias("path"))
