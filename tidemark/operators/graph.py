"""Building and checking graphs: edges, attributes, adjacency, reachability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.geo import edge_vector, great_circle
from tidemark.functions.names import free_name
from tidemark.operators import search
from tidemark.session import Tables


def canonical(edges: DataFrame) -> DataFrame:
    """Undirected edges once, the smaller end first, without self-loops and nulls; of repeats the least by all other columns."""
    s, t = F.least("source", "target"), F.greatest("source", "target")
    turned = F.col("source") > F.col("target")
    out = edges.where("source <> target").withColumns({c: F.when(turned, -F.col(c)).otherwise(F.col(c)) for c in ("dx", "dy") if c in edges.columns} | {"source": s, "target": t})
    rest = [c for c in edges.columns if c not in ("source", "target")]
    if not rest:
        return out.distinct()
    return out.groupBy("source", "target").agg(F.min(F.struct(*rest)).alias("first")).select("source", "target", "first.*")


def with_geometry(edges: DataFrame) -> DataFrame:
    """length_m, dx, dy from both ends' coordinates; edges without them go."""
    ends = [F.col(c) for c in ("lat1", "lng1", "lat2", "lng2")]
    dx, dy = edge_vector(*ends)
    return edges.dropna(subset=["lat1", "lng1", "lat2", "lng2"]).withColumns({"length_m": great_circle(*ends), "dx": dx, "dy": dy})


def with_endpoints(edges: DataFrame, line: str) -> DataFrame:
    """lat1, lng1, lat2, lng2 from the first and last vertex of a line of (x, y); all null where it has fewer than two."""
    whole = F.size(line) >= 2
    first, last = (F.when(whole, F.try_element_at(F.col(line), F.lit(k))) for k in (1, -1))
    return edges.withColumns({"lat1": first["y"], "lng1": first["x"], "lat2": last["y"], "lng2": last["x"]})


def both_directions(edges: DataFrame) -> DataFrame:
    """Add the reverse of each edge that has none, with its vector turned."""
    back = edges.withColumns({"source": F.col("target"), "target": F.col("source"), "dx": -F.col("dx"), "dy": -F.col("dy")})
    missing = back.join(edges.select("source", "target"), ["source", "target"], "left_anti").select(edges.columns)
    return edges.unionByName(missing)


def first_valid_month(env: DataFrame, key: str, month: str, columns: list[str]) -> DataFrame:
    """A node's statics: those of its first month that is not null, null or not."""
    return env.where(F.col(month).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*columns), month).alias("first")).select(key, "first.*")


def nested_by_month(env: DataFrame, key: str, month: str, columns: list[str]) -> DataFrame:
    """node -> map of month to its record; the last of repeated months by all columns stays."""
    once = env.where(F.col(month).isNotNull()).groupBy(key, month).agg(F.max(F.struct(*columns)).alias("record"))
    return once.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(month, "record")))).alias("env"))


def last_wins(rows: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """Upsert: of rows with equal keys the one with the largest sequence."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), sequence).alias("last")).select(*keys, "last.*")


def first_wins(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """Of rows with equal keys the first in a stated order."""
    n = free_name(rows, "n")
    return rows.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(n) == 1).drop(n)


def merged(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Tables of one schema as one; of rows with equal keys that of the later table, and within a table the largest."""
    rest = [c for c in tables[0].columns if c not in keys]
    turn = free_name(tables[0], "turn")
    rows = [t.withColumn(turn, F.lit(k)) for k, t in enumerate(tables)]
    both = rows[0]
    for r in rows[1:]:
        both = both.unionByName(r)
    return both.groupBy(*keys).agg(F.max(F.struct(turn, *rest)).alias("last")).select(*keys, *(f"last.{c}" for c in rest))


def keep_existing(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Existing rows, and new ones whose key is new."""
    return existing.unionByName(new.join(existing.select(key), key, "left_anti"))


def adjacency(edges: DataFrame, weight: str) -> DataFrame:
    """node -> map of neighbour to weight; of parallel edges the lightest."""
    light = edges.groupBy("source", "target").agg(F.min(weight).alias(weight))
    return light.groupBy("source").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("target", weight)))).alias("neighbours"))


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("lat").isNull()).alias("nodes_without_lat"))
    e = edges.agg(F.count("*").alias("edges"), F.count_if(F.col("source") > F.col("target")).alias("not_canonical"), F.avg("length_m").alias("mean_length_m"))
    return n.crossJoin(e)


def reachable(edges: DataFrame, start: int) -> DataFrame:
    """node_id, hops over undirected edges from a node; that node alone if it has no edge."""
    one = lambda a, b: edges.select(F.lit(0).alias("month"), F.lit("").alias("vessel"), F.col(a).alias("source"), F.col(b).alias("target"), F.lit(1.0).alias("weight"))
    origin = edges.sparkSession.createDataFrame([(0, start, 0, "")], "query_id long, origin long, month int, vessel string")
    tables = Tables(edges.sparkSession)
    found = search.least_costs(origin, search.prepared(one("source", "target").unionByName(one("target", "source")), tables), tables)
    return found.select("node_id", F.col("cost").cast("long").alias("hops"))
