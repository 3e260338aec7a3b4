"""From layers to a graph on disk, stage by stage, and the queries of what that takes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.operators import climate, cover, graph, lines
from tidemark.plans.catalogue import _HORIZON, query, six, world_edges
from tidemark.sources import files
from tidemark.sources.world import view
from tidemark.streaming.incremental import append_new

#: Datasets by name and the variables taken from each.
DATASETS: dict[str, list[str]] = {"wind": ["wind_x", "wind_y"], "currents": ["current_x", "current_y"], "sea": ["swell_height", "wave_height"], "weather": ["visibility_m"], "dem": ["max_elevation_m"]}


def registry(spark: SparkSession, datasets: dict[str, list[str]], skip: tuple[str, ...] = ("dem",)) -> DataFrame:
    """dataset, label, variables of a registry; ``skip`` names those that are no time series."""
    table = spark.createDataFrame(list(datasets.items()), "dataset string, variables array<string>")
    return table.where(~F.col("dataset").isin(*skip)).select("dataset", F.initcap("dataset").alias("label"), F.array_join("variables", ",").alias("variables"))


def stages(spark: SparkSession, sf_dir: str) -> list[tuple[str, str, Callable[[], DataFrame]]]:
    """(table, key, rows) of the build: nodes with the statics, conditions by month, edges with their geometry."""
    nodes = lambda: view(spark, sf_dir, "w_nodes").select("node_id", "lat", "lng", "bathymetry", "daylight_ratio", "clear_land")
    conditions = lambda: graph.nested_by_month(view(spark, sf_dir, "w_env"), "node_id", "month", ["wind_x", "wind_y", "visibility_m"])
    edges = lambda: graph.canonical(world_edges(spark, sf_dir)).withColumn("edge", F.concat_ws("-", "source", "target"))
    return [("nodes", "node_id", nodes), ("conditions", "node_id", conditions), ("edges", "edge", edges)]


def build(spark: SparkSession, sf_dir: str, path: str, name: str = "world") -> dict[str, int]:
    """Write the graph's tables and metadata below ``path``; rows added by each stage. A second run, or one after a stop, adds what is missing."""
    added = {table: append_new(spark, rows(), f"{path}/{table}", key, lambda new: new) for table, key, rows in stages(spark, sf_dir)}
    nodes, edges = (spark.read.parquet(f"{path}/{t}") for t in ("nodes", "edges"))
    files.write_metadata(nodes, edges, f"{path}/metadata", name)
    return added


@query(
    "SELECT dataset, upper(dataset[1]) || dataset[2:] AS label, variables, n FROM (SELECT 'wind' AS dataset, 'wind_x,wind_y' AS variables, count(wind_x) + count(wind_y) AS n FROM w_env UNION ALL SELECT 'currents', 'current_x,current_y', count(current_x) + count(current_y) FROM w_env "
    "UNION ALL SELECT 'sea', 'swell_height,wave_height', count(swell_height) + count(wave_height) FROM w_env UNION ALL SELECT 'weather', 'visibility_m', count(visibility_m) FROM w_env)"
)
def dataset_registry(spark, sf_dir):
    """The datasets with their labels, and how many values of their variables there are."""
    names = [v for k, vs in DATASETS.items() if k != "dem" for v in vs]
    counts = view(spark, sf_dir, "w_env").agg(*(F.count(v).alias(v) for v in names))
    have = counts.select(F.explode(F.create_map(*(x for v in names for x in (F.lit(v), F.col(v))))).alias("variable", "n"))
    known = registry(spark, DATASETS)
    asked = known.select("dataset", F.explode(F.split("variables", ",")).alias("variable")).join(have, "variable").groupBy("dataset").agg(F.sum("n").alias("n"))
    return known.join(asked, "dataset").select("dataset", "label", "variables", "n")


@query(
    "WITH first AS (SELECT source, target, 1 AS seq, length_w AS w FROM (SELECT *, (source + target)::DOUBLE AS length_w FROM w_edges)), later AS (SELECT source, target, 2 AS seq, -1.0::DOUBLE AS w FROM w_edges WHERE target % 3 = 0 UNION ALL SELECT source, source + 100000, 2, 5.0 FROM w_edges WHERE source % 5 = 0 GROUP BY source), "
    "merged AS (SELECT source, target, arg_max(w, seq) AS w FROM (SELECT * FROM first UNION ALL SELECT * FROM later) GROUP BY ALL) SELECT source, count(*) AS neighbours, string_agg(target || '=' || w::BIGINT, ',' ORDER BY target) AS weights FROM merged GROUP BY source"
)
def merged_adjacency(spark, sf_dir):
    """Two adjacencies merged, the later one's weights first."""
    e = view(spark, sf_dir, "w_edges").select("source", "target")
    first = e.withColumn("w", (F.col("source") + F.col("target")).cast("double"))
    far = e.where("source % 5 = 0").select("source").distinct().select("source", (F.col("source") + 100_000).alias("target"), F.lit(5.0).alias("w"))
    merged = graph.merged([first, e.where("target % 3 = 0").withColumn("w", F.lit(-1.0)).unionByName(far)], ["source", "target"])
    entry = F.concat_ws("=", "target", F.col("w").cast("long"))
    listed = merged.groupBy("source").agg(F.count("*").alias("neighbours"), F.sort_array(F.collect_list(F.struct("target", entry.alias("entry")))).alias("all"))
    return listed.select("source", "neighbours", F.array_join(F.col("all.entry"), ",").alias("weights"))


@query(f"WITH s AS (SELECT node_id, {_HORIZON.format(h='max_elevation_m')} + {_HORIZON.format(h='3.5')} AS sight FROM w_land) SELECT node_id, round(sight / (SELECT max(sight) FROM s), 6) AS share FROM s")
def share_of_greatest_horizon(spark, sf_dir):
    land = view(spark, sf_dir, "w_land").select("node_id", geo.deck_visibility_m(F.col("max_elevation_m")).alias("sight"))
    return land.crossJoin(F.broadcast(land.agg(F.max("sight").alias("greatest")))).select("node_id", six(F.col("sight") / F.col("greatest")).alias("share"))


@query("SELECT kind, max(level) AS level, arg_max(kind || '_r' || level, level) AS layer FROM (SELECT CASE WHEN node_id % 2 = 0 THEN 'hexes' ELSE 'edges' END AS kind, node_id % 11 AS level FROM w_nodes) GROUP BY kind")
def finest_layers(spark, sf_dir):
    kind = F.when(F.col("node_id") % 2 == 0, "hexes").otherwise("edges")
    return files.finest(view(spark, sf_dir, "w_nodes").select(F.concat(kind, F.lit("_r"), (F.col("node_id") % 11).cast("string")).alias("layer")))


@query("SELECT port_id, k, floor(lng) + k * 0.25e0 AS x FROM (SELECT port_id, lng, unnest(range(0, CAST(ceil((lng + 1 - floor(lng)) / 0.25e0) AS BIGINT))) AS k FROM w_ports)")
def float_ranges(spark, sf_dir):
    steps = lines.stepped(F.floor("lng").cast("double"), F.col("lng") + 1, F.lit(0.25))
    return view(spark, sf_dir, "w_ports").select("port_id", F.posexplode(steps).alias("k", "x")).select("port_id", F.col("k").cast("long").alias("k"), "x")


@query("SELECT k, CASE WHEN k IN (0, 3, 4) THEN w ELSE e END AS x, CASE WHEN k IN (0, 1, 4) THEN s ELSE n END AS y FROM (SELECT min(lng) AS w, max(lng) AS e, min(lat) AS s, max(lat) AS n FROM w_nodes), (SELECT unnest(range(0, 5)) AS k)")
def aoi_rectangle(spark, sf_dir):
    box = view(spark, sf_dir, "w_nodes").agg(F.min("lng").alias("w"), F.min("lat").alias("s"), F.max("lng").alias("e"), F.max("lat").alias("n"))
    ring = lines.rectangle(*(F.col(c) for c in "wsen"))
    return box.select(F.posexplode(ring).alias("k", "p")).select(F.col("k").cast("long").alias("k"), "p.x", "p.y")


@query(
    "SELECT p.port_id, m.month, n.node_id, round(e.wind_x, 6) AS wind_x, round(e.swell_height, 6) AS swell_height, round(e.visibility_m, 6) AS visibility_m FROM w_ports p CROSS JOIN (SELECT unnest(range(1, 13))::INT AS month) m "
    "LEFT JOIN w_nodes n ON n.r = floor((p.lat - 49.5)/0.05 + 0.5)::BIGINT AND n.c = floor((p.lng + 11.0)/0.1 + 0.5)::BIGINT LEFT JOIN w_env e ON e.node_id = n.node_id AND e.month = m.month"
)
def point_months(spark, sf_dir):
    """All variables of each port in all months, from the nearest cell; null where a month lacks them."""
    raster = view(spark, sf_dir, "w_nodes").select(F.col("r").alias("gy"), F.col("c").alias("gx"), "node_id")
    sampled = climate.nearest_samples(view(spark, sf_dir, "w_ports").select("port_id", "lat", "lng"), raster, (49.5, -11.0), (0.05, 0.1))
    conditions = view(spark, sf_dir, "w_env").select("node_id", "month", *(six(c).alias(c) for c in ("wind_x", "swell_height", "visibility_m")))
    return climate.by_month(sampled.select("port_id", "node_id"), conditions, "node_id").select("port_id", "month", "node_id", "wind_x", "swell_height", "visibility_m")


@query(
    "WITH m AS (SELECT node_id, 6378137.0*radians(lng) AS x, 6378137.0*ln(tan(radians(lat)/2+pi()/4)) AS y FROM w_nodes), l AS (SELECT node_id, 6378137.0*radians(lng) AS x, 6378137.0*ln(tan(radians(lat)/2+pi()/4)) AS y FROM w_land) "
    "SELECT left_id, right_id, round(d, 3) AS d FROM (SELECT l.node_id AS left_id, m.node_id AS right_id, sqrt(pow(l.x-m.x,2)+pow(l.y-m.y,2)) AS d, row_number() OVER (PARTITION BY l.node_id ORDER BY round(sqrt(pow(l.x-m.x,2)+pow(l.y-m.y,2)), 3), m.node_id) AS n FROM l CROSS JOIN m) WHERE n = 1"
)
def nearest_irregular(spark, sf_dir):
    """The nearest point of a set that lies on no grid, however far."""
    at = lambda name, *to: view(spark, sf_dir, name).select("node_id", geo.mercator_x(F.col("lng")).alias("x"), geo.mercator_y(F.col("lat")).alias("y")).toDF(*to)
    near = cover.nearest_any(at("w_land", "left_id", "lx", "ly"), at("w_nodes", "right_id", "rx", "ry"), 6000.0)
    return near.select("left_id", "right_id", F.round("d", 3).alias("d"))


@query("SELECT node_id, month % 12 + 1 AS following, round(visibility_m, 6) AS visibility_m FROM w_env")
def following_month(spark, sf_dir):
    from tidemark.functions.env import next_month

    return view(spark, sf_dir, "w_env").select("node_id", next_month(F.col("month")).alias("following"), six("visibility_m").alias("visibility_m"))
