"""Queries of cell families, lines, tiles, clusters and stitches, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import cells, env, geo
from tidemark.operators import cover, graph, lines, ports, routing
from tidemark.plans.catalogue import _DIRECTED, _LENGTH, _far, _kept_costs, _penalty, _route_sql, query, six, world_edges
from tidemark.sources.world import view

# --- cell ids ----------------------------------------------------------------------------------------------------------


def _cell(level: int, given: int = 9, next_digit: str = "0") -> str:
    """SQL of a node's cell at a level, digit by digit: ``given`` digits come from the node, the next one is stated, further ones are 0."""
    digits = [f"((node_id + {3 * k}) % 7) * {8 ** (15 - k)}" if k <= given else f"{next_digit} * {8 ** (15 - k)}" if k == given + 1 else "0" for k in range(1, level + 1)]
    return f"({1 << 59} + {level << 52} + (node_id % 122) * {1 << 45} + {' + '.join(digits)} + {8 ** (15 - level) - 1})"


def _cells(spark, sf_dir):
    return view(spark, sf_dir, "w_nodes").select("node_id", F.expr(_cell(9)).alias("id"))


@query(f"SELECT node_id, 9 AS level, printf('%x', {_cell(9)}) AS cell, printf('%x', {_cell(5)}) AS parent5, printf('%x', {_cell(8)}) AS parent8, printf('%x', {_cell(11)}) AS center11 FROM w_nodes")
def cell_family(spark, sf_dir):
    """Ancestors and centre children of a cell of resolution 9 for each node."""
    made = {"cell": F.col("id"), "parent5": cells.parent(F.col("id"), 5), "parent8": cells.parent(F.col("id"), 8), "center11": cells.center_child(F.col("id"), 11)}
    return _cells(spark, sf_dir).select("node_id", cells.resolution(F.col("id")).alias("level"), *(cells.to_hex(c).alias(name) for name, c in made.items()))


@query(f"SELECT node_id, printf('%x', {_cell(10, next_digit='d')}) AS child FROM w_nodes CROSS JOIN (SELECT unnest(range(0, 7)) AS d)")
def cell_children(spark, sf_dir):
    child = F.explode(cells.children(F.col("id"), 10))
    return _cells(spark, sf_dir).select("node_id", child.alias("child")).select("node_id", cells.to_hex(F.col("child")).alias("child"))


@query(f"SELECT node_id, {cells.MEAN_EDGE_M}[node_id % 16 + 1]::DOUBLE AS mean_edge_m FROM w_nodes")
def cell_edge_lengths(spark, sf_dir):
    return view(spark, sf_dir, "w_nodes").select("node_id", cells.mean_edge_m((F.col("node_id") % 16).cast("int")).alias("mean_edge_m"))


# --- distances and lines -----------------------------------------------------------------------------------------------

_PLANE = "sqrt(pow(lng2-lng1,2)+pow(lat2-lat1,2))"


def _p(x, y):
    return F.struct(F.col(x).alias("x"), F.col(y).alias("y"))


@query(f"SELECT source, target, round({_LENGTH.replace('6371007.180918475', '6371e3')}, 6) AS haversine_m, round({_PLANE}*111000, 6) AS planar_m FROM w_edges")
def edge_distance_formulas(spark, sf_dir):
    ends = [F.col(c) for c in ("lat1", "lng1", "lat2", "lng2")]
    return view(spark, sf_dir, "w_edges").select("source", "target", six(geo.haversine_m(*ends)).alias("haversine_m"), six(geo.planar_m(*ends)).alias("planar_m"))


@query(
    f"WITH l AS (SELECT source || '-' || target AS line_id, *, {_PLANE} AS size FROM w_edges), k AS (SELECT *, unnest(range(0, CAST(ceil(size/0.013e0) AS BIGINT) + 1)) AS k FROM l), s AS (SELECT *, least(1.0, k*0.013e0/size) AS share FROM k) "
    "SELECT line_id, k, round(lng1+share*(lng2-lng1),6) AS x, round(lat1+share*(lat2-lat1),6) AS y FROM s"
)
def line_resampled(spark, sf_dir):
    """Points every 0.013 degrees along each edge, and its end."""
    line = F.array(_p("lng1", "lat1"), _p("lng2", "lat2"))
    out = lines.resampled(view(spark, sf_dir, "w_edges").select(F.concat_ws("-", "source", "target").alias("line_id"), line.alias("line")), "line_id", "line", 0.013)
    return out.select("line_id", F.col("k").cast("long").alias("k"), six("x").alias("x"), six("y").alias("y"))


@query(
    f"WITH m AS (SELECT *, (lng1+lng2)/2 + (source % 5)*0.004e0 AS mx, (lat1+lat2)/2 AS my, {_PLANE} AS size FROM w_edges), t AS (SELECT *, least(1.0, greatest(0.0, ((mx-lng1)*(lng2-lng1)+(my-lat1)*(lat2-lat1))/(size*size))) AS t FROM m) "
    "SELECT source, target, CASE WHEN sqrt(pow(mx-lng1-t*(lng2-lng1),2)+pow(my-lat1-t*(lat2-lat1),2)) > 0.0071e0 THEN 3 ELSE 2 END AS n_points FROM t"
)
def line_simplified(spark, sf_dir):
    """Three-point lines lose their middle if it lies within the tolerance."""
    middle = F.struct(((F.col("lng1") + F.col("lng2")) / 2 + (F.col("source") % 5) * 0.004).alias("x"), ((F.col("lat1") + F.col("lat2")) / 2).alias("y"))
    bent = view(spark, sf_dir, "w_edges").select(F.struct("source", "target").alias("edge"), F.array(_p("lng1", "lat1"), middle, _p("lng2", "lat2")).alias("line"))
    return lines.simplified(bent.select(F.to_json("edge").alias("edge"), "line"), "edge", "line", 0.0071).select(F.from_json("edge", "source long, target long").alias("e"), "line").select("e.*", F.size("line").alias("n_points"))


def _written_lines(spark, sf_dir):
    """Edges as text lines of three vertices; every thirteenth node's are broken."""
    part = lambda x, y: F.concat_ws(" ", F.col(x).cast("string"), F.col(y).cast("string"))
    whole = F.concat(F.lit("LINESTRING ("), F.concat_ws(", ", part("lng1", "lat1"), F.lit("0.5 50.25"), part("lng2", "lat2")), F.lit(")"))
    wkt = F.when(F.col("source") % 13 == 0, F.when(F.col("target") % 2 == 0, F.lit("LINESTRING EMPTY"))).otherwise(whole)
    return view(spark, sf_dir, "w_edges").select("source", "target", lines.from_wkt(wkt).alias("line"))


@query("SELECT source, target, lat1, lng1, lat2, lng2 FROM w_edges WHERE source % 13 <> 0")
def edge_line_endpoints(spark, sf_dir):
    """First and last vertex of edge lines; lines without two vertices go."""
    return graph.with_endpoints(_written_lines(spark, sf_dir), "line").where("lat1 is not null").drop("line")


@query("SELECT count(*) AS edges, count(*) FILTER (source % 13 = 0) AS without_endpoints FROM w_edges")
def edge_lines_without_endpoints(spark, sf_dir):
    """What edge_line_endpoints leaves out."""
    return graph.with_endpoints(_written_lines(spark, sf_dir), "line").agg(F.count("*").alias("edges"), F.count_if(F.col("lat1").isNull()).alias("without_endpoints"))


@query(
    f"WITH {_route_sql('[1]')} SELECT a.month, max(a.place) OVER (PARTITION BY a.month)::BIGINT - a.place AS position, b.node AS source, a.node AS target, round(c.length_m, 3) AS length_m, round(c.time_s, 3) AS time_s "
    "FROM walk a JOIN walk b ON b.query_id = a.query_id AND b.month = a.month AND b.place = a.place + 1 JOIN costs c ON c.month = a.month AND c.source = b.node AND c.target = a.node"
)
def route_legs(spark, sf_dir):
    """A route leg by leg."""
    costs = _kept_costs(spark, sf_dir, [1])
    rows = routing.legs(routing.routes(_far(spark, sf_dir), costs)).join(costs, ["month", "vessel", "source", "target"])
    return rows.select("month", F.col("position").cast("long").alias("position"), "source", "target", F.round("length_m", 3).alias("length_m"), F.round("time_s", 3).alias("time_s"))


# --- costs with waves --------------------------------------------------------------------------------------------------


@query(
    f"WITH {_DIRECTED} SELECT e.source, e.target, t.month, round(length_m * pow({_penalty('t.current_x', 't.current_y')},2.0) * pow({_penalty('t.wind_x', 't.wind_y')},1.5) * pow({_penalty('t.wind_y', 't.wind_x')},1.2) "
    "* CASE WHEN coalesce(n.clear_land,0) = 0 OR n.clear_land > coalesce(t.visibility_m,0) THEN 9 ELSE 3 END * (1 - n.daylight_ratio), 1) AS weight "
    "FROM directed e JOIN w_nodes n ON n.node_id = e.target JOIN w_env s ON s.node_id = e.source JOIN w_env t ON t.node_id = e.target AND t.month = s.month"
)
def static_edge_cost_waves(spark, sf_dir):
    """Static costs with all three directions; the waves run along the wind with its axes exchanged. To a tenth, as angles near a half turn are known to half their digits."""
    conditions = view(spark, sf_dir, "w_env")
    nodes = view(spark, sf_dir, "w_nodes").select(F.col("node_id").alias("target"), "daylight_ratio", "clear_land")
    e = graph.both_directions(world_edges(spark, sf_dir)).join(nodes, "target")
    rows = e.join(conditions.select(F.col("node_id").alias("source"), "month"), "source").join(conditions.withColumnRenamed("node_id", "target"), ["target", "month"])
    along = [env.directional_penalty(F.col("dx"), F.col("dy"), F.col(x), F.col(y)) for x, y in (("current_x", "current_y"), ("wind_x", "wind_y"), ("wind_y", "wind_x"))]
    dark = env.darkness_penalty(F.col("daylight_ratio"), F.col("clear_land"), F.col("visibility_m"))
    return rows.select("source", "target", "month", F.round(env.static_cost(F.col("length_m"), *along, dark), 1).alias("weight"))


# --- tiles, clusters, levels -------------------------------------------------------------------------------------------

_ROW = "trunc((1.0-ln(tan(radians({lat}))+1/cos(radians({lat})))/pi())/2.0*4096)::INT"
_COLUMN = "trunc(({lng}+180.0)/360.0*4096)::INT"
_NORTH = "degrees(atan(sinh(pi()*(1-2*{y}/4096e0))))"


@query(
    f"WITH t AS (SELECT node_id, {_COLUMN.format(lng='lng')} AS x, {_ROW.format(lat='lat')} AS y FROM w_nodes) "
    f"SELECT node_id, x, y, round(x/4096e0*360-180,6) AS west, round({_NORTH.format(y='(y+1)')},6) AS south, round((x+1)/4096e0*360-180,6) AS east, round({_NORTH.format(y='y')},6) AS north FROM t"
)
def tile_bounds(spark, sf_dir):
    """The tile of each node and its four sides."""
    placed = view(spark, sf_dir, "w_nodes").select("node_id", geo.tile_x(F.col("lng"), 12).alias("x"), geo.tile_y(F.col("lat"), 12).alias("y"))
    sides = {"west": geo.tile_west(F.col("x"), 12), "south": geo.tile_north(F.col("y") + 1, 12), "east": geo.tile_west(F.col("x") + 1, 12), "north": geo.tile_north(F.col("y"), 12)}
    return placed.select("*", *(six(c).alias(k) for k, c in sides.items()))


@query(
    f"WITH x AS (SELECT node_id AS cell, lat, unnest(range({_COLUMN.format(lng='(lng-0.1)')}, {_COLUMN.format(lng='(lng+0.1)')} + 1))::INT AS x FROM w_land) "
    f"SELECT cell, x, unnest(range({_ROW.format(lat='(lat+0.05)')}, {_ROW.format(lat='(lat-0.05)')} + 1))::INT AS y FROM x"
)
def tiles_touched(spark, sf_dir):
    """All tiles, in both directions, that the box around each land cell touches."""
    box = {"west": F.col("lng") - 0.1, "east": F.col("lng") + 0.1, "south": F.col("lat") - 0.05, "north": F.col("lat") + 0.05}
    return cover.tiles(view(spark, sf_dir, "w_land").select(F.col("node_id").alias("cell"), *(c.alias(k) for k, c in box.items())), 12)


@query("SELECT floor((lng+180)/360*256*64/40)::BIGINT AS x, floor((1.0-ln(tan(radians(lat))+1/cos(radians(lat)))/pi())/2.0*256*64/40)::BIGINT AS y, count(*) AS n FROM w_ports GROUP BY ALL")
def ports_pixel_clusters(spark, sf_dir):
    """Ports in squares of 40 pixels at zoom 6."""
    return ports.clustered(view(spark, sf_dir, "w_ports"), 6)


@query("SELECT l.node_id, z.max_elevation_m FROM w_land l LEFT JOIN (SELECT cell, max(red*256.0::DOUBLE + green + blue/256.0::DOUBLE - 32768) AS max_elevation_m FROM w_pixels WHERE blue <> 0 GROUP BY cell) z ON z.cell = l.node_id")
def land_with_elevation(spark, sf_dir):
    """Land cells with the highest pixel in them, null where no tile has one."""
    pixels = view(spark, sf_dir, "w_pixels").where("blue <> 0")
    highest = pixels.groupBy(F.col("cell").alias("node_id")).agg(F.max(geo.terrarium_m(F.col("red"), F.col("green"), F.col("blue"))).alias("max_elevation_m"))
    return view(spark, sf_dir, "w_land").select("node_id").join(highest, "node_id", "left")


@query(
    "WITH m AS (SELECT node_id, 6378137.0*radians(lng) AS x, 6378137.0*ln(tan(radians(lat)/2+pi()/4)) AS y, node_id % 4 = 0 AS coarse FROM w_nodes), d AS (SELECT a.coarse, a.node_id AS l, b.node_id AS t, sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)) AS d FROM m a JOIN m b ON a.coarse <> b.coarse AND abs(a.x-b.x) <= 12000 AND abs(a.y-b.y) <= 12000), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY round(d,3), t) AS n FROM d WHERE d <= 12000) SELECT DISTINCT least(l, t) AS source, greatest(l, t) AS target FROM n WHERE n <= 2"
)
def stitched_levels(spark, sf_dir):
    """Edges between two levels: each cell with its two nearest of the other level, whichever side asks."""
    m = view(spark, sf_dir, "w_nodes").select("node_id", geo.mercator_x(F.col("lng")).alias("x"), geo.mercator_y(F.col("lat")).alias("y"))
    return cover.stitched(m.where("node_id % 4 = 0"), m.where("node_id % 4 <> 0"), 2, 12_000.0)
