"""Queries of polygons, coasts and unions of cells, each with its SQL, which compares all with all.

The world has an octagon around each land cell, some with a square hole, and one large area of
interest around them all.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import cells, geo, geometry, hexgrid
from tidemark.operators import components, cover, polygons
from tidemark.plans.catalogue import query
from tidemark.plans.grid import _CORNER, _GREAT, _NODES, _STEP, LEVEL, _lattice, _named, _placed, _plane, world_cells
from tidemark.sources.world import view

SIDE = 0.25  # degrees of a tile
_DX, _DY = "[1.0, 0.7, 0.0, -0.7, -1.0, -0.7, 0.0, 0.7]", "[0.0, 0.7, 1.0, 0.7, 0.0, -0.7, -1.0, -0.7]"
_RADIUS = "(3.1e-2 + 7e-4 * ((node_id * (k + 3)) % 97))"

#: poly_id, ring, k, x, y in both engines' SQL, after ``picks`` (dx, dy: entries of the lists for k).
_VERTICES = """SELECT node_id AS poly_id, 0 AS ring, k, lng + {dx} * {radius} + 1.37e-3 AS x, lat + {dy} * 5e-1 * {radius} - 2.11e-3 AS y FROM w_land CROSS JOIN ks
  UNION ALL SELECT node_id, 1, k, lng + {dx} * 1.1e-2, lat + {dy} * 1.1e-2 FROM w_land CROSS JOIN ks WHERE node_id % 3 = 0 AND k % 2 = 0
  UNION ALL SELECT -1, 0, k, -8.5137e0 + {dx} * (21e-1 + k * 3e-1), 5.03911e1 + {dy} * (8e-1 + k * 1e-1) FROM ks"""
_DUCK_VERTICES = _VERTICES.format(dx=f"({_DX}::DOUBLE[])[k + 1]", dy=f"({_DY}::DOUBLE[])[k + 1]", radius=_RADIUS)
_POLYGONS = f"ks AS (SELECT unnest(range(0, 8)) AS k), vertices AS ({_DUCK_VERTICES}), sides AS (SELECT poly_id, ring, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM vertices WINDOW w AS (PARTITION BY poly_id, ring ORDER BY k))"
_CROSSED = "(y1 <= {y}) <> (y2 <= {y}) AND {x} < x1 + ({y} - y1) / (y2 - y1) * (x2 - x1)"


def world_rings(spark, sf_dir):
    """(poly_id, ring, points) of the world's polygons."""
    entry = lambda values: f"CAST(element_at(array({values[1:-1]}), CAST(k + 1 AS INT)) AS DOUBLE)"
    ks = spark.range(8).select(F.col("id").alias("k"))
    rows = spark.sql(_VERTICES.format(dx=entry(_DX), dy=entry(_DY), radius=_RADIUS).replace("w_land", "{w_land}").replace(" ks", " {ks}"), w_land=view(spark, sf_dir, "w_land"), ks=ks)
    points = F.transform(F.array_sort(F.collect_list(F.struct("k", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return rows.groupBy("poly_id", "ring").agg(points.alias("points"))


@query(f"WITH {_POLYGONS} SELECT node_id, poly_id FROM w_nodes JOIN sides ON {_CROSSED.format(x='lng', y='lat')} GROUP BY node_id, poly_id HAVING count(*) % 2 = 1")
def nodes_in_polygons(spark, sf_dir):
    """Which polygons each node lies in; not in their holes."""
    points = view(spark, sf_dir, "w_nodes").select(F.col("node_id").alias("point_id"), F.col("lng").alias("x"), F.col("lat").alias("y"))
    return polygons.inside(points, world_rings(spark, sf_dir), SIDE).select(F.col("point_id").alias("node_id"), "poly_id")


_OWN = f"{_lattice(_NODES)}, {_named('spot', 'named')}, own AS (SELECT id, min(f) AS f, min(i) AS i, min(j) AS j FROM named JOIN spot USING (k) GROUP BY id)"
_HEXES = f"""{_placed(f'SELECT id AS k, corner, f, {_plane("(i+a/3e0)", "(j+b/3e0)", str(LEVEL))} FROM own CROSS JOIN {_CORNER}', 'corners')},
  hexes AS (SELECT k AS cell, lng AS hx1, lat AS hy1, coalesce(lead(lng) OVER w, first_value(lng) OVER w) AS hx2, coalesce(lead(lat) OVER w, first_value(lat) OVER w) AS hy2 FROM corners WINDOW w AS (PARTITION BY k ORDER BY corner))"""
_TURN = "sign(({c}-{a})*({f}-{b})-({d}-{b})*({e}-{a}))"


def _turn(p: str, q: str, r: str) -> str:
    (a, b), (c, d), (e, f) = (x.split() for x in (p, q, r))
    return _TURN.format(a=a, b=b, c=c, d=d, e=e, f=f)


_MEET = " AND ".join(f"{_turn(p, q, r)} <> {_turn(p, q, s)}" for p, q, r, s in (("hx1 hy1", "hx2 hy2", "x1 y1", "x2 y2"), ("x1 y1", "x2 y2", "hx1 hy1", "hx2 hy2")))
_FIRST = "SELECT poly_id, ring, min_by(x, k) AS x, min_by(y, k) AS y FROM vertices GROUP BY poly_id, ring"


@query(
    f"WITH RECURSIVE {_OWN}, {_HEXES}, {_POLYGONS}, touch AS (SELECT DISTINCT cell, poly_id FROM hexes JOIN sides ON {_MEET}), "
    f"cell_in AS (SELECT cell, poly_id FROM (SELECT DISTINCT ON (cell) cell, hx1, hy1 FROM hexes) JOIN sides ON {_CROSSED.format(x='hx1', y='hy1')} GROUP BY cell, poly_id HAVING count(*) % 2 = 1), "
    f"poly_in AS (SELECT DISTINCT cell, poly_id FROM (SELECT cell, poly_id, ring FROM ({_FIRST}) v JOIN hexes ON (hy1 <= y) <> (hy2 <= y) AND x < hx1 + (y - hy1) / (hy2 - hy1) * (hx2 - hx1) GROUP BY ALL HAVING count(*) % 2 = 1)), "
    "every AS (SELECT * FROM touch UNION SELECT * FROM cell_in UNION SELECT * FROM poly_in) SELECT printf('%x', e.cell) AS cell, poly_id, t.cell IS NULL AND p.cell IS NULL AS within FROM every e LEFT JOIN touch t USING (cell, poly_id) LEFT JOIN poly_in p USING (cell, poly_id)"
)
def cells_meeting_polygons(spark, sf_dir):
    """The cells of the world that share a point with a polygon, and whether they lie within it."""
    hexes = polygons.cell_rings(world_cells(spark, sf_dir))
    return polygons.meeting(hexes, world_rings(spark, sf_dir), SIDE).select(cells.to_hex(F.col("a_id")).alias("cell"), F.col("b_id").alias("poly_id"), "within")


_FILL = 7
_GRID = "SELECT row_number() OVER () AS k, 7 AS res, lat + b * 8e-3 AS lat, lng + a * 12e-3 AS lng FROM w_land CROSS JOIN (SELECT unnest(range(-10, 11)) AS a) CROSS JOIN (SELECT unnest(range(-9, 10)) AS b)"


@query(
    f"WITH RECURSIVE {_lattice(_GRID)}, {_named('spot', 'named')}, own AS (SELECT id, min(f) AS f, min(i) AS i, min(j) AS j FROM named JOIN spot USING (k) GROUP BY id), "
    f"{_placed(f'SELECT id AS k, f, {_plane("i", "j", "7")} FROM own', 'centre')}, {_POLYGONS} "
    f"SELECT poly_id, printf('%x', k) AS cell FROM centre JOIN sides ON {_CROSSED.format(x='lng', y='lat')} WHERE poly_id >= 0 GROUP BY poly_id, k HAVING count(*) % 2 = 1"
)
def filled_polygons(spark, sf_dir):
    """The cells of level 7 whose centres lie in the land's polygons."""
    return polygons.filled(world_rings(spark, sf_dir).where("poly_id >= 0"), _FILL, SIDE).select("poly_id", cells.to_hex(F.col("cell")).alias("cell"))


_SHARE = "least(1.0, greatest(0.0, ((lng-x1)*(x2-x1)+(lat-y1)*(y2-y1))/((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))))"
_COAST_LENGTH = _GREAT.replace("x.lat", "lat").replace("x.lng", "lng").replace("y.lat", "ny").replace("y.lng", "nx")


@query(
    f"WITH {_POLYGONS}, near AS (SELECT node_id, lat, lng, x1 + {_SHARE}*(x2-x1) AS nx, y1 + {_SHARE}*(y2-y1) AS ny FROM w_nodes CROSS JOIN sides WHERE poly_id >= 0), "
    "best AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY sqrt(pow(nx-lng,2)+pow(ny-lat,2)), nx, ny) AS n FROM near) "
    f"SELECT node_id, round({_COAST_LENGTH}, 2) AS dist_m FROM best WHERE n = 1"
)
def coast_distance(spark, sf_dir):
    """How far each node is from the nearest place on any coast."""
    nodes = view(spark, sf_dir, "w_nodes").select("node_id", "lat", "lng")
    coast = polygons.segments(world_rings(spark, sf_dir).where("poly_id >= 0"))
    near = polygons.nearest_segment(nodes.select(F.col("node_id").alias("point_id"), F.col("lng").alias("x"), F.col("lat").alias("y")), polygons.pyramid(coast, SIDE))
    at = nodes.join(near, nodes.node_id == near.point_id)
    return at.select("node_id", F.round(geo.great_circle(F.col("lat"), F.col("lng"), F.col("y"), F.col("x")), 2).alias("dist_m"))


@query(f"WITH {_POLYGONS} SELECT poly_id, ring, round(abs(sum(x1 * y2 - x2 * y1)) / 2, 10) AS area FROM sides GROUP BY poly_id, ring")
def tiled_areas(spark, sf_dir):
    """The areas of the tiles' parts of each ring add up to the ring's."""
    parts = polygons.cut_by_tiles(world_rings(spark, sf_dir), 0.1)
    return parts.groupBy("poly_id", "ring").agg(F.round(F.abs(F.sum(polygons.area(F.col("points")))), 10).alias("area"))


@query(
    f"WITH {_POLYGONS}, n AS (SELECT poly_id, c, r, count(*) AS crossings FROM sides CROSS JOIN LATERAL (SELECT unnest(range(floor(least(y1, y2)/1e-1)::BIGINT - 1, floor(greatest(y1, y2)/1e-1)::BIGINT + 2)) AS r) "
    "CROSS JOIN (SELECT DISTINCT floor(lng/1e-1)::BIGINT AS c FROM w_land) WHERE (y1 <= (r+5e-1)*1e-1) <> (y2 <= (r+5e-1)*1e-1) AND (c+5e-1)*1e-1 < x1 + ((r+5e-1)*1e-1 - y1)/(y2-y1)*(x2-x1) GROUP BY ALL) SELECT poly_id, c, r FROM n WHERE crossings % 2 = 1"
)
def tiles_with_middle_inside(spark, sf_dir):
    """Tiles of a tenth of a degree whose middle lies in a polygon, in the columns that have land."""
    rings = world_rings(spark, sf_dir)
    columns = view(spark, sf_dir, "w_land").select(F.floor(F.col("lng") / 0.1).alias("c")).distinct()
    parts = polygons.cut_by_tiles(rings, 0.1).select("poly_id", "c", "r").distinct().join(columns, "c")
    middles = parts.select(F.struct("poly_id", "c", "r").alias("point_id"), ((F.col("c") + 0.5) * 0.1).alias("x"), ((F.col("r") + 0.5) * 0.1).alias("y"))
    found = polygons.inside(middles, rings, SIDE).where("point_id.poly_id = poly_id")
    return found.select("poly_id", "point_id.c", "point_id.r")


@query(f"WITH {_POLYGONS} SELECT poly_id, ring, k, x, y FROM vertices UNION ALL SELECT poly_id, ring, CASE WHEN ring = 1 THEN 4 ELSE 8 END, x, y FROM vertices WHERE k = 0")
def polygon_texts(spark, sf_dir):
    """Polygons as text, with their holes, read back to rings; each ring's points are numbered, and it ends where it began."""
    number = lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))
    closed = F.concat("points", F.slice("points", 1, 1))
    ring = F.concat(F.lit("("), F.array_join(F.transform(closed, number), ", "), F.lit(")"))
    text = world_rings(spark, sf_dir).groupBy("poly_id").agg(F.concat(F.lit("POLYGON ("), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ring", ring.alias("t")))), lambda r: r["t"]), ", "), F.lit(")")).alias("text"))
    rings = text.select("poly_id", F.explode(geometry.from_wkt(F.col("text"))).alias("r"))
    points = rings.select("poly_id", "r.ring", F.posexplode("r.points").alias("n", "p"))
    return points.select("poly_id", "ring", F.when(F.col("ring") == 1, F.when(F.col("n") == 4, 4).otherwise(2 * F.col("n"))).otherwise(F.col("n")).cast("long").alias("k"), "p.x", "p.y")


_ACROSS = "SELECT -node_id AS id, lng - 1.3e-1 AS x1, lat + 1.37e-2 AS y1, lng + 1.7e-1 AS x2, lat + 1.73e-2 AS y2 FROM w_land UNION ALL SELECT source * 1000000 + target, lng1, lat1, lng2, lat2 FROM w_edges"


@query(
    f"WITH l AS ({_ACROSS}), t AS (SELECT a.id, ((b.x1-a.x1)*(b.y2-b.y1)-(b.y1-a.y1)*(b.x2-b.x1))/((a.x2-a.x1)*(b.y2-b.y1)-(a.y2-a.y1)*(b.x2-b.x1)) AS t, ((b.x1-a.x1)*(a.y2-a.y1)-(b.y1-a.y1)*(a.x2-a.x1))/((a.x2-a.x1)*(b.y2-b.y1)-(a.y2-a.y1)*(b.x2-b.x1)) AS u "
    "FROM l a JOIN l b ON a.id <> b.id AND (a.x2-a.x1)*(b.y2-b.y1) <> (a.y2-a.y1)*(b.x2-b.x1)), c AS (SELECT DISTINCT id, round(t, 12) AS t FROM t WHERE u BETWEEN 0 AND 1 AND round(t, 12) > 0 AND round(t, 12) < 1), "
    "e AS (SELECT id, 0e0 AS t FROM l UNION ALL SELECT id, 1e0 FROM l UNION ALL SELECT * FROM c), p AS (SELECT id, t, lead(t) OVER (PARTITION BY id ORDER BY t) AS n, row_number() OVER (PARTITION BY id ORDER BY t) - 1 AS piece FROM e) "
    "SELECT id, piece, round(x1 + t*(x2-x1), 6) AS x1, round(y1 + t*(y2-y1), 6) AS y1, round(x1 + n*(x2-x1), 6) AS x2, round(y1 + n*(y2-y1), 6) AS y2 FROM p JOIN l USING (id) WHERE n IS NOT NULL"
)
def lines_cut_at_crossings(spark, sf_dir):
    """Edges, and a line across each land cell, cut wherever they cross each other."""
    lines = spark.sql(_ACROSS.replace("w_land", "{w_land}").replace("w_edges", "{w_edges}"), w_land=view(spark, sf_dir, "w_land"), w_edges=view(spark, sf_dir, "w_edges")).withColumn("k", F.lit(0))
    cut = polygons.split_at_crossings(lines, 0.1)
    return cut.select("id", F.col("piece").cast("long").alias("piece"), *(F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")))


_PARENT = f"((id & {~(15 << 52)}) | {4 << 52} | {(1 << 33) - 1})"
_COMPONENTS = "cc(n, c) USING KEY (n) AS (SELECT n, n FROM dots UNION (SELECT l.b, min(cc.c) FROM cc JOIN links l ON l.a = cc.n JOIN recurring.cc r ON r.n = l.b WHERE cc.c < r.c GROUP BY l.b))"


@query(
    f"WITH RECURSIVE {_OWN}, {_HEXES}, {_STEP.replace('around AS (SELECT', 'around AS (SELECT a AS sa, b AS sb,')}, {_named('around', 'other')}, grouped AS (SELECT id, {_PARENT} AS grp FROM own), "
    "pairs AS (SELECT cell, list_position([10, 11, 1, -10, -11, -1], sa * 10 + sb) AS t, other.id AS other FROM around JOIN other USING (k)), "
    "turned AS (SELECT cell, t, other, lead(other) OVER w AS after, first_value(other) OVER w AS first_, lag(other) OVER w AS before, last_value(other) OVER (PARTITION BY cell ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_ FROM pairs WINDOW w AS (PARTITION BY cell ORDER BY t)), "
    "outer_ AS (SELECT g.grp, g.grp || ':' || list_sort([cell, coalesce(before, last_), other])::VARCHAR AS since, g.grp || ':' || list_sort([cell, other, coalesce(after, first_)])::VARCHAR AS upto FROM turned JOIN grouped g ON g.id = cell LEFT JOIN grouped h ON h.id = other AND h.grp = g.grp WHERE h.id IS NULL), "
    f"dots AS (SELECT since AS n FROM outer_), links AS (SELECT since AS a, upto AS b FROM outer_ UNION ALL SELECT upto, since FROM outer_), {_COMPONENTS}, "
    "sizes AS (SELECT grp, c, count(*) AS n FROM outer_ JOIN cc ON cc.n = since GROUP BY grp, c), areas AS (SELECT grp, sum(hx1 * hy2 - hx2 * hy1) / 2 AS area FROM hexes JOIN grouped ON id = cell GROUP BY grp) "
    "SELECT printf('%x', grp) AS grp, count(*) AS n_rings, sum(n)::BIGINT AS n_sides, max(n)::BIGINT AS longest, round(any_value(area), 8) AS area FROM sizes JOIN areas USING (grp) GROUP BY grp"
)
def cell_outlines(spark, sf_dir):
    """The outlines of each union of the world's cells that have a parent of level 4 in common."""
    table = world_cells(spark, sf_dir).withColumn("grp", cells.parent(F.col("cell"), 4))
    rings = components.outlines(table, "grp", "cell").withColumn("n", F.size("points").cast("long"))
    found = rings.groupBy("grp").agg(F.count("*").alias("n_rings"), F.sum("n").alias("n_sides"), F.max("n").alias("longest"), F.round(F.sum(polygons.area(F.col("points"))), 8).alias("area"))
    return found.withColumn("grp", cells.to_hex(F.col("grp")))


_FRONTIER = f"""{_OWN}, {_STEP}, {_named('around', 'other')}, pairs AS (SELECT cell, other.id AS other FROM around JOIN other USING (k) JOIN own o ON o.id = other.id),
  counted AS (SELECT own.id AS n, count(pairs.cell) AS n_neighbours FROM own LEFT JOIN pairs ON cell = id GROUP BY own.id), dots AS (SELECT * FROM counted WHERE n_neighbours < 6),
  links AS (SELECT cell AS a, other AS b FROM pairs SEMI JOIN dots x ON x.n = cell SEMI JOIN dots y ON y.n = other), {_COMPONENTS}"""


@query(f"WITH RECURSIVE {_FRONTIER} SELECT printf('%x', n) AS cell, n_neighbours, printf('%x', c) AS part FROM dots JOIN cc USING (n)")
def frontier_parts(spark, sf_dir):
    """The cells of the world that lack a neighbour, and the connected parts these make."""
    found = cover.frontier_parts(world_cells(spark, sf_dir), "cell")
    return found.select(cells.to_hex(F.col("cell")).alias("cell"), "n_neighbours", cells.to_hex(F.col("part")).alias("part"))


_STRIPS = "(c // 12) % 2 = 0"  # strips of twelve columns, some 80 km apart
_STRIP_FRONTIER = _FRONTIER.replace(_NODES, f"{_NODES} WHERE {_STRIPS}")


@query(
    f"WITH RECURSIVE {_STRIP_FRONTIER}, {_placed(f'SELECT id AS k, f, {_plane("i", "j", str(LEVEL))} FROM own', 'centre')}, m AS (SELECT n, c, 6378137.0*radians(lng) AS x, 6378137.0*ln(tan(radians(lat)/2+pi()/4)) AS y FROM dots JOIN cc USING (n) JOIN centre ON centre.k = n), "
    "d AS (SELECT a.c AS pa, b.c AS pb, a.n AS source, b.n AS target, round(sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)), 3) AS d FROM m a JOIN m b ON a.c < b.c WHERE sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)) <= 250000) "
    "SELECT printf('%x', pa) AS part_a, printf('%x', pb) AS part_b, printf('%x', source) AS source, printf('%x', target) AS target, round(d, 2) AS d FROM d QUALIFY row_number() OVER (PARTITION BY pa, pb ORDER BY d, source, target) = 1"
)
def frontier_joins(spark, sf_dir):
    """The nearest two cells of each two parts of the frontier that lie within 250 km of the map."""
    strips = view(spark, sf_dir, "w_nodes").where(F.floor(F.col("c") / 12) % 2 == 0).select(hexgrid.cell_at(F.col("lat"), F.col("lng"), LEVEL).alias("cell"))
    parts = cover.frontier_parts(strips, "cell").withColumn("at", hexgrid.center(F.col("cell")))
    found = cover.joined_parts(parts.select(F.col("cell").alias("node_id"), "part", geo.mercator_x(F.col("at.lng")).alias("x"), geo.mercator_y(F.col("at.lat")).alias("y")), 250_000.0)
    return found.select(*(cells.to_hex(F.col(c)).alias(c) for c in ("part_a", "part_b", "source", "target")), F.round("d", 2).alias("d"))
