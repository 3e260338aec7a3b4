"""Queries of cells on the globe, each with its SQL.

The twins measure angles from the faces' centres and round by trying the lattice points
around, where the operators use vectors and cube rounding. They step on the face's lattice to
find neighbours, where the operators step on a cell's digits. No cell of the world lies in a
pentagon's base cell, so the twins leave those out; tests cover them.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.functions import cells, geo, hexgrid
from tidemark.functions import icosahedron as ico
from tidemark.operators import cover
from tidemark.plans.catalogue import query, six
from tidemark.sources.world import view

LEVEL = 6  # whose cells are about as far apart as the world's nodes


def _rows(values) -> str:
    return ", ".join("(" + ", ".join(f"{v!r}::DOUBLE" if isinstance(v, float) else str(v) for v in row) + ")" for row in values)


_FACES = _rows((f, *face) for f, face in enumerate(ico.FACES))
_PLACES = _rows((k // 25, k // 5 % 5 - 2, k % 5 - 2, p.base, p.turn) for k, p in enumerate(ico.places()) if p.base >= 0)
_DIGIT = "[" + ", ".join(str(d) for d in hexgrid._DIGIT_OF_STEP) + "]"
_TURNED = "[" + ", ".join(str(d) for d in hexgrid._TURNED) + "]"
_S3 = "sqrt(3e0)"


def _lattice(points: str) -> str:
    """ctes from ``points`` (k, res, lat, lng) to ``spot`` (k, res, f, i, j): the face and the lattice point nearest to each."""
    return f"""faces(f, flat, flng, az) AS (VALUES {_FACES}), places(f, i, j, base, turn) AS (VALUES {_PLACES}), points AS ({points}),
  seen AS (SELECT k, res, f, flat, flng, az, sin(radians(lat))*sin(flat)+cos(radians(lat))*cos(flat)*cos(radians(lng)-flng) AS dot, cos(radians(lat))*sin(radians(lng)-flng) AS u,
    cos(flat)*sin(radians(lat))-sin(flat)*cos(radians(lat))*cos(radians(lng)-flng) AS v FROM points CROSS JOIN faces QUALIFY row_number() OVER (PARTITION BY k, res ORDER BY dot DESC) = 1),
  polar AS (SELECT k, res, f, sqrt(u*u+v*v)/dot/{ico.UNIT}*pow(7e0, res/2e0) AS rad, az - atan2(u, v) - (res % 2)*{ico.ALPHA!r} AS theta FROM seen),
  flat AS (SELECT k, res, f, rad*cos(theta) AS x, rad*sin(theta) AS y FROM polar),
  tried AS (SELECT *, floor(x - y/{_S3}) + a AS q, floor(2*y/{_S3}) + b AS r FROM flat CROSS JOIN (VALUES (0,0),(0,1),(1,0),(1,1)) t(a, b)),
  spot AS (SELECT k, res, f, (q + r)::BIGINT AS i, r::BIGINT AS j FROM tried QUALIFY row_number() OVER (PARTITION BY k, res ORDER BY pow(x-q-r/2,2)+pow(y-r*{_S3}/2,2)) = 1)"""


def _named(at: str, name: str) -> str:
    """ctes from lattice points (k, res, f, i, j) to ``name`` (k, id): up level by level, then the digits turned to the base cell's frame."""
    odd = "level % 2 = 1"
    return f"""{name}_up(k, res, f, level, i, j, digits) AS (SELECT k, res, f, res, i, j, 0::BIGINT FROM {at} UNION ALL
    SELECT k, res, f, level - 1, a, b, digits + {_DIGIT}[3*(i - CASE WHEN {odd} THEN 2*a+b ELSE 3*a-b END + 1) + j - CASE WHEN {odd} THEN 3*b-a ELSE a+2*b END + 2] * (8 ** (15 - level))::BIGINT
    FROM (SELECT *, round(CASE WHEN {odd} THEN 3*i-j ELSE 2*i+j END / 7e0)::BIGINT AS a, round(CASE WHEN {odd} THEN i+2*j ELSE 3*j-i END / 7e0)::BIGINT AS b FROM {name}_up WHERE level > 0)),
  {name}_top AS (SELECT k, res, base, turn, digits FROM {name}_up JOIN places USING (f, i, j) WHERE level = 0),
  {name} AS (SELECT k, ({1 << 59} + res*{1 << 52} + base*{1 << 45} + sum(CASE WHEN l <= res THEN {_TURNED}[turn*7 + ((digits >> (3*(15-l))) & 7) + 1] ELSE 7 END * (8 ** (15 - l))::BIGINT))::BIGINT AS id
    FROM {name}_top CROSS JOIN (SELECT unnest(range(1, 16)) AS l) GROUP BY k, res, base, turn, digits)"""


def _placed(points: str, name: str) -> str:
    """ctes from ``points`` (k, f, x, y in the coarsest cells' spacing) on faces to ``name`` (k, lat, lng)."""
    return f"""{name}_polar AS (SELECT p.*, flat, flng, atan({ico.UNIT}*sqrt(x*x+y*y)) AS rad, az - atan2(y, x) AS bearing FROM ({points}) p JOIN faces USING (f)),
  {name}_lat AS (SELECT *, asin(least(1.0, sin(flat)*cos(rad)+cos(flat)*sin(rad)*cos(bearing))) AS a FROM {name}_polar),
  {name} AS (SELECT * EXCLUDE (x, y, flat, flng, rad, bearing, a), degrees(a) AS lat, degrees(flng + atan2(sin(bearing)*sin(rad)*cos(flat), cos(rad)-sin(flat)*sin(a))) AS lng FROM {name}_lat)"""


def _plane(i: str, j: str, res: str = "res") -> str:
    """SQL of x and y of a lattice point, back in the coarsest cells' spacing."""
    x, y, t = f"({i}-{j}/2e0)", f"({j}*{_S3}/2)", f"(({res} % 2)*{ico.ALPHA!r})"
    return f"({x}*cos({t})-{y}*sin({t}))/pow(7e0, {res}/2e0) AS x, ({x}*sin({t})+{y}*cos({t}))/pow(7e0, {res}/2e0) AS y"


_NODES = f"SELECT node_id AS k, {LEVEL} AS res, lat, lng FROM w_nodes"
_WORLD = f"{_lattice(_NODES)}, {_named('spot', 'named')}, own AS (SELECT id, min(f) AS f, min(i) AS i, min(j) AS j FROM named JOIN spot USING (k) GROUP BY id)"


def world_cells(spark, sf_dir):
    """The cells that hold the world's nodes."""
    return view(spark, sf_dir, "w_nodes").select(hexgrid.cell_at(F.col("lat"), F.col("lng"), LEVEL).alias("cell")).distinct()


@query(
    f"WITH RECURSIVE {_lattice('SELECT node_id * 16 + res AS k, res, lat, lng FROM w_nodes CROSS JOIN (VALUES (3), (6), (9)) r(res)')}, {_named('spot', 'named')}, "
    f"{_placed(f'SELECT k, f, {_plane("i", "j")} FROM spot', 'centre')} "
    "SELECT k // 16 AS node_id, (k % 16)::INT AS level, printf('%x', id) AS cell, round(lat, 6) AS lat, round(lng, 6) AS lng FROM named JOIN centre USING (k)"
)
def cell_positions(spark, sf_dir):
    """The cell of each node at three levels, and its centre."""
    at = view(spark, sf_dir, "w_nodes").withColumn("level", F.explode(F.array(F.lit(3), F.lit(6), F.lit(9))))
    placed = at.withColumn("id", hexgrid.cell_at(F.col("lat"), F.col("lng"), F.col("level"))).withColumn("at", hexgrid.center(F.col("id")))
    return placed.select("node_id", "level", cells.to_hex(F.col("id")).alias("cell"), six("at.lat").alias("lat"), six("at.lng").alias("lng"))


_OFFSETS = "(SELECT a, b, greatest(abs(a), abs(b), abs(a - b)) AS distance FROM (SELECT unnest(range(-3, 4)) AS a) CROSS JOIN (SELECT unnest(range(-3, 4)) AS b) WHERE greatest(abs(a), abs(b), abs(a - b)) <= 3)"
_AROUND = f"around AS (SELECT row_number() OVER () AS k, {LEVEL} AS res, id AS cell, f, i + a AS i, j + b AS j, distance FROM own CROSS JOIN {_OFFSETS})"


@query(f"WITH RECURSIVE {_WORLD}, {_AROUND}, {_named('around', 'other')} SELECT printf('%x', cell) AS cell, distance::INT AS distance, printf('%x', other.id) AS other FROM around JOIN other USING (k)")
def cell_disks(spark, sf_dir):
    """All cells up to three steps from each cell of the world, by rings."""
    out = world_cells(spark, sf_dir).select("cell", F.posexplode(hexgrid.rings(F.col("cell"), 3)).alias("distance", "ring"))
    return out.select(cells.to_hex(F.col("cell")).alias("cell"), "distance", F.explode("ring").alias("other")).withColumn("other", cells.to_hex(F.col("other")))


_LONG = geo.CELL_RADIUS_M
_GREAT = "2*{r}*asin(sqrt(least(1.0, pow(sin((radians(y.lat)-radians(x.lat))/2),2)+cos(radians(x.lat))*cos(radians(y.lat))*pow(sin((radians(y.lng)-radians(x.lng))/2),2))))".format(r=_LONG)
_STEP = _AROUND.replace(_OFFSETS, "(SELECT * FROM (VALUES (1, 0, 1), (1, 1, 1), (0, 1, 1), (-1, 0, 1), (-1, -1, 1), (0, -1, 1)) s(a, b, distance))")


@query(
    f"WITH RECURSIVE {_WORLD}, {_STEP}, {_named('around', 'other')}, {_placed(f'SELECT id AS k, f, {_plane("i", "j", str(LEVEL))} FROM own', 'centre')}, "
    "pairs AS (SELECT cell AS a, other.id AS b FROM around JOIN other USING (k) JOIN own o ON o.id = other.id WHERE cell < other.id) "
    f"SELECT printf('%x', a) AS source, printf('%x', b) AS target, round({_GREAT}, 3) AS length_m FROM pairs JOIN centre x ON x.k = a JOIN centre y ON y.k = b"
)
def cell_edges(spark, sf_dir):
    """Each pair of adjacent cells of the world once, and the distance of their centres."""
    pairs = cover.adjacent(world_cells(spark, sf_dir), "cell")
    at = pairs.withColumn("a", hexgrid.center(F.col("source"))).withColumn("b", hexgrid.center(F.col("target")))
    length = geo.great_circle(F.col("a.lat"), F.col("a.lng"), F.col("b.lat"), F.col("b.lng"))
    return at.select(cells.to_hex(F.col("source")).alias("source"), cells.to_hex(F.col("target")).alias("target"), F.round(length, 3).alias("length_m"))


_CORNER = "(SELECT * FROM (VALUES (0, 2, 1), (1, 1, 2), (2, -1, 1), (3, -2, -1), (4, -1, -2), (5, 1, -1)) s(corner, a, b))"


@query(
    f"WITH RECURSIVE {_WORLD}, {_placed(f'SELECT id AS k, corner, f, {_plane("(i+a/3e0)", "(j+b/3e0)", str(LEVEL))} FROM own CROSS JOIN {_CORNER}', 'corners')} "
    "SELECT printf('%x', k) AS cell, (SELECT count(*) FROM corners o WHERE o.k = corners.k) AS n_corners, round(lat, 6) AS lat, round(lng, 6) AS lng FROM corners"
)
def cell_boundaries(spark, sf_dir):
    """The corners of each cell of the world: each is the middle of three centres."""
    around = world_cells(spark, sf_dir).withColumn("b", hexgrid.boundary(F.col("cell")))
    out = around.select(cells.to_hex(F.col("cell")).alias("cell"), F.size("b").cast("long").alias("n_corners"), F.explode("b").alias("p"))
    return out.select("cell", "n_corners", six("p.lat").alias("lat"), six("p.lng").alias("lng"))


def _bits(level: int) -> str:
    return f"(id & {~(15 << 52)} | {level << 52} | {(1 << 3 * (15 - level)) - 1})"


@query(
    f"WITH RECURSIVE {_lattice('SELECT node_id AS k, 9 AS res, lat, lng FROM w_nodes')}, {_named('spot', 'named')} "
    f"SELECT k AS node_id, printf('%x', id) AS cell, 9 AS level, printf('%x', {_bits(5)}) AS parent5, printf('%x', {_bits(8)}) AS parent8, printf('%x', (id & {~(15 << 52)} & {~(7 << 15)}) | {10 << 52}) AS center10 FROM named"
)
def h3_bit_parent_children(spark, sf_dir):
    """The cell of each node, its parents, and its child in the middle."""
    own = view(spark, sf_dir, "w_nodes").select("node_id", hexgrid.cell_at(F.col("lat"), F.col("lng"), 9).alias("id"))
    return own.select("node_id", cells.to_hex(F.col("id")).alias("cell"), cells.resolution(F.col("id")).alias("level"), *(cells.to_hex(cells.parent(F.col("id"), k)).alias(f"parent{k}") for k in (5, 8)), cells.to_hex(cells.center_child(F.col("id"), 10)).alias("center10"))


_PIXELS = "SELECT {key} AS k, l.lat + (p.l_orderkey % 41 - 20) * 37e-4 + 1.1e-4 AS lat, l.lng + (p.l_orderkey % 37 - 18) * 61e-4 - 1.3e-4 AS lng, red, green, blue FROM {pixels} p JOIN {land} l ON l.node_id = p.cell"
_DUCK_PIXELS = _PIXELS.format(key="row_number() OVER ()", pixels="w_pixels", land="w_land")


@query(
    f"WITH RECURSIVE pixels AS ({_DUCK_PIXELS}), {_lattice('SELECT k, 7 AS res, lat, lng FROM pixels')}, {_named('spot', 'named')} "
    "SELECT printf('%x', id) AS cell, count(*) AS pixels, max(red*256.0::DOUBLE + green + blue/256.0::DOUBLE - 32768) AS max_elevation_m FROM named JOIN pixels USING (k) WHERE blue <> 0 GROUP BY id"
)
def cell_elevation(spark, sf_dir):
    """The highest pixel inside each cell of level 7: a pixel belongs to the cell that holds its place, whatever tile it came with."""
    pixels = spark.sql(_PIXELS.format(key="0", pixels="{pixels}", land="{land}"), pixels=view(spark, sf_dir, "w_pixels"), land=view(spark, sf_dir, "w_land")).where("blue <> 0")
    at = pixels.withColumn("cell", hexgrid.cell_at(F.col("lat"), F.col("lng"), 7))
    found = at.groupBy("cell").agg(F.count("*").alias("pixels"), F.max(geo.terrarium_m(F.col("red"), F.col("green"), F.col("blue"))).alias("max_elevation_m"))
    return found.withColumn("cell", cells.to_hex(F.col("cell")))


_PORTS = f"WITH RECURSIVE {_lattice(f'SELECT node_id * 2 AS k, {LEVEL} AS res, lat, lng FROM w_nodes UNION ALL SELECT port_id * 2 + 1, {LEVEL}, lat, lng FROM w_ports')}, {_named('spot', 'named')}, own AS (SELECT id, min(f) AS f, min(i) AS i, min(j) AS j FROM named JOIN spot USING (k) WHERE k % 2 = 0 GROUP BY id)"
_NEAR = f"around AS (SELECT s.k * 100 + row_number() OVER (PARTITION BY s.k) AS k, {LEVEL} AS res, s.f, s.i + a AS i, s.j + b AS j, distance FROM spot s CROSS JOIN {_OFFSETS} WHERE s.k % 2 = 1)"


@query(
    f"{_PORTS}, {_NEAR}, {_named('around', 'other')}, {_placed(f'SELECT id AS k, f, {_plane("i", "j", str(LEVEL))} FROM own', 'centre')}, "
    "hit AS (SELECT (around.k // 100 - 1) // 2 AS port_id, other.id, distance, pow(c.lat - p.lat, 2) + pow(c.lng - p.lng, 2) AS d2 FROM around JOIN other USING (k) JOIN own o ON o.id = other.id JOIN centre c ON c.k = other.id JOIN w_ports p ON p.port_id = (around.k // 100 - 1) // 2), "
    "best AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY port_id ORDER BY distance, d2, id) = 1) SELECT p.port_id, printf('%x', id) AS cell, distance::INT AS ring FROM w_ports p LEFT JOIN best USING (port_id)"
)
def snap_to_cell(spark, sf_dir):
    """The cell of the world nearest to each port: of the first ring with any, up to three, by squared degrees."""
    points = view(spark, sf_dir, "w_ports").select(F.col("port_id").alias("point_id"), "lat", "lng")
    found = cover.snapped_to_cells(points, world_cells(spark, sf_dir), LEVEL, 3)
    return found.select(F.col("point_id").alias("port_id"), cells.to_hex(F.col("cell")).alias("cell"), "ring")
