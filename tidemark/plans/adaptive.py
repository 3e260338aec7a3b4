"""Covering a sea with cells, coarse ones far from land and fine ones along the coast, level by level."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import cells, geo, hexgrid
from tidemark.operators import cover, polygons
from tidemark.plans.areas import _CROSSED, _MEET, _POLYGONS, _SHARE, SIDE, world_rings
from tidemark.plans.catalogue import query
from tidemark.plans.grid import _CORNER, _GREAT, _lattice, _named, _placed, _plane
from tidemark.session import Tables, shared_folder
from tidemark.sources.world import view


class Rules(NamedTuple):
    """Levels and distances of a cover."""

    last: int = 7  # cells of this level are not refined
    land_level: int = 5  # where land well inside is left, but for a strip along the coast
    land_strip_m: float = 10_000.0


def _distances(points: DataFrame, coast: polygons.Pyramid) -> DataFrame:
    """(point_id, dist_m): great circles to the places on the coast that are nearest in the plane."""
    near = polygons.nearest_segment(points, coast).withColumnsRenamed({"x": "nx", "y": "ny"})
    return points.join(near, "point_id").select("point_id", geo.great_circle(F.col("y"), F.col("x"), F.col("ny"), F.col("nx")).alias("dist_m"))


def judged(table: DataFrame, land: DataFrame, coast: polygons.Pyramid, level: int, rules: Rules) -> DataFrame:
    """The cells (cell) of a level with dist_m, intersects, closest_m, what ``cover.classified`` makes of them, and whether they are refined.

    ``closest_m`` is known up to the land level: 0 where a coast runs through the cell, else
    the least distance of its corners if land meets it.
    """
    tables = Tables(table.sparkSession)
    table = tables.keep(table, "cells")
    met = polygons.meeting(polygons.cell_rings(table), land, coast.side)
    land_of = tables.keep(met.groupBy(F.col("a_id").alias("cell")).agg(F.max("touch").alias("touch"), F.max("within").alias("within")), "land")
    centres = table.select("cell", hexgrid.center(F.col("cell")).alias("at")).select(F.col("cell").alias("point_id"), F.col("at.lng").alias("x"), F.col("at.lat").alias("y"))
    out = table.join(land_of, "cell", "left").join(_distances(centres, coast).withColumnRenamed("point_id", "cell"), "cell", "left")
    out = out.withColumns({"intersects": F.col("touch").isNotNull(), "touch": F.coalesce("touch", F.lit(False)), "within": F.coalesce("within", F.lit(False))})
    if level <= rules.land_level:
        inner = land_of.where("not touch").select("cell", F.posexplode(hexgrid.boundary(F.col("cell"))).alias("k", "p"))
        corners = inner.select(F.struct("cell", "k").alias("point_id"), F.col("p.lng").alias("x"), F.col("p.lat").alias("y"))
        nearest = _distances(corners, coast).groupBy(F.col("point_id.cell").alias("cell")).agg(F.min("dist_m").alias("corner_m"))
        out = out.join(nearest, "cell", "left").withColumn("closest_m", F.when(F.col("touch"), 0.0).otherwise(F.col("corner_m"))).drop("corner_m")
    else:
        out = out.withColumn("closest_m", F.lit(None).cast("double"))
    diameter = cells.MEAN_EDGE_M[level] * (1.5 if level == rules.last - 1 else 2)
    marked = cover.classified(out, F.lit(diameter), F.lit(rules.land_strip_m), F.col("within"))
    refined = F.col("refined") if level == rules.land_level else ~F.col("sea_only")
    return marked.select("cell", "dist_m", "intersects", "closest_m", "sea_only", "land_dem", (refined & F.lit(level < rules.last)).alias("refined"))


def _kept(spark: SparkSession, path: str) -> DataFrame | None:
    """A layer that has been written to its end."""
    try:
        spark.read.text(f"{path}/_SUCCESS")
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def cover_sea(spark: SparkSession, first: DataFrame, level: int, land: DataFrame, path: str, rules: Rules = Rules(), side: float = SIDE) -> dict[int, DataFrame]:
    """Layers by level, from ``first`` (cell), whose cells are of ``level``; a layer's refined cells are parents of the next.

    Each layer is written below ``path`` before the next begins; a run that was stopped goes on
    after the last layer that is whole. It ends when nothing is left to refine.
    """
    layers: dict[int, DataFrame] = {}
    table, coast = first.select("cell").distinct(), None
    while level <= rules.last:
        where = f"{path}/hexes_r{level}"
        layer = _kept(spark, where)
        if layer is None:
            coast = coast or polygons.pyramid(polygons.segments(land), side)
            judged(table, land, coast, level, rules).write.mode("overwrite").parquet(where)
            layer = spark.read.parquet(where)
        layers[level] = layer
        table = layer.where("refined").select(F.explode(cells.children(F.col("cell"), level + 1)).alias("cell")) if level < rules.last else table.limit(0)
        level += 1
        if table.isEmpty():
            break
    return layers


_RULES = Rules(last=6)
_POINTS = (
    "SELECT -node_id AS k, 4 AS res, lat, lng FROM w_nodes UNION ALL SELECT 3 * n + res - 4, res, lat, lng FROM (SELECT row_number() OVER () AS n, s + a * 2e-2 AS lat, w + b * 3e-2 AS lng FROM (SELECT min(lat) - 1 AS s, max(lat) + 1 AS n_, min(lng) - 1 AS w, max(lng) + 1 AS e FROM w_nodes) "
    "CROSS JOIN LATERAL (SELECT unnest(range(0, ceil((n_ - s) / 2e-2)::BIGINT)) AS a) CROSS JOIN LATERAL (SELECT unnest(range(0, ceil((e - w) / 3e-2)::BIGINT)) AS b)) CROSS JOIN (VALUES (4), (5), (6)) r(res)"
)
_OWN = "own AS (SELECT id, min(spot.res) AS res, min(f) AS f, min(i) AS i, min(j) AS j FROM named JOIN spot USING (k) GROUP BY id)"
_SIDES = f"""{_placed(f'SELECT id AS k, res, corner, f, {_plane("(i+a/3e0)", "(j+b/3e0)")} FROM own CROSS JOIN {_CORNER}', 'corners')},
  hexes AS (SELECT k AS cell, res, lng AS hx1, lat AS hy1, coalesce(lead(lng) OVER w, first_value(lng) OVER w) AS hx2, coalesce(lead(lat) OVER w, first_value(lat) OVER w) AS hy2 FROM corners WINDOW w AS (PARTITION BY k ORDER BY corner)),
  {_placed(f'SELECT id AS k, res, f, {_plane("i", "j")} FROM own', 'centre')}"""
_FIRST = "SELECT poly_id, ring, min_by(x, k) AS x, min_by(y, k) AS y FROM vertices WHERE poly_id >= 0 GROUP BY poly_id, ring"
_TO_COAST = _GREAT.replace("x.lat", "lat").replace("x.lng", "lng").replace("y.lat", "ny").replace("y.lng", "nx")


def _coast(points: str, name: str) -> str:
    """ctes: dist_m of points (k, lat, lng), every segment tried."""
    return f"""{name}_near AS (SELECT p.*, x1 + {_SHARE}*(x2-x1) AS nx, y1 + {_SHARE}*(y2-y1) AS ny FROM ({points}) p CROSS JOIN land),
  {name} AS (SELECT k, {_TO_COAST} AS dist_m FROM {name}_near QUALIFY row_number() OVER (PARTITION BY k ORDER BY pow(nx-lng,2)+pow(ny-lat,2), nx, ny) = 1)"""


def _up(level: int) -> str:
    return f"((cell & {~(15 << 52)}) | {level << 52} | {(1 << 3 * (15 - level)) - 1})"


@query(
    f"WITH RECURSIVE {_lattice(_POINTS)}, {_named('spot', 'named')}, {_OWN}, {_SIDES}, {_POLYGONS}, land AS (SELECT * FROM sides WHERE poly_id >= 0), "
    f"touch AS (SELECT DISTINCT cell FROM hexes JOIN land ON {_MEET}), "
    f"inside_ AS (SELECT DISTINCT cell FROM (SELECT cell, poly_id FROM (SELECT DISTINCT ON (cell) cell, hx1, hy1 FROM hexes) JOIN land ON {_CROSSED.format(x='hx1', y='hy1')} GROUP BY cell, poly_id HAVING count(*) % 2 = 1)), "
    f"holds AS (SELECT DISTINCT cell FROM (SELECT cell, poly_id, ring FROM ({_FIRST}) v JOIN hexes ON (hy1 <= y) <> (hy2 <= y) AND x < hx1 + (y - hy1) / (hy2 - hy1) * (hx2 - hx1) GROUP BY ALL HAVING count(*) % 2 = 1)), "
    f"{_coast('SELECT k, lat, lng FROM centre', 'far')}, inner_ AS (SELECT cell FROM (SELECT cell FROM inside_ UNION SELECT cell FROM holds) ANTI JOIN touch USING (cell)), "
    f"{_coast('SELECT k * 10 + corner AS k, lat, lng FROM corners SEMI JOIN inner_ ON inner_.cell = corners.k WHERE res <= 5', 'corner')}, near_corner AS (SELECT k // 10 AS cell, min(dist_m) AS m FROM corner GROUP BY 1), "
    "facts AS (SELECT c.k AS cell, res, dist_m, t.cell IS NOT NULL OR n.cell IS NOT NULL AS intersects, CASE WHEN res <= 5 THEN CASE WHEN t.cell IS NOT NULL THEN 0e0 ELSE near_corner.m END END AS closest_m, n.cell IS NOT NULL AND h.cell IS NULL AS within, "
    f"CASE res WHEN 4 THEN {2 * cells.MEAN_EDGE_M[4]!r} WHEN 5 THEN {1.5 * cells.MEAN_EDGE_M[5]!r} ELSE {2 * cells.MEAN_EDGE_M[6]!r} END::DOUBLE AS diameter "
    "FROM centre c JOIN far USING (k) LEFT JOIN touch t ON t.cell = c.k LEFT JOIN inner_ n ON n.cell = c.k LEFT JOIN holds h ON h.cell = c.k LEFT JOIN near_corner ON near_corner.cell = c.k), "
    "marked AS (SELECT *, dist_m > diameter AND NOT intersects AS sea_only FROM facts), flagged AS (SELECT *, NOT sea_only AND coalesce(closest_m <= 10000, false) AS land_dem, NOT sea_only AND coalesce(closest_m >= 0, false) AS land_only FROM marked), "
    "judged AS (SELECT *, CASE res WHEN 4 THEN NOT sea_only WHEN 5 THEN (NOT sea_only AND NOT land_only) OR (land_dem AND NOT within) ELSE false END AS refined FROM flagged), "
    "c4 AS (SELECT * FROM judged WHERE res = 4 AND cell IN (SELECT id FROM named WHERE k < 0)), "
    f"c5 AS (SELECT j.* FROM judged j JOIN c4 p ON j.res = 5 AND p.refined AND p.cell = {_up(4).replace('cell', 'j.cell')}), c6 AS (SELECT j.* FROM judged j JOIN c5 p ON j.res = 6 AND p.refined AND p.cell = {_up(5).replace('cell', 'j.cell')}) "
    "SELECT res::INT AS level, printf('%x', cell) AS cell, round(dist_m, 1) AS dist_m, intersects, round(closest_m, 1) AS closest_m, sea_only, land_dem, refined FROM (SELECT * FROM c4 UNION ALL SELECT * FROM c5 UNION ALL SELECT * FROM c6)"
)
def adaptive_cover(spark, sf_dir):
    """The sea around the world's land from level 4 to 6."""
    land = world_rings(spark, sf_dir).where("poly_id >= 0")
    first = view(spark, sf_dir, "w_nodes").select(hexgrid.cell_at(F.col("lat"), F.col("lng"), 4).alias("cell"))
    layers = cover_sea(spark, first, 4, land, shared_folder(spark), _RULES)
    rows = [t.withColumn("level", F.lit(k)) for k, t in layers.items()]
    out = rows[0]
    for t in rows[1:]:
        out = out.unionByName(t)
    return out.select("level", cells.to_hex(F.col("cell")).alias("cell"), F.round("dist_m", 1).alias("dist_m"), "intersects", F.round("closest_m", 1).alias("closest_m"), "sea_only", "land_dem", "refined")
