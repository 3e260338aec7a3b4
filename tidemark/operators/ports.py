"""Ports: from query bindings to classified places, and searches among them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.geo import TURF_RADIUS_KM, great_circle, point_from_wkt

#: Types of each category, in order of priority. Fixed values.
CATEGORIES: dict[str, list[str]] = {
    "historical": ["archaeological site", "archaeological park", "Roman archaeological site", "Roman bridge", "ancient city", "ancient monument", "ancient port", "historic district", "historic site", "monument", "ruins", "Samian Ware Discovery Site", "cultural heritage", "cultural heritage ensemble", "cultural property", "archaeological artifact museum", "architectural ensemble", "architectural heritage monument", "architectural landmark", "former neighbourhood", "former settlement", "ghost town", "old town", "settlement site"],
    "seaport": ["port", "commercial port", "fishing port", "military port", "container terminal", "cruise port", "dry marina", "deep water port", "guest harbor", "inland port", "historical port", "oil port", "sea terminal", "trust port", "regional port", "major port", "priority port", "harbor", "dock", "wet dock", "port city", "port of entry", "specified port", "port of refuge", "port and harbour facilities (Japan)", "international strategic port", "international hub port (Japan)"],
    "settlement": ["city", "town", "village", "hamlet", "neighborhood", "suburb", "urban area", "urban-type settlement in Russia", "urban area in Sweden", "quarter", "district", "posyolok", "frazione", "ward", "borough", "civil parish", "district of city", "barrio", "gazetted locality of Victoria", "locality", "community", "census-designated place in the United States", "city or town", "city of oblast significance", "city/town in Russia", "neighborhood of Buenos Aires", "suburb/locality of Tasmania", "village in Finland", "village of Senegal", "unparished area", "large burgh"],
    "naval": ["naval base", "naval station", "naval air station", "naval aeronautics base", "Royal Navy Dockyard", "submarine base", "submarine pen", "naval arsenal"],
    "industrial": ["shipyard", "marine oil terminal", "oil depot", "fuel depot", "liquefied natural gas terminal", "floating regasification terminal", "liquefaction terminal", "regasification terminal"],
    "marina": ["marina", "berth", "bathing site", "overnight stay harbour"],
}
# Map style. Fixed values.
COLOURS = {"historical": "red", "settlement": "orange", "seaport": "green", "naval": "#003366", "industrial": "#666666", "marina": "#008080"}
OTHER_COLOUR = "#004080"
RADII = {"historical": 7, "settlement": 5, "seaport": 5}
OTHER_RADIUS = 4


def grouped(bindings: DataFrame, sequence: str) -> DataFrame:
    """One row for each port of (port, label, coord, country, type): the first of each scalar, all types. Ports without a point go."""
    lng, lat = point_from_wkt(F.col("coord"))
    rows = bindings.withColumns({"lng": lng, "lat": lat}).where("lng is not null and lat is not null")
    first = F.min_by(F.struct(F.col("label").alias("name"), "country", "lat", "lng"), sequence).alias("first")
    return rows.groupBy("port").agg(first, F.sort_array(F.collect_set("type")).alias("types")).select("port", "first.*", "types")


def classified(ports: DataFrame) -> DataFrame:
    """Trim types, add categories by priority; ports go that have none, or whose name is a bare Q number."""
    types = F.transform("types", lambda t: F.trim(t))
    found = F.array_compact(F.array(*(F.when(F.arrays_overlap(F.col("types"), F.array(*map(F.lit, own))), F.lit(name)) for name, own in CATEGORIES.items())))
    named = ~F.coalesce(F.trim(F.col("name")).rlike(r"^Q\d+$"), F.lit(False))
    return ports.withColumn("types", types).withColumn("categories", found).where(named & (F.size("categories") > 0))


def styled(ports: DataFrame) -> DataFrame:
    def pick(values: dict, other) -> Column:
        out = F.lit(other)
        for name, value in values.items():
            out = F.when(F.element_at("categories", 1) == name, F.lit(value)).otherwise(out)
        return out

    return ports.withColumns({"colour": pick(COLOURS, OTHER_COLOUR), "radius": pick(RADII, OTHER_RADIUS)})


def within(ports: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    """Ports in a box, edges included."""
    return ports.where(F.col("lat").between(south, north) & F.col("lng").between(west, east))


def nearest(probes: DataFrame, ports: DataFrame, n: int = 1, buffer: float = 0.1) -> DataFrame:
    """The n ports nearest to each probe (probe_id, plat, plng), to the millimetre, then by id, of those within ``buffer`` degrees.

    Ports and probes meet in cells as wide as the buffer, so this is an equi join on three by
    three cells and not a comparison of all with all; neither side is broadcast.
    """
    cell = lambda c: F.floor(c / buffer).cast("long")
    near = F.explode(F.array(*(F.struct((cell(F.col("plat")) + i).alias("y"), (cell(F.col("plng")) + j).alias("x")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    asked = probes.withColumn("cell", near).select("*", "cell.*").drop("cell")
    placed = ports.withColumns({"y": cell(F.col("lat")), "x": cell(F.col("lng"))}).hint("merge")
    asked = asked.join(placed.select("y", "x").distinct(), ["y", "x"], "left_semi")  # cells without ports are not asked
    close = asked.join(placed, ["y", "x"]).where((F.abs(F.col("lat") - F.col("plat")) <= buffer) & (F.abs(F.col("lng") - F.col("plng")) <= buffer))
    close = close.withColumn("distance_km", great_circle(F.col("plat"), F.col("plng"), F.col("lat"), F.col("lng"), TURF_RADIUS_KM))
    order = Window.partitionBy("probe_id").orderBy(F.round("distance_km", 6), "port_id")
    return close.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).drop("y", "x")


def clustered(ports: DataFrame, zoom: int, pixels: int = 40) -> DataFrame:
    """x, y, n: ports by squares of so many screen pixels at a zoom."""
    size = 256.0 * 2.0**zoom / pixels
    lat = F.radians("lat")
    x, y = (F.col("lng") + 180.0) / 360.0, (1.0 - F.ln(F.tan(lat) + 1 / F.cos(lat)) / math.pi) / 2.0
    return ports.groupBy(F.floor(x * size).alias("x"), F.floor(y * size).alias("y")).agg(F.count("*").alias("n"))


def features(ports: DataFrame) -> DataFrame:
    """A GeoJSON feature for each port, as text."""
    point = F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates"))
    about = F.struct("name", "country", "categories")
    return ports.select("port_id", F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), about.alias("properties"))).alias("feature"))
