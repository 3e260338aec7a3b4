"""Geodesy as column expressions: distances, bearings, horizons, tiles, heights."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

CELL_RADIUS_M = 6371007.180918475  # sphere of the hexagonal grid
HAVERSINE_RADIUS_M = 6371e3
TURF_RADIUS_KM = 6371.0088
HORIZON_RADIUS_M = 6_371_000.0
DECK_HEIGHT_M = 3.5


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), x))


def norm(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def great_circle(lat1: Column, lng1: Column, lat2: Column, lng2: Column, radius: float = CELL_RADIUS_M) -> Column:
    """Haversine distance in the unit of ``radius``."""
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lng2) - F.radians(lng1)) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    return great_circle(lat1, lng1, lat2, lng2, HAVERSINE_RADIUS_M)


def planar_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Degrees as 111 km each, whatever the latitude."""
    return norm(lat2 - lat1, lng2 - lng1) * 111_000


def _turned(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lng2) - F.radians(lng1)
    return F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))


def bearing(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Initial bearing in degrees, 0 to 360."""
    return F.pmod(_turned(lat1, lng1, lat2, lng2), F.lit(360.0))


def vector_from(direction: Column) -> tuple[Column, Column]:
    """(east, north) of where something goes that comes from ``direction`` degrees; null for null."""
    r = F.radians(F.pmod(direction + 180, F.lit(360.0)))
    return F.sin(r), F.cos(r)


def edge_vector(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> tuple[Column, Column]:
    """The graph's edge vectors: the bearing taken as a direction to come from, so they point backwards.

    Two turns are added first: all bearings then have the same last digit, so that an engine's last bits do not matter.
    """
    return vector_from(F.pmod(_turned(lat1, lng1, lat2, lng2) + 720, F.lit(360.0)))


def horizon_m(height: Column) -> Column:
    """Arc to the horizon from a height; null below the surface."""
    return F.when(height >= 0, HORIZON_RADIUS_M * F.acos(HORIZON_RADIUS_M / (HORIZON_RADIUS_M + height)))


def deck_visibility_m(elevation: Column) -> Column:
    """How far land of an elevation is seen from the deck."""
    deck = HORIZON_RADIUS_M * math.acos(HORIZON_RADIUS_M / (HORIZON_RADIUS_M + DECK_HEIGHT_M))
    return horizon_m(elevation) + deck


def tile_x(lng: Column, zoom: int) -> Column:
    return ((lng + 180.0) / 360.0 * 2.0**zoom).cast("int")


def tile_y(lat: Column, zoom: int) -> Column:
    """Null at the poles and beyond, where the projection ends."""
    r = F.radians(lat)
    return F.when(F.abs(lat) < 90, ((1.0 - F.ln(F.tan(r) + 1 / F.cos(r)) / math.pi) / 2.0 * 2.0**zoom).cast("int"))


def tile_west(x: Column, zoom: int) -> Column:
    return x / 2.0**zoom * 360.0 - 180.0


def tile_north(y: Column, zoom: int) -> Column:
    return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y / 2.0**zoom))))


def terrarium_m(red: Column, green: Column, blue: Column) -> Column:
    """Elevation of a colour."""
    return red * 256.0 + green + blue / 256.0 - 32768.0


def mercator_x(lng: Column) -> Column:
    return F.radians(lng) * 6378137.0


def mercator_y(lat: Column) -> Column:
    return F.ln(F.tan(F.radians(lat) / 2 + math.pi / 4)) * 6378137.0


def point_from_wkt(wkt: Column) -> tuple[Column, Column]:
    """(lng, lat) of ``POINT (lng lat)``; nulls if it is none."""
    number = r"([-+0-9.eE]+)"
    pattern = rf"^\s*[Pp][Oo][Ii][Nn][Tt]\s*\(\s*{number}\s+{number}\s*\)\s*$"
    lng, lat = (F.nullif(F.regexp_extract(wkt, pattern, k), F.lit("")).try_cast("double") for k in (1, 2))
    return lng, lat
