"""Climate and penalty formulas as column expressions. NaN is null here; normalise on the way in."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.geo import clamp, norm

ABSOLUTE_ZERO_C = 273.15


def clean(x: Column, default: float | None = None) -> Column:
    """NaN and infinities become null, or the default, as nulls do."""
    good = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    return good if default is None else F.coalesce(good, F.lit(default))


def celsius(kelvin: Column) -> Column:
    return kelvin - ABSOLUTE_ZERO_C


def temperature_depression(t2m: Column, d2m: Column) -> Column:
    return celsius(t2m) - celsius(d2m)


def visibility_m(depression: Column, precipitation: Column, low_cloud: Column) -> Column:
    """Least of three hyperbolas, between 10 m and 50 km.

    A depression or precipitation that is null or not positive counts as 0; unknown cloud
    makes the result unknown. NaN and infinities are unknown.
    """
    depression, precipitation, low_cloud = clean(depression), clean(precipitation), clean(low_cloud)
    humid = 10_000.0 / (F.when(depression > 0, depression).otherwise(0.0) + 0.5)
    rain = 5_000.0 / (F.when(precipitation > 0, precipitation).otherwise(0.0) + 0.01)
    cloud = 5_000.0 / (low_cloud + 0.01)
    return F.when(low_cloud.isNotNull(), clamp(F.least(humid, rain, cloud), 10.0, 50_000.0))


def daylight_ratio(latitude: Column, day_of_year: Column) -> Column:
    """Share of a day between sunrise and sunset at longitude 0 (zenith 90.833 degrees).

    The sun's declination by its Fourier series in the day of the year; where it never rises
    or sets, 0 or 1.
    """
    g = 2 * math.pi * (day_of_year - 1) / 365.0
    decl = 0.006918 - 0.399912 * F.cos(g) + 0.070257 * F.sin(g) - 0.006758 * F.cos(2 * g) + 0.000907 * F.sin(2 * g) - 0.002697 * F.cos(3 * g) + 0.00148 * F.sin(3 * g)
    lat = F.radians(latitude)
    cosine = F.lit(math.cos(math.radians(90.833))) / (F.cos(lat) * F.cos(decl)) - F.tan(lat) * F.tan(decl)
    return F.acos(clamp(cosine, -1.0, 1.0)) / math.pi


def directional_penalty(dx: Column, dy: Column, vx: Column, vy: Column) -> Column:
    """1 along a vector to 2 against it; 1 where there is no vector or no direction."""
    sizes = norm(dx, dy) * norm(vx, vy)
    angle = F.acos(clamp((dx * vx + dy * vy) / F.nullif(sizes, F.lit(0.0)), -1.0, 1.0))
    return F.coalesce(F.when(sizes > 0, 1.0 + angle / math.pi), F.lit(1.0))


def darkness_penalty(daylight: Column, clear_land: Column, visibility: Column) -> Column:
    """3 x darkness, three times that where no land is known or it is beyond sight; nulls are 0."""
    dark = 3.0 * (1.0 - F.coalesce(daylight, F.lit(0.0)))
    land, seen = F.coalesce(clear_land, F.lit(0.0)), F.coalesce(visibility, F.lit(0.0))
    return F.when((land == 0) | (land > seen), dark * 3.0).otherwise(dark)


def static_cost(length: Column, current: Column, wind: Column, wave: Column, penalty: Column) -> Column:
    """Cost of an edge from its directional penalties and that of its target."""
    return length * F.pow(current, 2.0) * F.pow(wind, 1.5) * F.pow(wave, 1.2) * penalty


def coastal_weight(distance_m: Column) -> Column:
    return 1 / (1 + 1000 / (distance_m + 10))


def next_month(month: Column) -> Column:
    return month % 12 + 1
