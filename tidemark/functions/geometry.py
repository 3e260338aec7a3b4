"""Geometries as text and as bytes, read to arrays of rings or lines, in column expressions.

A result is an array of (part, ring, points), points being (x, y): one entry for each ring of a
polygon, 0 for outer ones, or for each line; null for what is no geometry of these kinds. Rings
keep their closing point.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
_POINT = rf"\s*{_NUMBER}\s+{_NUMBER}(?:\s+{_NUMBER})*\s*"
_LINE = rf"\s*\({_POINT}(?:,{_POINT})*\)\s*"
_RINGS = rf"\s*\({_LINE}(?:,{_LINE})*\)\s*"


def _points(text: Column) -> Column:
    pair = lambda t: F.regexp_extract_all(t, F.lit(f"({_NUMBER})"), 1)
    return F.transform(F.split(text, ","), lambda t: F.struct(F.get(pair(t), F.lit(0)).cast("double").alias("x"), F.get(pair(t), F.lit(1)).cast("double").alias("y")))


def from_wkt(text: Column) -> Column:
    """LINESTRING, MULTILINESTRING, POLYGON and MULTIPOLYGON, further coordinates left out; null for others, for EMPTY and for broken text."""
    body = F.regexp_replace(text, r"^\s*(?:[Mm][Uu][Ll][Tt][Ii])?(?:[Ll][Ii][Nn][Ee][Ss][Tt][Rr][Ii][Nn][Gg]|[Pp][Oo][Ll][Yy][Gg][Oo][Nn])\s*(?:[Zz][Mm]?|[Mm])?\s*", "")
    is_kind = lambda name, shape: text.rlike(rf"(?i)^\s*{name}\s*(?:ZM?|M)?{shape}\s*$")
    lines = lambda t: F.regexp_extract_all(t, F.lit(r"\(([^()]+)\)"), 1)
    one = lambda part, ring, t: F.struct(part.cast("int").alias("part"), ring.cast("int").alias("ring"), _points(t).alias("points"))
    zero = F.lit(0)
    many = F.flatten(F.transform(F.regexp_extract_all(body, F.lit(rf"(\({_LINE}(?:,{_LINE})*\))"), 1), lambda p, i: F.transform(lines(p), lambda t, k: one(i, k, t))))
    return (
        F.when(is_kind("LINESTRING", _LINE), F.transform(lines(body), lambda t: one(zero, zero, t)))
        .when(is_kind("MULTILINESTRING", _RINGS), F.transform(lines(body), lambda t, i: one(i, zero, t)))
        .when(is_kind("POLYGON", _RINGS), F.transform(lines(body), lambda t, k: one(zero, k, t)))
        .when(is_kind("MULTIPOLYGON", rf"\s*\({_RINGS}(?:,{_RINGS})*\)"), many)
    )


def _let(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _bytes(digits: Column, at: Column, n: int, little: Column) -> Column:
    """``n`` bytes from a place, as hexadecimal digits with the highest first."""
    part = F.substring(digits, 2 * at + 1, F.lit(2 * n))
    turned = F.concat(*(F.substring(part, F.lit(2 * k + 1), F.lit(2)) for k in range(n - 1, -1, -1)))
    return F.when(little, turned).otherwise(part)


def _whole(digits: Column, at: Column, little: Column) -> Column:
    return F.conv(_bytes(digits, at, 4, little), 16, 10).cast("long")


def _double(digits: Column, at: Column, little: Column) -> Column:
    """A double of its bits: a whole number of 53 bits times a power of two, so it is exact."""

    def value(h: Column) -> Column:
        top = F.conv(F.substring(h, F.lit(1), F.lit(3)), 16, 10).cast("int")
        low = F.conv(F.substring(h, F.lit(4), F.lit(13)), 16, 10).cast("long")
        power, sign = top.bitwiseAND(2047), F.when(top >= 2048, -1.0).otherwise(1.0)
        small = F.when(power == 0, low).otherwise(low + (1 << 52)).cast("double")
        power_of_two = F.greatest(power, F.lit(1)) - 1075
        half = F.floor(power_of_two / 2)  # two steps, as the power alone may be out of range
        return F.when(power < 2047, sign * small * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), power_of_two - half)).when(low == 0, sign * F.lit(float("inf"))).otherwise(F.lit(float("nan")))

    return _let(_bytes(digits, at, 8, little), value)


def _run(digits: Column, at: Column, little: Column, size: Column) -> Column:
    """(points, after) of a counted run of points of ``size`` bytes each."""
    n = _whole(digits, at, little)

    def read(count: Column) -> Column:
        place = lambda i: at + 4 + i * size
        points = F.transform(F.sequence(F.lit(1).cast("long"), count), lambda i: F.struct(_double(digits, place(i - 1), little).alias("x"), _double(digits, place(i - 1) + 8, little).alias("y")))
        none = F.array().cast("array<struct<x: double, y: double>>")
        return F.struct(F.when(count > 0, points).otherwise(none).alias("points"), (at + 4 + count * size).alias("after"))

    return _let(n, read)


_STATE = "struct<after: bigint, rings: array<struct<part: int, ring: int, points: array<struct<x: double, y: double>>>>>"


def _shape(digits: Column, begin: Column, part: Column, held: Column) -> Column:
    """Read a line or polygon that begins at ``begin``; its rings are added to ``held``, and where it ends is told."""
    head = F.struct((F.substring(digits, 2 * begin + 1, F.lit(2)) == "01").alias("little"), begin.alias("at"))

    def of(h: Column) -> Column:
        raw = _whole(digits, h["at"] + 1, h["little"])
        plain = raw.bitwiseAND(0x0FFFFFFF)
        more = F.floor(plain / 1000) + F.when(raw.bitwiseAND(0x80000000) != 0, 1).otherwise(0) + F.when(raw.bitwiseAND(0x40000000) != 0, 1).otherwise(0)
        dims = F.when(F.floor(plain / 1000) == 3, 2).otherwise(more)
        start = h["at"] + 5 + F.when(raw.bitwiseAND(0x20000000) != 0, 4).otherwise(0)
        return _let(F.struct(h["little"].alias("little"), (plain % 1000).alias("kind"), (16 + 8 * dims).cast("long").alias("size"), start.cast("long").alias("at")), rings)

    def rings(h: Column) -> Column:
        polygon = h["kind"] == 3
        count = F.when(polygon, _whole(digits, h["at"], h["little"])).when(h["kind"] == 2, 1)
        start = F.struct((h["at"] + F.when(polygon, 4).otherwise(0)).cast("long").alias("after"), held.alias("rings")).cast(_STATE)

        def ring(s: Column, k: Column) -> Column:
            return _let(_run(digits, s["after"], h["little"], h["size"]), lambda r: F.struct(r["after"].alias("after"), F.concat(s["rings"], F.array(F.struct(part.cast("int").alias("part"), (k - 1).cast("int").alias("ring"), r["points"].alias("points")))).alias("rings")).cast(_STATE))

        return F.when(count > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), count), start, ring)).when(count == 0, start)

    return _let(head, of)


def from_wkb(blob: Column) -> Column:
    """Well-known binary, plain or extended, of either byte order, with or without a GeoPackage header: lines, polygons and collections of one of these kinds.

    Null for other kinds, and for bytes that end too early. Third and fourth coordinates are left out.
    """
    digits = F.hex(blob)
    envelope = F.get(F.array(*(F.lit(n) for n in (0, 32, 48, 48, 64))), F.floor(F.conv(F.substring(digits, 7, 2), 16, 10).cast("int") / 2).cast("int").bitwiseAND(7))
    begin = F.when(digits.startswith("4750"), 8 + envelope).otherwise(0).cast("long")
    none = F.array().cast("array<struct<part: int, ring: int, points: array<struct<x: double, y: double>>>>")

    def whole(d: Column) -> Column:
        little = F.substring(d["digits"], 2 * d["begin"] + 1, F.lit(2)) == "01"
        raw = _whole(d["digits"], d["begin"] + 1, little)
        kind = raw.bitwiseAND(0x0FFFFFFF) % 1000
        start = d["begin"] + 5 + F.when(raw.bitwiseAND(0x20000000) != 0, 4).otherwise(0)
        count = _whole(d["digits"], start, little)
        parts = F.aggregate(F.sequence(F.lit(1).cast("long"), count), F.struct((start + 4).cast("long").alias("after"), none.alias("rings")).cast(_STATE), lambda s, i: _shape(d["digits"], s["after"], i - 1, s["rings"]))
        found = F.when(kind.isin(2, 3), _shape(d["digits"], d["begin"], F.lit(0), none)).when(kind.isin(5, 6) & (count > 0), parts)
        return _let(found, lambda s: F.when(s["after"] * 2 <= F.length(d["digits"]), s["rings"]))

    return F.when(F.length(digits) >= 18, _let(F.struct(digits.alias("digits"), begin.alias("begin")), whole))


def valid(rings: Column) -> Column:
    """Whether what was read can be used: there are rings or lines, and each has two points and finite coordinates."""
    fine = lambda p: (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf"))
    return F.coalesce((F.size(rings) > 0) & F.forall(rings, lambda r: (F.size(r["points"]) > 1) & F.forall(r["points"], fine)), F.lit(False))
