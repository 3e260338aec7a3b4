"""Lines as arrays of (x, y) structs: smoothing, simplification, resampling, bounds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import workers_can_import

POINTS = "array<struct<x:double,y:double>>"


def smoothed(line: Column, passes: int = 3) -> Column:
    """Corner cutting: every segment gives its quarter points, both ends stay; under three points nothing changes."""

    def once(points: Column) -> Column:
        ahead = F.slice(points, 2, F.size(points) - 1)
        cut = F.flatten(
            F.zip_with(F.slice(points, 1, F.size(points) - 1), ahead, lambda p, q: F.array(*(F.struct((a * p.x + (1 - a) * q.x).alias("x"), (a * p.y + (1 - a) * q.y).alias("y")) for a in (0.75, 0.25))))
        )
        return F.when(F.size(points) < 3, points).otherwise(F.concat(F.slice(points, 1, 1), cut, F.slice(points, -1, 1)))

    for _ in range(passes):
        line = F.get(F.transform(F.array(line), once), F.lit(0))  # a pass looks at its line many times, which is worked out once
    return line


def from_wkt(wkt: Column) -> Column:
    """The points of ``LINESTRING (x y, x y)``; null for other texts, and where a vertex is no pair of numbers."""
    inner = F.regexp_extract(wkt, r"(?i)^\s*LINESTRING\s*\(([^()]*)\)\s*$", 1)
    number = lambda p, k: F.get(F.split(F.trim(p), r"\s+"), F.lit(k)).try_cast("double")
    points = F.transform(F.split(inner, ","), lambda p: F.struct(number(p, 0).alias("x"), number(p, 1).alias("y")))
    return F.when(F.forall(points, lambda p: p.x.isNotNull() & p.y.isNotNull()), points)


def bounds(line: Column) -> dict[str, Column]:
    xs, ys = F.transform(line, lambda p: p.x), F.transform(line, lambda p: p.y)
    return {"west": F.array_min(xs), "south": F.array_min(ys), "east": F.array_max(xs), "north": F.array_max(ys)}


def swapped(line: Column) -> Column:
    return F.transform(line, lambda p: F.struct(p.y.alias("x"), p.x.alias("y")))


def kept(line: Column, tolerance: float) -> Column:
    """Douglas-Peucker, a line at a time: places of the points that lie further than ``tolerance`` from what replaces them, in order; both ends stay."""

    def one(xs: list, ys: list) -> list:
        keep, spans = {0, len(xs) - 1}, [(0, len(xs) - 1)]
        while spans:
            a, b = spans.pop()
            x0, y0 = xs[a], ys[a]
            dx, dy = xs[b] - x0, ys[b] - y0
            far, at = tolerance, -1
            for k in range(a + 1, b):
                px, py = xs[k] - x0, ys[k] - y0
                t = min(1.0, max(0.0, (px * dx + py * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
                d = ((px - t * dx) ** 2 + (py - t * dy) ** 2) ** 0.5
                if d > far:
                    far, at = d, k
            if at >= 0:
                keep.add(at)
                spans += [(a, at), (at, b)]
        return sorted(keep)

    def run(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else one(x.tolist(), y.tolist()) if len(x) > 2 else list(range(len(x))) for x, y in zip(xs, ys)], dtype=object)

    return F.pandas_udf(run, "array<int>")(F.transform(line, lambda p: p.x), F.transform(line, lambda p: p.y))


def simplified(lines: DataFrame, key: str, line: str, tolerance: float) -> DataFrame:
    """Lines of the points that ``kept`` keeps."""
    workers_can_import(lines.sparkSession)
    return lines.select(key, F.transform(kept(F.col(line), tolerance), lambda k: F.get(line, k)).alias(line))


def feature(line: Column, properties: Column) -> Column:
    """A GeoJSON LineString feature, as text."""
    coordinates = F.transform(line, lambda p: F.array(p.x, p.y))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), coordinates.alias("coordinates")).alias("geometry"), properties.alias("properties")))


def route_collections(ways: DataFrame, properties: Column) -> DataFrame:
    """(route, document): a GeoJSON FeatureCollection, as text, of each route's ways (route, origin, destination, direction, line).

    The outward way comes first; each way gives the line between the cells' centres and then
    its smoothed curve. Lines that are null give no feature. ``properties`` are the document's own.
    """
    shape = lambda line: F.struct(F.lit("LineString").alias("type"), F.transform(line, lambda p: F.array(p.x, p.y)).alias("coordinates"))
    one = lambda kind, line: F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(kind).alias("type"), "origin", "destination", "direction").alias("properties"), shape(line).alias("geometry"))
    both = F.array(one("h3 hex centres", F.col("line")), one("spline curve", smoothed(F.col("line"))))
    held = ways.where("line is not null").groupBy("route").agg(F.sort_array(F.collect_list(F.struct((F.col("direction") != "outward").alias("back"), both.alias("features")))).alias("ways"))
    features = F.flatten(F.transform("ways", lambda w: w["features"]))
    return held.select("route", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), features.alias("features"), properties.alias("properties"))).alias("document"))


def resampled(lines: DataFrame, key: str, line: str, spacing: float) -> DataFrame:
    """key, k, x, y: points every ``spacing`` along each line from its start, and its end. Lines of one point give it; nulls give none.

    Running lengths are a window over the vertices; each segment then makes its own points.
    """
    order = Window.partitionBy(key).orderBy("i")
    v = lines.select(key, F.posexplode(line).alias("i", "p")).select(key, "i", "p.x", "p.y")
    v = v.withColumns({"nx": F.lead("x").over(order), "ny": F.lead("y").over(order)}).withColumn("step", F.coalesce(F.sqrt(F.pow(F.col("nx") - F.col("x"), 2) + F.pow(F.col("ny") - F.col("y"), 2)), F.lit(0.0)))
    v = v.withColumn("upto", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("from", F.col("upto") - F.col("step"))
    first, last = F.ceil(F.col("from") / spacing), F.ceil(F.col("upto") / spacing) - 1
    marks = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    share = (F.col("k") * spacing - F.col("from")) / F.col("step")
    inner = v.where("step > 0").select("*", F.explode(marks).alias("k")).select(key, "k", (F.col("x") + share * (F.col("nx") - F.col("x"))).alias("x"), (F.col("y") + share * (F.col("ny") - F.col("y"))).alias("y"))
    ends = v.where("nx is null").select(key, F.ceil(F.col("upto") / spacing).alias("k"), "x", "y")
    return inner.unionByName(ends)


def stepped(start: Column, stop: Column, step: Column) -> Column:
    """start, start + step ... below ``stop``; empty if that is not above the start."""
    n = F.ceil((stop - start) / step).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: start + k * step)).otherwise(F.array().cast("array<double>"))


def rectangle(west: Column, south: Column, east: Column, north: Column) -> Column:
    """A closed ring around a box, from the south-west against the clock."""
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(corner(west, south), corner(east, south), corner(east, north), corner(west, north), corner(west, south))
