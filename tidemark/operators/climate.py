"""Climatology, sampling on regular grids, interpolation in latitude."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.names import free_name


def monthly_means(obs: DataFrame, cell: str, ts: str, variables: list[str]) -> DataFrame:
    """cell, month and the mean of each variable over all years; nulls and NaN do not count."""
    return obs.groupBy(cell, F.month(ts).alias("month")).agg(*(F.avg(F.when(~F.isnan(v), F.col(v))).alias(v) for v in variables))


def annual_means(monthly: DataFrame, cell: str, variables: list[str]) -> DataFrame:
    """Means of the monthly means: months count alike, however many observations they have."""
    return monthly.groupBy(cell).agg(*(F.avg(v).alias(v) for v in variables))


def grid_index(x: Column, origin: float, step: float) -> Column:
    """Index of the nearest line of a regular grid; halves go up."""
    return F.floor((x - origin) / step + 0.5).cast("long")


def nearest_samples(points: DataFrame, raster: DataFrame, origin: tuple[float, float], step: tuple[float, float]) -> DataFrame:
    """Each point (lat, lng) with the raster cell (gy, gx) nearest to it: an equi join on computed indexes."""
    return points.withColumns({"gy": grid_index(F.col("lat"), origin[0], step[0]), "gx": grid_index(F.col("lng"), origin[1], step[1])}).join(raster, ["gy", "gx"], "left")


def interpolated(points: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """Value of (ilat, month) interpolated between whole latitudes; 0.5 where the table has none."""
    lo, a, b = (free_name(points, n) for n in ("lo", "at_lo", "at_hi"))
    low = table.select(F.col("ilat").alias(lo), "month", F.col(value).alias(a))
    high = table.select((F.col("ilat") - 1).alias(lo), "month", F.col(value).alias(b))
    share = F.col("lat") - F.col(lo)
    joined = points.withColumn(lo, F.floor("lat").cast("long")).join(low, [lo, "month"], "left").join(high, [lo, "month"], "left")
    return joined.withColumn(value, F.coalesce(F.when(share == 0, F.col(a)).otherwise(F.col(a) + share * (F.col(b) - F.col(a))), F.lit(0.5))).drop(lo, a, b)


def pivoted(rows: DataFrame, keys: list[str], value: str, prefix: str) -> DataFrame:
    """One column for each month, 01 to 12; null where a month is missing."""
    wide = rows.groupBy(*keys).pivot("month", list(range(1, 13))).agg(F.first(value))
    return wide.select(*keys, *(F.col(str(m)).alias(f"{prefix}{m:02d}") for m in range(1, 13)))


def by_month(samples: DataFrame, conditions: DataFrame, key: str) -> DataFrame:
    """Each sample in all twelve months with the conditions (key, month, ...) there; null where a month has none."""
    every = samples.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    return every.join(conditions, [key, "month"], "left")


def merged_datasets(datasets: list[DataFrame], keys: list[str]) -> DataFrame:
    """Datasets as one: rows with equal keys are one row, which has the variables of all; where several have a variable, the last that knows it.

    Rows of one dataset with equal keys count as one, with the largest values. Keys are not null.
    """
    names = list(dict.fromkeys(c for d in datasets for c in d.columns if c not in keys))
    turn = "turn"
    while turn in (*keys, *names):
        turn += "_"
    kinds = {c: d.schema[c].dataType for d in datasets for c in d.columns}
    every = None
    for k, d in enumerate(datasets):
        rows = d.select(*keys, F.lit(k).alias(turn), *(F.col(c) if c in d.columns else F.lit(None).cast(kinds[c]).alias(c) for c in names))
        every = rows if every is None else every.unionByName(rows)
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(turn, c)))[c].alias(c)
    return every.groupBy(*keys).agg(*(last(c) for c in names))
