"""Work that can be taken up again: only keys that are new are processed and appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def pending(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items whose key has not been processed."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def append_new(spark: SparkSession, items: DataFrame, path: str, key: str, work: Callable[[DataFrame], DataFrame]) -> int:
    """Process the items that ``path`` lacks and append them; how many there were, observed as they are written.

    Running it again adds nothing.
    """
    try:
        todo = pending(items, spark.read.parquet(path), key)
    except Exception as e:  # the first run has no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        todo = items
    seen = Observation("added")
    work(todo.observe(seen, F.count(F.lit(1)).alias("n"))).write.mode("append").parquet(path)
    return seen.get["n"]


def follow(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str, work: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Take up the files that have come to a folder since the last run, once, by Structured Streaming."""

    def batch(rows: DataFrame, _: int) -> None:
        append_new(rows.sparkSession, rows.dropDuplicates([key]), target, key, work)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stamped(spark: SparkSession, path: str, version: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A kept table: made again, with its stamp, if it is absent or was made for another version."""
    try:
        kept = spark.read.parquet(path)
        if kept.where(F.col("version") != F.lit(version)).isEmpty() and not kept.isEmpty():
            return kept.drop("version")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    make().withColumn("version", F.lit(version)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).drop("version")
