"""Shards that each hold the mixture of sources, in Spark's own expressions only.

Rows of a source are put in a seeded random order; the k-th of n gets the fractional rank
(k - 1/2) / n. Sorted by it, the sources interleave in proportion, and equal cuts of that
order are the shards. Both ranks are counted in buckets of a uniform hash or of the rank
itself: counts per bucket give a bucket's first rank, a window numbers the rows within. So
no source, however large, is numbered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import Scratch

BUCKETS = 4096


def text_size(text: Column, overhead: int = 16) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(overhead)


def _numbered(rows: DataFrame, group: list[str], bucket: str, order: list[str], to: str) -> DataFrame:
    """Position of each row within its group, from 1, by bucket and then by ``order``. Without a group there are BUCKETS counts at most, which are broadcast."""
    counts = rows.groupBy(*group, bucket).agg(F.count("*").alias("in_bucket"))
    upto = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("in_bucket").over(upto), F.lit(0))).drop("in_bucket")
    before = before if group else F.broadcast(before)
    within = Window.partitionBy(*group, bucket).orderBy(*order)
    return rows.withColumn("within", F.row_number().over(within)).join(before, [*group, bucket]).withColumn(to, F.col("before") + F.col("within")).drop("before", "within")


def interleave(docs: DataFrame, shards: int = 40, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``.

    The law is ``rows``: shards hold equally many rows, or one more or less, and each source
    is spread over them in proportion. size is the text's UTF-8 bytes plus 16 (null: 16);
    text_crc32 is of no bytes for a null text. Rows without a source are a source of their own.
    Repeated rows and ids each get a place; order among rows alike in id, text and source
    makes no difference to the result. grown_shard is null. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).alias("row_id"),
        F.when(F.col(source_col).isNull(), "").otherwise(F.concat(F.lit("="), F.col(source_col).cast("string"))).alias("src"),  # no source is another than the null one
        text_size(F.col(text_col)).alias("size"),
        F.crc32(F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8")).alias("crc"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("draw"),
    ).withColumn("bucket", F.shiftrightunsigned("draw", 52).cast("int"))
    ranked = _numbered(rows, ["src"], "bucket", ["draw", "row_id", "crc"], "rank")
    totals = rows.groupBy("src").agg(F.count("*").alias("total"))
    placed = scratch.keep(ranked.join(totals, "src").withColumn("share", (F.col("rank") - F.lit(0.5)) / F.col("total")).withColumn("bucket", F.floor(F.col("share") * BUCKETS).cast("int")).drop("rank", "total"), "ranked")
    order = _numbered(placed, [], "bucket", ["share", "src", "draw", "row_id"], "place").crossJoin(F.broadcast(placed.agg(F.count("*").alias("n")))).withColumn("place", F.col("place") - 1)
    return (
        order.withColumn("shard", F.expr(f"((place + 1) * {shards} - 1) div n").cast("int"))
        .withColumn("slot", F.col("place") - F.expr(f"(shard * n) div {shards}"))
        .select(F.col("row_id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.when(F.col("src") != "", F.expr("substring(src, 2)")).alias(source_col))
    )
