"""Corpus cleaning from documents to packed sequences, stage by stage.

A stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and all but the
last return the columns of documents. Rows without a doc_id pass the near-duplicate and
substring stages unchanged; rows that share a doc_id are one document
there.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, neardup, packing, passages, quality
from tidemark.llm.shared import Scratch, free_name

ORACLE_SQL = None  # models, registers and tokens are beyond SQL; the tests hold run() against brute force

LEAST_LANGUAGE_SCORE = 0.3  # clear texts of a learned language score over 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. Rows are told apart by 128 bits of all their columns; equal rows have equal verdicts."""
    row = free_name(docs, "row")
    marked = docs.withColumn(row, F.struct(F.xxhash64(*docs.columns).alias("a"), F.xxhash64(F.lit(1), *docs.columns).alias("b")))
    rejected = quality.judge(marked, id_col=row).where("not kept").select(row)
    return marked.join(rejected, row, "left_anti").select(docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose language cannot be told; one without a stated language gets the predicted one."""
    prefix = "found"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    found = langid.identify(docs, carry=True, prefix=prefix)
    told = found.where((F.col(f"{prefix}lang_pred") != langid.UNKNOWN) & (F.col(f"{prefix}score") >= LEAST_LANGUAGE_SCORE))
    return told.withColumn("lang", F.coalesce("lang", f"{prefix}lang_pred")).select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: the document with the least id of each group stays."""
    goes = neardup.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(goes, "doc_id", "left_anti").select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has go; a document left without words goes."""
    left = passages.strip_repeated_passages(docs)
    return left.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality-rules", quality_rules),
    ("language-id", language_id),
    ("near-duplicates", one_of_each_group),
    ("substring-dedup", substring_dedup),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each stage's rows are written and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.keep(docs, name)
    return docs
