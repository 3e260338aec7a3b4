"""The registered queries over the corpus tables, and the SQL of those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bytebpe, chat, gif, langid, lexical, neardup, oracle, packing, passages, quality, sharding, suffixes, trie, warc


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.encode_and_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "captured", "position")


def op5_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=40)


def op6_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("starts", "ends")


def op9_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.stored_features(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("starts", "ends")


def op11_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.with_control_strings(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return chat.format_and_read_back(turns, public_tokenizers.path("byte_bpe_50k.json"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    """The others' models, ids and hashes are beyond SQL; tests hold them against brute force."""
    return dict(oracle.QUERIES)
