"""Removal of long repeated byte strings, by buckets of suffixes that are told apart round by round.

Suffixes at anchors (see ``repeats``), one in seventy, are put into buckets by the name of the
64 bytes there. A bucket's suffixes are told apart by a name of all that their windows cover,
made from the names at later offsets; those alone drop out, those that agree throughout are
settled, and the rest goes on in pieces of a few windows, then window by window.

This is bucket refinement by names, not by bucket pointers: a name is a hash of the text, and
no suffix is given the number of its bucket to be sorted by in a later round. Numbers would
have to be carried back to the order of the text and be shuffled again in every round; the
README has the figures for which they were left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tidemark.llm import repeats
from tidemark.llm.shared import Scratch

GRAM = 64  # bytes of the first buckets
PIECE = 10  # windows that the second round settles at once


def _cut_bytes(length: int):
    def run(batches):
        for batch in batches:
            out = []
            texts, spans = batch.column(2).to_pylist(), batch.column(3)
            for k, text in enumerate(texts):
                data = text.encode()
                flat = spans.slice(k, 1).flatten()
                lo, hi = repeats.covered(flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy().astype(np.int64) + length)
                digest, at = hashlib.sha256(), 0
                for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                    digest.update(data[at:a])
                    at = b
                digest.update(data[at:])
                out.append((int((hi - lo).sum()), len(lo), digest.hexdigest(), lo.tolist(), hi.tolist()))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(columns[j], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))))], ["doc", "mark", "n_removed", "n_spans", "kept_sha256", "starts", "ends"]
            )

    return run


def repeated_windows(texts: DataFrame, length: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(doc, mark, text) of what may have repeats, and (doc, mark, spans) of repeated windows: structs (lo, hi) of first bytes.

    ``texts``: doc, mark (a hash of the text), text.
    """
    gram = max(1, min(GRAM, length // 2))
    parts = repeats.byte_parts(length, gram)
    found = scratch.keep(repeats.settled(texts.mapInArrow(repeats.run_rows(parts, length, gram, False), repeats.ROWS), False), "grams")
    of_text = found.groupBy("doc", "mark").agg(repeats.ranges(repeats.OPEN, "lo", "hi", "at").alias("open"))
    touched = scratch.keep(texts.join(of_text, ["doc", "mark"]).select("doc", "mark", "text", "open").dropDuplicates(["doc", "mark"]), "texts")
    spans, asked = found.where(F.col("kind") == repeats.RESOLVED), touched.where(F.size("open") > 0)
    for size in (PIECE, 1):
        rows = asked.mapInArrow(repeats.piece_rows(parts, length, gram, size, False), repeats.ROWS)
        found = scratch.keep(repeats.settled(rows, False), f"pieces{size}")
        spans = spans.unionByName(found.where(F.col("kind") == repeats.RESOLVED))
        left = found.where(F.col("kind") == repeats.OPEN)
        if size == 1 or left.isEmpty():
            break
        again = left.groupBy("doc", "mark").agg(F.sort_array(F.collect_set(F.struct("lo", "hi", "at"))).alias("open"))
        asked = touched.drop("open").join(again, ["doc", "mark"]).select("doc", "mark", "text", "open")
    return touched.select("doc", "mark", "text"), spans.groupBy("doc", "mark").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def remove_repeated_bytes(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256, starts, ends for every row of ``docs``.

    Every byte is removed that lies in a ``length``-byte string which also starts anywhere
    else in any text, the same one included; overlaps count, and strings are judged on the
    input. starts and ends are the removed runs, in bytes (empty where nothing is removed).
    Null texts are empty. Rows with equal id and text are copies of each other, so each
    loses what the other holds; ids may be null or of any type. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    whole_number = isinstance(docs.schema[id_col].dataType, IntegralType)
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(-1)) if whole_number else F.xxhash64(id_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("row_id"), doc.alias("doc"), text.alias("text")).withColumn("mark", F.xxhash64("text"))
    touched, spans = repeated_windows(rows.select("doc", "mark", "text"), length, scratch)
    cut = touched.join(spans, ["doc", "mark"]).select("doc", "mark", "text", "spans").mapInArrow(_cut_bytes(length), "doc long, mark long, n_removed long, n_spans long, kept_sha256 string, starts array<int>, ends array<int>")
    whole = rows.select("row_id", "doc", "mark", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    return whole.join(cut, ["doc", "mark"], "left").select(
        F.col("row_id").alias(id_col),
        "n_bytes",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"),
        F.coalesce("starts", F.array().cast("array<int>")).alias("starts"),
        F.coalesce("ends", F.array().cast("array<int>")).alias("ends"),
    )
