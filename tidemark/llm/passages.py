"""Removal of passages that an earlier document already has, by windows of doubled length.

Level by level: of all windows, those live on whose grams of a quarter of the length repeat
in another document; of these, those whose grams of half the length do; of these, at last,
those that repeat themselves. Where none is left the work ends. Of the grams inside a window
one is tried at each level, its anchor (see ``repeats``): windows that repeat have the same,
so none is lost, and a level counts a few hundredths of all grams. The level of half the
length also settles runs of windows that agree over all they cover; the last takes the
others one by one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import repeats
from tidemark.llm import textcore as tc
from tidemark.llm.shared import Scratch, free_name, join_spread


def kept_words(text: bytes, lo: np.ndarray, hi: np.ndarray) -> list[bytes]:
    """Words of a text outside the half-open, disjoint and sorted word spans."""
    words, out, at = text.split(), [], 0
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        out += words[at:a]
        at = b
    return out + words[at:]


def _spans(column: pa.Array, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    flat = column.slice(k, 1).flatten()
    return repeats.covered(flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy().astype(np.int64) + window)


def _kept_text(data: bytes, lo: np.ndarray, hi: np.ndarray) -> str:
    """A text without the words of the spans and the white space after each of them."""
    starts = tc.words(tc.Chunk(0, 1, np.frombuffer(data, np.uint8), np.array([0, len(data)]))).starts
    starts = np.append(starts, len(data))
    out, at = [], 0
    for a, b in zip(starts[lo].tolist(), starts[hi].tolist(), strict=True):
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]]).decode()


def _cut_words(window: int):
    def run(batches):
        for batch in batches:
            n, shas, kept, starts, ends = [], [], [], [], []
            for k, text in enumerate(batch.column(2)):
                data = text.as_py().encode()
                lo, hi = _spans(batch.column(3), k, window)
                n.append(int((hi - lo).sum()))
                shas.append(hashlib.sha256(b" ".join(kept_words(data, lo, hi))).hexdigest())
                kept.append(_kept_text(data, lo, hi))
                starts.append(lo)
                ends.append(hi)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.array(kept, pa.string()), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], ["doc", "mark", "n_removed", "kept_sha256", "kept_text", "starts", "ends"]
            )

    return run


def _whole(batches):
    for batch in batches:
        n, shas = [], []
        for text in batch.column(3):
            parts = (text.as_py() or "").encode().split()
            n.append(len(parts))
            shas.append(hashlib.sha256(b" ".join(parts)).hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(shas, pa.string())], ["row_id", "doc", "mark", "n_words", "whole_sha256"])


def _grams(window: int, length: int):
    """Anchors of (doc, mark, text): their grams of ``length`` words and the windows that own them."""

    def run(batches):
        for batch in batches:
            docs, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for part in repeats.word_parts(length)(batch.column(2)):
                runs = repeats.runs_of(part, window, length)
                row, begin = runs.text + part.lo, part.offsets[:-1][runs.text]
                cols = [pa.array(tc.signed(part.grams.a[runs.at])), pa.array(docs[row]), pa.array(marks[row]), pa.array((runs.lo - begin).astype(np.int32)), pa.array((runs.hi - begin).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, ["gram", "doc", "mark", "lo", "hi"])

    return run


def repeated_windows(texts: DataFrame, window: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(doc, mark, text) of what may have repeats, and (doc, mark, spans) of windows that an earlier doc has: structs (lo, hi) of first words.

    ``texts``: doc, mark (a hash of the text), text.
    """
    quarter, half = max(1, window // 4), max(1, window // 2)
    # level one: grams that two documents share
    grams = scratch.keep(texts.mapInArrow(_grams(window, quarter), "gram long, doc long, mark long, lo int, hi int"), "quarter")
    shared = grams.groupBy("gram").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count("*").alias("n")).where("least < most")
    shared = scratch.keep(shared.select("gram", "n", F.lit(True).alias("shared")), "shared")
    alive = join_spread(grams, shared, ["gram"], "n").where("shared").groupBy("doc", "mark").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("alive"))
    touched = scratch.keep(texts.join(alive, ["doc", "mark"]).select("doc", "mark", "text", "alive").dropDuplicates(["doc", "mark"]), "texts")
    # level two: grams twice as long, at the windows that are left
    parts = repeats.word_parts(half)
    found = scratch.keep(repeats.settled(touched.mapInArrow(repeats.run_rows(parts, window, half, True), repeats.ROWS), True), "half")
    spans = found.where(F.col("kind") == repeats.RESOLVED)
    # level three: whole windows
    left = found.where(F.col("kind") == repeats.OPEN)
    if not left.isEmpty():
        ranges = left.groupBy("doc", "mark").agg(F.sort_array(F.collect_set(F.struct("lo", "hi", "at"))).alias("open"))
        asked = touched.drop("alive").join(ranges, ["doc", "mark"]).select("doc", "mark", "text", "open")
        found = scratch.keep(repeats.settled(asked.mapInArrow(repeats.piece_rows(parts, window, half, 1, True), repeats.ROWS), True), "whole")
        spans = spans.unionByName(found.where(F.col("kind") == repeats.RESOLVED))
    return touched.select("doc", "mark", "text"), spans.groupBy("doc", "mark").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def _cuts(docs: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """doc, mark, n_removed, kept_sha256, kept_text, starts, ends of the texts that lose words."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), _mark(text_col).alias("mark"), F.col(text_col).alias("text"))
    touched, spans = repeated_windows(rows.where("doc is not null and text is not null"), window, scratch)
    schema = "doc long, mark long, n_removed long, kept_sha256 string, kept_text string, starts array<int>, ends array<int>"
    return touched.join(spans, ["doc", "mark"]).select("doc", "mark", "text", "spans").mapInArrow(_cut_words(window), schema)


def _mark(text_col: str) -> Column:
    return F.xxhash64(text_col)


def strip_repeated_passages(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the passages that ``remove_repeated_passages`` reports, and without documents that lose every word.

    Texts that lose nothing stay as they are; in others the words go with the white space
    after them. All columns stay, whatever their names.
    """
    doc, mark, kept = (free_name(docs, c) for c in ("doc", "mark", "kept"))
    cut = _cuts(docs, window, id_col, text_col).select(F.col("doc").alias(doc), F.col("mark").alias(mark), F.col("kept_text").alias(kept))
    out = docs.withColumns({doc: F.col(id_col).cast("long"), mark: _mark(text_col)}).join(cut, [doc, mark], "left")
    return out.where(F.col(kept).isNull() | F.col(kept).rlike(r"[^\x20\x09-\x0D]")).withColumn(text_col, F.coalesce(kept, text_col)).select(docs.columns)


def remove_repeated_passages(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_removed, kept_sha256, starts, ends for every row of ``docs``.

    Every word is removed that lies in a window of ``window`` words whose word sequence also
    starts in a text with a smaller id; windows are judged on the input. starts and ends are
    the removed runs, in words; kept_sha256 is of the kept words, joined by one space. Null
    texts have no words. Ids are numbers, and read as long integers. A row without an id
    neither removes words of others nor loses any; rows that share an id never do so to each
    other. Other columns are ignored.
    """
    cut = _cuts(docs, window, id_col, text_col).drop("kept_text")
    rows = docs.select(F.col(id_col).alias("row_id"), F.col(id_col).cast("long").alias("doc"), _mark(text_col).alias("mark"), F.col(text_col).alias("text"))
    whole = rows.mapInArrow(_whole, f"row_id {dict(docs.dtypes)[id_col]}, doc long, mark long, n_words long, whole_sha256 string")
    return whole.join(cut, ["doc", "mark"], "left").select(
        F.col("row_id").alias(id_col),
        "n_words",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"),
        F.coalesce("starts", F.array().cast("array<int>")).alias("starts"),
        F.coalesce("ends", F.array().cast("array<int>")).alias("ends"),
    )
