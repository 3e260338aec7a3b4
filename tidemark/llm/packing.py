"""Packing along a Hilbert curve.

Documents are tokenized; a hashed vector of each document's tokens is projected to three
dimensions, and the cell it falls in numbered along a Hilbert curve. Range-sorted by that
number, similar documents lie near each other. The tokens of all documents, in that order,
are one line that is cut every 4096: documents are cut freely and only the last sequence is
padded. Positions along the line are sums over range partitions, so no task sees it all.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.shared import Scratch

SEQUENCE = 4096
END_ID = 2
DIMENSIONS, BITS = 3, 10
HASHED = 64
REMEMBERED = 300_000  # words and pieces whose ids a worker remembers

#: Characters that lower-casing and NFC treat one by one: of ASCII, Latin-1 and Latin Extended-A.
_COMMON = re.compile("[!-~\u00a1-\u012f\u0132-\u017f]+")


def _visible_bytes() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(others)) for b in range(256)}


class _Pieces(dict):
    """Ids of pieces that the tokenizer's pattern has cut."""

    def __init__(self, merge):
        self.merge, self.visible = merge, _visible_bytes()

    def __missing__(self, piece: str) -> bytes:
        shown = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.visible)
        data = array("H", [t.id for t in self.merge(shown)]).tobytes()
        if len(self) < REMEMBERED:
            self[piece] = data
        return data


class WordIds(dict):
    """Ids of words by their bytes, as the tokenizer gives them, as unsigned 16-bit integers.

    The tokenizer drops white space, so words are encoded one by one and remembered. Words
    of common characters go piece by piece to the tokenizer's own merges; others, and all of
    a tokenizer that does more than lower-case and compose, go to the whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        self.whole = Tokenizer.from_file(path)
        if self.whole.get_vocab_size() > 1 << 16:
            raise ValueError("ids need 16 bits")
        spec = json.loads(self.whole.to_str())
        self.cut = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")).findall
        self.special = [t["content"] for t in spec["added_tokens"]]
        steps = spec["normalizer"] or {"type": "none"}
        self.plain = {n["type"] for n in steps.get("normalizers", [steps])} <= {"NFC", "Lowercase", "Replace"} and any(n["type"] == "Lowercase" for n in steps.get("normalizers", [steps]))
        self.pieces = _Pieces(self.whole.model.tokenize)

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if self.plain and _COMMON.fullmatch(text) and not ("<" in text and any(s in text for s in self.special)):
            low = text.lower()
            data = self.pieces[low] if low.isalpha() else b"".join(map(self.pieces.__getitem__, self.cut(low)))
        else:
            data = array("H", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self) < REMEMBERED and len(word) < 64:
            self[word] = data
        return data

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.encode().split()))


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions of points with integer coordinates of ``bits`` bits along a Hilbert curve.

    Level by level from the coarsest bit: the bits of a point name its orthant, in Gray-code
    order along the curve; each orthant reflects and exchanges axes for the levels below.
    """
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    for level in range(bits - 1, 0, -1):
        below = (1 << level) - 1
        for axis in range(n):
            set_ = (x[:, axis] >> level) & 1 == 1
            swap = np.where(set_, 0, (x[:, 0] ^ x[:, axis]) & below)
            x[:, 0] ^= np.where(set_, below, swap)
            x[:, axis] ^= swap if axis else 0
    for axis in range(1, n):
        x[:, axis] ^= x[:, axis - 1]
    flip = np.zeros(len(x), np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[:, n - 1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= flip[:, None]
    key = np.zeros(len(x), np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in range(n):
            key = key << 1 | (x[:, axis] >> level) & 1
    return key


class Curve:
    """Hilbert keys of token id arrays: hashed signed counts, normalised, projected, cut into cells."""

    def __init__(self, seed: int = 7, ids: int = 1 << 16):
        rng = np.random.default_rng(seed)
        self.bucket = rng.integers(0, HASHED, ids)
        self.sign = rng.choice([-1.0, 1.0], ids)
        self.axes = np.linalg.qr(rng.standard_normal((HASHED, DIMENSIONS)))[0]

    def cell(self, ids: np.ndarray) -> np.ndarray:
        v = np.bincount(self.bucket[ids], self.sign[ids], HASHED)
        v = np.sign(v) * np.sqrt(np.abs(v))
        at = v @ self.axes / max(float(np.sqrt(v @ v)), 1e-9)
        return np.clip((at + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)


_LOADED: dict[str, WordIds] = {}


def _tokens(path: str):
    def run(batches):
        if path not in _LOADED:
            _LOADED[path] = WordIds(path)
        words, curve = _LOADED[path], Curve()
        end = np.array([END_ID], np.uint16).tobytes()
        for batch in batches:
            ids, cells = [], []
            for text in batch.column(1):
                data = words.encode(text.as_py() or "")
                cells.append(curve.cell(np.frombuffer(data, np.uint16)))
                ids.append(data + end)
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(hilbert_keys(np.array(cells), BITS)), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["row_id", "curve", "n", "ids"]
                )

    return run


def _pieces(sequence: int):
    def run(batches):
        for batch in batches:
            out = []
            for doc, curve, n, first, data in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                ids = np.frombuffer(data, np.uint16).astype("<u4").tobytes()
                at = 0
                while at < n:
                    place, offset = divmod(first + at, sequence)
                    length = min(n - at, sequence - offset)
                    out.append((doc, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), n, place, offset, curve))
                    at += length
            cols = list(zip(*out, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), *(pa.array(c, pa.int64()) for c in cols[1:])], ["row_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "curve"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, start, length, ids_crc32, doc_tokens, sequence_id, offset, curve: a row for each piece of each row of ``docs``.

    A document's ids are those of its text (null: none) and the end id. Every row is packed,
    repeated rows and ids as well. Ties along the curve go by id. All sequences but the last
    are full, so padding is under one sequence in all. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("text"))
    tokens = scratch.keep(rows.mapInArrow(_tokens(tokenizer_path), f"row_id {kind}, curve long, n long, ids binary").withColumn("uid", F.monotonically_increasing_id()), "tokens")
    order = ["curve", "row_id", "uid"]
    ranged = scratch.keep(tokens.select(*order, "n").repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    parts = ranged.groupBy("part").agg(F.sum("n").alias("total"))
    before = parts.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = ranged.withColumn("within", within).join(before, "part").select("uid", (F.col("before") + F.col("within")).alias("first"))
    first = first.hint("merge")  # positions grow with the corpus, so they are never broadcast
    placed = tokens.join(first, "uid").select("row_id", "curve", "n", "first", "ids")
    out = placed.mapInArrow(_pieces(sequence), f"row_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, curve long")
    return out.withColumnRenamed("row_id", id_col)
