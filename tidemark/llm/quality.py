"""Quality rules: text statistics, and perplexity under a modified Kneser-Ney model.

The model predicts each byte from the four before it (white space counts as a space). Spark
counts the n-grams of all different texts; continuation counts, discounts, context weights and
probabilities are aggregations and joins of those counts. The model is stored as sorted hash
arrays: packed n-grams, which are their own perfect hashes, with log-probabilities, and packed
contexts with backoff weights, range by range in files of the shared folder. It holds every
n-gram of the input. Neither the driver nor a broadcast carries it: a task asks for the
n-grams of some text at a time, file by file. Files are remembered up to a bound; where the
model is larger, more text is asked for together, so that a file is read once for each 48 MB.
"""

from __future__ import annotations

from collections import OrderedDict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textcore as tc
from tidemark.llm.shared import Scratch, join_spread, tidied

ORDER = 5
REMEMBERED_BYTES = 192 << 20  # of the model's arrays in a worker
GROUP_BYTES = 48 << 20  # of text that a worker scores together if the model is larger than that
LEAST_WORDS = 50
STEP = 1e-3  # bands are found on log-perplexities in steps of this
BELOW, ABOVE = 10.0, 6.0  # a band's ends, in robust standard deviations from the median
LEAST_SPREAD = 0.015
LEAST_TEXTS = 30  # of one language and length, for a band of their own

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[tc.IS_SPACE] = 32


def packed(chunk: tc.Chunk, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the chunk's texts, first byte highest, and where each text's begin."""
    n = len(chunk.data) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(len(chunk.offsets), np.int64)
    data = _PLAIN[chunk.data].astype(np.int64)
    keys = data[:n].copy()
    for j in range(1, order):
        keys <<= 8
        keys |= data[j : j + n]
    inside = np.ones(n, bool)
    for end in chunk.offsets[1:-1].tolist():  # n-grams that run into the next text
        inside[max(0, end - order + 1) : end] = False
    upto = np.zeros(n + 1, np.int64)
    np.cumsum(inside, out=upto[1:])
    return keys[inside], upto[np.minimum(chunk.offsets, n)]


def _counts(order: int):
    def merged(parts):
        keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(where, np.concatenate([c for _, c in parts])).astype(np.int64)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for c in tc.chunks(batch.column(0)):
                held.append(np.unique(packed(c, order)[0], return_counts=True))
                size += len(held[-1][0])
                if size > 2_000_000:
                    held = [merged(held)]
                    size = len(held[0][0])
                    if size > 1_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1])], ["key", "n"])
                        held, size = [], 0
        if held:
            keys, n = merged(held)
            for lo in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[lo : lo + 100_000]), pa.array(n[lo : lo + 100_000])], ["key", "n"])

    return run


class SortedArrays(NamedTuple):
    """Sorted keys and their values in files, none overlapping: path, first and last key of each, and how many entries all have."""

    files: list[tuple[str, int, int]]
    entries: int

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the sorted ``keys`` are there, and the values of those."""
        found, values = np.zeros(len(keys), bool), np.zeros(len(keys))
        for path, first, last in self.files:
            lo, hi = np.searchsorted(keys, first), np.searchsorted(keys, last, side="right")
            if lo < hi:
                own, logs = _arrays(path)
                at = np.minimum(np.searchsorted(own, keys[lo:hi]), len(own) - 1)
                found[lo:hi] = own[at] == keys[lo:hi]
                values[lo:hi] = logs[at]
        return found, values


_READ: OrderedDict[str, tuple[np.ndarray, np.ndarray]] = OrderedDict()  # a worker's arrays, the latest used last


def _arrays(path: str) -> tuple[np.ndarray, np.ndarray]:
    if path in _READ:
        _READ.move_to_end(path)
        return _READ[path]
    store, where = fs.FileSystem.from_uri(path)
    t = pq.read_table(where, filesystem=store, partitioning=None)
    pair = t.column(0).to_numpy(), t.column(1).to_numpy()
    _READ[path] = pair
    while len(_READ) > 1 and sum(k.nbytes + v.nbytes for k, v in _READ.values()) > REMEMBERED_BYTES:
        _READ.popitem(last=False)
    return pair


class Model(NamedTuple):
    """For each order from 1, n-grams with log-probabilities and contexts with log backoff weights."""

    orders: list[tuple[SortedArrays, SortedArrays]]
    unknown: float

    @property
    def nbytes(self) -> int:
        return 16 * sum(arrays.entries for pair in self.orders for arrays in pair)

    def log_probabilities(self, keys: np.ndarray, order: int | None = None) -> np.ndarray:
        """Natural logarithms for packed n-grams of the given order."""
        order = len(self.orders) if order is None else order
        if order == 0:
            return np.full(len(keys), self.unknown)
        kinds, where = np.unique(keys, return_inverse=True)
        grams, contexts = self.orders[order - 1]
        found, logs = grams.lookup(kinds)
        rest = np.flatnonzero(~found)
        if len(rest):
            known, weights = contexts.lookup(kinds[rest] >> 8)  # shifted, they are sorted still
            logs[rest] = np.where(known, weights, 0.0) + self.log_probabilities(kinds[rest] & ((1 << 8 * (order - 1)) - 1), order - 1)
        return logs[where]


def _stored(df: DataFrame, key: str, value: str, scratch: Scratch, name: str) -> tuple[DataFrame, SortedArrays]:
    table = scratch.keep(df.select(key, value).repartitionByRange(key).sortWithinPartitions(key), name)
    files = table.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("n")).collect()
    return table, SortedArrays(sorted(((r.path, r.first, r.last) for r in files), key=lambda f: f[1]), sum(r.n for r in files))


def kneser_ney(texts: DataFrame, scratch: Scratch, order: int = ORDER) -> Model:
    """Count the n-grams of a text column over all rows, and store the model of them."""
    counts = scratch.keep(texts.mapInArrow(tidied(_counts(order)), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), f"grams{order}")
    tables: list[DataFrame] = [counts]
    for n in range(order - 1, 0, -1):  # continuation counts: in how many different n-grams one byte longer
        counts = scratch.keep(counts.groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * n) - 1)).alias("key")).agg(F.count("*").alias("n")), f"grams{n}")
        tables.insert(0, counts)
    orders: list[tuple[SortedArrays, SortedArrays]] = []
    lower: DataFrame | None = None
    for n, table in enumerate(tables, 1):
        n1, n2, n3, n4 = table.agg(*(F.count_if(F.col("n") == k) for k in (1, 2, 3, 4))).collect()[0]
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        d1, d2, d3 = (min(max(k - (k + 1) * y * b / a, 0.05), k * 0.95) if a else 0.5 * k for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))
        discount = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        ctx = F.shiftrightunsigned("key", 8) if n > 1 else F.lit(0).cast("long")
        rows = table.select("key", "n", ctx.alias("ctx"), discount.alias("d"))
        contexts = rows.groupBy("ctx").agg(F.sum("n").alias("total"), F.sum("d").alias("given"))
        contexts = contexts.select("ctx", "total", (F.col("given") / F.col("total")).alias("weight"))
        shares = rows.join(contexts, "ctx").select("key", ((F.col("n") - F.col("d")) / F.col("total")).alias("share"), "weight")
        if lower is None:
            p = shares.select("key", F.col("share") + F.col("weight") / 256)
        else:
            below = lower.select(F.col("key").alias("tail"), F.exp("log_p").alias("p"))
            p = shares.withColumn("tail", F.col("key").bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1))).join(below, "tail").select("key", F.col("share") + F.col("weight") * F.col("p"))
        lower, grams = _stored(p.toDF("key", "p").select("key", F.log("p").alias("log_p")), "key", "log_p", scratch, f"model{n}")
        orders.append((grams, _stored(contexts.select("ctx", F.log("weight").alias("log_w")), "ctx", "log_w", scratch, f"contexts{n}")[1]))
    return Model(orders, float(np.log(1 / 256)))


def _groups(batches, most: int):
    """Batches with a share of their chunks, together ``most`` bytes of text or one chunk more: lists of (batch, chunk)."""
    held, size = [], 0
    for batch in batches:
        for c in tc.chunks(batch.column(3)):
            held.append((batch, c))
            size += len(c.data)
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


def _looked_up(group, model: Model, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of a group's texts, sorted, and their log-probabilities: each file of the model is opened once for all of them."""
    kinds = np.zeros(0, np.int64)
    for _, c in group:
        kinds = np.union1d(kinds, packed(c, order)[0])
    return kinds, model.log_probabilities(kinds, order)


def _scores(model: Model, order: int):
    """Statistics and mean negative log-probability of (row_id, lang, hash, text).

    A model that fits a worker's memory is asked chunk by chunk. A larger one is asked once
    for a group of chunks, as every group walks all of its files.
    """
    most = GROUP_BYTES if model.nbytes > REMEMBERED_BYTES else 0

    def run(batches):
        for group in _groups(batches, most):
            kinds, logs = _looked_up(group, model, order) if most else (None, None)
            for batch, c in group:
                ids, langs, marks, _ = batch.columns
                w = tc.words(c)
                names = tc.word_names(c, w)
                ends = np.zeros(len(c.data) + 1, np.int64)
                inside = ~tc.IS_SPACE[c.data]
                np.cumsum(inside & ((c.data & 0xC0) != 0x80), out=ends[1:])
                chars = np.diff(ends[c.offsets])
                np.cumsum(_SYMBOL[c.data], out=ends[1:])
                symbols = np.diff(ends[c.offsets])
                keys, first = packed(c, order)
                sums = np.zeros(len(keys) + 1)
                np.cumsum(model.log_probabilities(keys) if kinds is None else logs[np.searchsorted(kinds, keys)], out=sums[1:])
                grams = np.diff(first)
                with np.errstate(invalid="ignore", divide="ignore"):
                    nats = np.where(grams > 0, -np.diff(sums[first]) / grams, np.nan)
                lines, repeats = [], []
                for k in range(c.hi - c.lo):
                    raw = c.data[c.offsets[k] : c.offsets[k + 1]].tobytes()
                    filled = [x for x in raw.split(b"\n") if x and not x.isspace()]
                    lines.append(len(filled) - len(set(filled)))
                    repeats.append(repeated_words(names.at(slice(w.first[k], w.first[k + 1]))))
                n = c.hi - c.lo
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(c.lo, n), langs.slice(c.lo, n), marks.slice(c.lo, n), pa.array(np.diff(w.first)), pa.array(chars), pa.array(symbols), pa.array(lines, pa.int64()), pa.array(repeats, pa.int64()), pa.array(nats, from_pandas=True)],
                    ["row_id", "lang", "hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "nats"],
                )

    return run


def repeated_words(names: tc.Names, size: int = 3) -> int:
    """Words that lie in ``size``-word windows found twice or more."""
    grams = tc.windows(names, size)
    if len(grams.a) < 2:
        return 0
    order = np.argsort(grams.a, kind="stable")
    a, b = grams.at(order)
    same = a[1:] == a[:-1]
    if (same & (b[1:] != b[:-1])).any():  # one lane agrees by chance
        order = np.lexsort((grams.b, grams.a))
        a, b = grams.at(order)
        same = a[1:] == a[:-1]
    same &= b[1:] == b[:-1]
    starts = np.concatenate([order[1:][same], order[:-1][same]])
    covered = np.zeros(len(names.a), bool)
    for j in range(size):
        covered[starts + j] = True
    return int(covered.sum())


def bands(scored: DataFrame, keys: list[str], below: float = BELOW, above: float = ABOVE) -> DataFrame:
    """keys, texts, lower, upper: around the median log-perplexity of the different texts that agree in ``keys``."""
    once = scored.where("nats is not null and not base_failed").groupBy(*keys, "hash").agg(F.min("nats").alias("nats"))
    bins = once.groupBy(*keys, F.round(F.col("nats") / STEP).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    q = bins.groupBy(*keys).agg(F.percentile("bin", [0.25, 0.5, 0.75], F.col("n")).alias("q"), F.sum("n").alias("texts"))
    spread = F.greatest((F.col("q")[2] - F.col("q")[0]) * STEP / 1.349, F.lit(LEAST_SPREAD))
    middle = F.col("q")[1] * STEP
    return q.select(*keys, "texts", (middle - below * spread).alias("lower"), (middle + above * spread).alias("upper"))


def with_bands(scored: DataFrame, below: float, above: float) -> DataFrame:
    """Add lower and upper: of the language's texts of like length, or of all its texts where those are few.

    Short texts scatter more, so each doubling of the number of words has a band of its own.
    """
    scored = scored.withColumn("length", F.floor(F.log2(F.greatest("n_words", F.lit(1)))))
    near = bands(scored, ["lang", "length"], below, above).where(F.col("texts") >= LEAST_TEXTS).drop("texts").withColumnsRenamed({"lower": "near_lower", "upper": "near_upper"})
    sizes = scored.groupBy("lang", "length").agg(F.count("*").alias("rows"))
    table = sizes.join(near, ["lang", "length"], "left").join(bands(scored, ["lang"], below, above), "lang", "left")
    return join_spread(scored, table.select("lang", "length", "rows", *(F.coalesce(f"near_{c}", c).alias(c) for c in ("lower", "upper"))), ["lang", "length"], "rows")


def language_key(lang: Column) -> Column:
    """A language as text that is never null; no language is another than the null one."""
    return F.when(lang.isNull(), "").otherwise(F.concat(F.lit("="), lang.cast("string")))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", below: float = BELOW, above: float = ABOVE) -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, nats for every row of ``docs``.

    base_failed: under 50 words, or over half of them in repeated 3-word windows. Of the
    others, those are kept whose log-perplexity (nats per byte) lies in the band of their
    language and length; a null language is a language of its own. Bands and model count each
    different text once, however many rows copy it. A text too short for an n-gram has
    no perplexity and fails by its words. Null texts have no words. Rows are judged one by
    one, so repeated rows and ids get equal verdicts. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("row_id"), language_key(F.col(lang_col)).alias("lang"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"), F.col(text_col).alias("text"))
    different = rows.dropDuplicates(["hash"]).select("text")
    model = kneser_ney(different, scratch)
    kind = dict(docs.dtypes)[id_col]
    scored = rows.mapInArrow(tidied(_scores(model, ORDER)), f"row_id {kind}, lang string, hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, nats double")
    scored = scratch.keep(scored.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))), "scored")
    held = with_bands(scored, below, above)
    good = F.coalesce(F.col("nats").between(F.col("lower"), F.col("upper")), F.lit(True))
    return held.select(F.col("row_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & good).alias("kept"), "nats")
