"""Language identification: known words first, shorter and shorter n-grams for the others.

The classifier is fitted on a sample of the labelled texts: ``MOST_TEXTS`` of them (expected),
an equal share for each language, or all of a language that has fewer. Every language is
learned. Spark counts the sample's words by language and, of the same words, their character
n-grams; the model keeps all of these, so its size is bounded by the sample and by nothing
else. A known word scores by its log frequency in each language, or by one floor for all
languages where it was never seen; an unknown one by the mean over its known n-grams of the
longest order that has any. Texts are scored whole, a slice of their words at a time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import Scratch, tidied

MOST_TEXTS = 10_000  # labelled texts that the classifier is fitted on
MOST_BYTES = 64 << 20  # of their texts
SLICE = 20_000  # words that are scored at once
LONGEST = 4
FLUSH = 400_000
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
_ALPHA = 0.5


def letters(text: str) -> Iterator[str]:
    """Lower-cased runs of letters; none if no character is alphabetic."""
    if any(map(str.isalpha, text)):
        yield from (m[0] for m in _LETTERS.finditer(text.lower()))


def grams(word: str, n: int) -> list[str]:
    marked = f" {word} "
    return [marked[k : k + n] for k in range(len(marked) - n + 1)]


def _counted(batches):
    """(lang, order, item, n) of (lang, text); order 0: words."""
    words: dict[str, Counter] = {}
    texts: Counter = Counter()

    def rows():
        langs, orders, items, counts = [], [], [], []

        def add(lang, order, counter):
            langs.extend([lang] * len(counter))
            orders.extend([order] * len(counter))
            items.extend(counter)
            counts.extend(counter.values())

        for lang, counter in words.items():
            add(lang, 0, counter)
            for n in range(1, LONGEST + 1):
                c: Counter = Counter()
                for word, k in counter.items():
                    for g in grams(word, n):
                        c[g] += k
                add(lang, n, c)
        for lang, k in texts.items():
            add(lang, -1, {"": k})
        for lo in range(0, len(langs), 50_000):
            s = slice(lo, lo + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(langs[s], pa.string()), pa.array(orders[s], pa.int32()), pa.array(items[s], pa.string()), pa.array(counts[s], pa.int64())], ["lang", "order", "item", "n"])

    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            lang = lang.as_py()
            c = words.setdefault(lang, Counter())
            size -= len(c)
            c.update(letters(text.as_py()))
            size += len(c)
            texts[lang] += 1
            if size > FLUSH:
                yield from rows()
                words, size = {}, 0
                texts.clear()
    yield from rows()


class Model(NamedTuple):
    """Languages in order; words and n-grams by order, each to a row.

    Row k has entries first[k] to first[k + 1]: the languages that have the item, and by how
    much its log-probability lies above the floor of its order.
    """

    langs: list[str]
    items: list[dict[str, int]]
    first: np.ndarray
    of: np.ndarray
    gains: np.ndarray


def sampled(rows: DataFrame, most: int, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(lang, text) of about ``most`` rows of (lang, text, draw) and about ``most_bytes`` of text, equally much of each language as far as there is.

    One row of each language, that with the least draw, is taken for certain, so where there
    are more languages than ``most`` the sample has a row of each. Rows with equal draws go together.
    """
    have = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.min("draw").alias("first")).collect()
    share = {r.lang: 1.0 for r in have}
    for bound, size in ((most, "n"), (most_bytes, "bytes")):
        room = bound
        for k, r in enumerate(sorted(have, key=lambda r: (r[size], r.lang))):
            fair = max(0.0, room / (len(have) - k))
            certain = 1 if size == "n" else 0
            share[r.lang] = min(share[r.lang], max(0.0, fair - certain) / max(1, r[size] - certain))
            room -= min(r[size], fair)
    table = rows.sparkSession.createDataFrame([(r.lang, share[r.lang], r.first) for r in have], "lang string, share double, first long")
    drawn = F.shiftrightunsigned("draw", 11) * F.lit(2.0**-53)
    return rows.join(F.broadcast(table), "lang").where((drawn < F.col("share")) | (F.col("draw") == F.col("first"))).select("lang", "text")


def train(rows: DataFrame, scratch: Scratch) -> Model:
    """A model of (lang, text); both non-null. It holds all words and n-grams of the rows."""
    counts = scratch.keep(rows.mapInArrow(tidied(_counted), "lang string, order int, item string, n long").groupBy("lang", "order", "item").agg(F.sum("n").alias("n")), "counts").toArrow()
    orders_of, n = counts.column("order").to_numpy(), counts.column("n").to_numpy()
    langs = sorted(counts.filter(pa.array(orders_of == -1)).column("lang").to_pylist())
    items: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
    if not langs:
        return Model(langs, items, np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0))
    counts = counts.filter(pa.array(orders_of >= 0))
    n, orders_of = n[orders_of >= 0], orders_of[orders_of >= 0]
    lang_at = {lang: k for k, lang in enumerate(langs)}
    langs_of = np.array([lang_at[lang] for lang in counts.column("lang").to_pylist()], np.int64)
    places, row = np.zeros(len(n), np.int64), 0
    for k, (order, item) in enumerate(zip(orders_of.tolist(), counts.column("item").to_pylist(), strict=True)):
        at = items[order].setdefault(item, row)
        row += at == row
        places[k] = at
    total, kinds = np.zeros((LONGEST + 1, len(langs))), np.zeros((LONGEST + 1, len(langs)))
    np.add.at(total, (orders_of, langs_of), n)
    np.add.at(kinds, (orders_of, langs_of), 1)
    mass = total + _ALPHA * (kinds + 1)
    gains = np.log((n + _ALPHA) / mass[orders_of, langs_of]) - np.log(_ALPHA / mass.max(axis=1))[orders_of]  # the floor: unseen in the largest
    by_row = np.lexsort((langs_of, places))
    first = np.zeros(row + 1, np.int64)
    np.cumsum(np.bincount(places, minlength=row), out=first[1:])
    return Model(langs, items, first, langs_of[by_row], gains[by_row])


class Scorer:
    """Predicts with a model. Nothing is kept between texts, so memory is that of the model."""

    def __init__(self, model: Model):
        self.model = model
        self.word = model.items[0].get

    def backoff(self, word: str) -> list[int]:
        """Rows of an unknown word's n-grams of the longest order that has any."""
        for n in range(LONGEST, 0, -1):
            find = self.model.items[n].get
            if known := [at for g in grams(word, n) if (at := find(g)) is not None]:
                return known
        return []

    def gained(self, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """By language, the weighted gains of the rows."""
        lo = self.model.first[rows]
        sizes = self.model.first[rows + 1] - lo
        at = np.arange(sizes.sum()) + np.repeat(lo - np.cumsum(sizes) + sizes, sizes)
        return np.bincount(self.model.of[at], np.repeat(weights, sizes) * self.model.gains[at], len(self.model.langs))

    def evidence(self, words: list[str]) -> np.ndarray:
        """By language, the sum of the words' gains."""
        found = list(map(self.word, words))
        rows = [at for at in found if at is not None]
        weights = np.ones(len(rows))
        if len(rows) < len(words):
            unseen = [known for word, at in zip(words, found) if at is None and (known := self.backoff(word))]
            sizes = np.array([len(known) for known in unseen])
            weights = np.concatenate([weights, np.repeat(1 / sizes, sizes)]) if unseen else weights
            for known in unseen:
                rows += known
        return self.gained(np.array(rows, np.int64), weights)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The best language and its share of the evidence per word (of equal ones the first by name)."""
        words, n, sums = letters(text or ""), 0, np.zeros(len(self.model.langs))
        while part := list(islice(words, SLICE)):
            n += len(part)
            sums += self.evidence(part)
        if not n or not self.model.langs:
            return UNKNOWN, 0.0
        sums /= n  # above the floor, which is the same for all
        best = int(sums.argmax())
        return self.model.langs[best], float(1 / np.exp(sums - sums[best]).sum())


def _predicted(model):
    """Adds lang_pred and score to batches whose first column is the text, which goes."""

    def run(batches):
        scorer = Scorer(model.value)
        for batch in batches:
            found = [scorer.predict(text.as_py()) for text in batch.column(0)]
            added = [pa.array([lang for lang, _ in found], pa.string()), pa.array([score for _, score in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *added], [*batch.schema.names[1:], "lang_pred", "score"])

    return run


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: bool = False, prefix: str = "", most_texts: int = MOST_TEXTS) -> DataFrame:
    """id, held_out, lang_pred, score for every row of ``docs``; with ``carry`` all its columns come along,
    and ``prefix`` keeps the added names apart from them.

    The model learns from rows that are not held out (crc32 of the id as text, modulo 3, is
    1) and have a text and a language, or from a sample of about ``most_texts`` of them, and of
    MOST_BYTES, where there are more; each language has at least one text in it; rows without an id are not held out. The prediction uses the text alone. lang_pred is a learned language, or 'und' with score 0 for a null
    text, one without a letter, or if nothing could be learned. score is the best language's
    share, 1 / languages to 1. Very long texts are scored in slices. Repeated rows get equal predictions. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    learn = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), is_held_out(F.col(id_col)).alias("held_out"), F.xxhash64(id_col, text_col).alias("draw"))
    learn = learn.where("not held_out and text is not null and lang is not null").select("lang", "text", "draw")
    model = docs.sparkSession.sparkContext.broadcast(train(sampled(learn, most_texts), scratch))
    kept = docs.columns if carry else [id_col]
    marks = [F.col(c).alias(f"c{k}") for k, c in enumerate(kept)]
    rows = docs.select(F.col(text_col).alias("text"), *marks, is_held_out(F.col(id_col)).alias("held_out"))
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"c{k} {kinds[c]}" for k, c in enumerate(kept)), "held_out boolean, lang_pred string, score double"])
    out = rows.mapInArrow(tidied(_predicted(model)), schema)
    return out.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(kept)), *(F.col(c).alias(prefix + c) for c in ("held_out", "lang_pred", "score")))
