"""Ranked lexical search by branch and bound over hierarchical max trees.

Documents are indexed in segments, ranges of consecutive rows that one task reads. A segment
holds, for each term, its postings and a tree of greatest contributions over ranges of
documents: blocks of 64, of 512, and so on up to the whole segment. A query descends best
first: the range with the highest sum of its terms' maxima is opened next, until no range's
bound reaches the score of the tenth best; ranges whose bound equals it are opened too, unless
their least id comes after the tenth's. First each query searches the one segment with its
highest bound; the threshold found there prunes all other segments as a whole.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import Scratch, workers_can_import

BLOCK, FANOUT = 64, 8
SEGMENT_DOCS, SEGMENT_POSTINGS = 8192, 2_000_000  # a segment ends with either
QUERY_BYTES = 4 << 20  # of query texts in a block; a longer text is a block of its own
K1_SCALE, LENGTH_SHARE, SCALE = 1000, 75, 1_000_000_000
_LAST_ID = (1 << 63) - 1  # a null id comes after all others

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of characters beyond ASCII; A-Z in lower case."""
    return text.encode().translate(_TABLE).split() if text else []


class Query(NamedTuple):
    number: int
    item: object
    terms: list[tuple[int, int]]  # term number and how often


class Stats(NamedTuple):
    n_docs: int
    total: int
    weights: np.ndarray  # by term number


def _m(lengths: np.ndarray, stats: Stats) -> np.ndarray:
    if LENGTH_SHARE * int(lengths.max(initial=0)) * stats.n_docs < 1 << 63:
        grown = LENGTH_SHARE * lengths * stats.n_docs // stats.total
    else:
        grown = np.array([LENGTH_SHARE * n * stats.n_docs // stats.total for n in lengths.tolist()], np.int64)
    return 100 - LENGTH_SHARE + grown


def _segments(numbers: dict[bytes, int], limit: int, schema: pa.Schema):
    """Read documents, yield segments: ids and lengths, and the postings of the asked terms, ordered by term."""
    asked = numbers.keys()

    def row(number, ids, lengths, term, place, tf):
        order = np.lexsort((place, term))
        term = np.array(term, np.int32)[order]
        kinds, first = np.unique(term, return_index=True)
        ends = np.append(first[1:], len(term))
        values = [[number], [ids], [lengths], [kinds], [np.append(first, len(term))], [ends - first], [np.array(place, np.int32)[order]], [np.array(tf, np.int64)[order]]]
        return pa.RecordBatch.from_arrays([pa.array([v[0] if isinstance(v[0], int) else np.asarray(v[0])], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    def run(batches):
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 32
        ids, lengths, term, place, tf = [], [], [], [], []
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                words = terms_of(text.as_py())
                if not words:
                    ids.append(_LAST_ID if doc.as_py() is None else doc.as_py())
                    lengths.append(0)
                else:
                    counts = Counter(words)
                    for word in counts.keys() & asked:
                        term.append(numbers[word])
                        place.append(len(ids))
                        tf.append(counts[word])
                    ids.append(_LAST_ID if doc.as_py() is None else doc.as_py())
                    lengths.append(len(words))
                if len(ids) >= limit or len(term) >= SEGMENT_POSTINGS:
                    yield row(number, ids, lengths, term, place, tf)
                    number += 1
                    ids, lengths, term, place, tf = [], [], [], [], []
        if ids:
            yield row(number, ids, lengths, term, place, tf)

    return run


class Segment:
    """A segment's postings with their contributions, and the max tree of each of its terms."""

    def __init__(self, ids, lengths, kinds, first, place, tf, stats: Stats):
        self.ids, self.place = ids, place
        self.at = {int(t): k for k, t in enumerate(kinds)}
        which = np.repeat(np.arange(len(kinds)), np.diff(first))
        m = _m(lengths, stats)[place]
        self.value = stats.weights[kinds][which] * (SCALE * tf // (K1_SCALE * tf + 8 * m))
        n = -(-len(ids) // BLOCK)
        self.cuts = np.zeros((len(kinds), n + 1), np.int64)  # where each term's postings of a block begin
        np.add.at(self.cuts, (which, place // BLOCK + 1), 1)
        self.cuts = np.cumsum(self.cuts, axis=1) + np.asarray(first)[:-1, None]
        self.levels: list[np.ndarray] = []  # from the blocks up to the root: terms by ranges
        self.least: list[np.ndarray] = []  # least id of each range
        leaf = np.zeros((len(kinds), n), np.int64)
        np.maximum.at(leaf, (which, place // BLOCK), self.value)
        low = np.minimum.reduceat(ids, np.arange(0, len(ids), BLOCK))
        while True:
            self.levels.append(leaf)
            self.least.append(low)
            if n == 1:
                break
            cuts = np.arange(0, n, FANOUT)
            leaf, low = np.maximum.reduceat(leaf, cuts, axis=1), np.minimum.reduceat(low, cuts)
            n = len(cuts)

    def _own(self, query: Query) -> tuple[np.ndarray, np.ndarray]:
        own = [(self.at[t], times) for t, times in query.terms if t in self.at]
        return np.array([k for k, _ in own], np.int64), np.array([x for _, x in own], np.int64)

    def bound(self, query: Query) -> int:
        rows, times = self._own(query)
        return int(times @ self.levels[-1][rows, 0]) if len(rows) else 0

    def search(self, query: Query, k: int, floor: tuple[int, int] | None = None) -> list[tuple[int, int]]:
        """(score, id) of at most k documents that rank before ``floor`` (itself included) with a score above 0; best first."""
        rows, times = self._own(query)
        best: list[tuple[int, int]] = []  # a heap of (score, -id), the worst on top
        worst = (1, -_LAST_ID) if floor is None else max((1, -_LAST_ID), (floor[0], -floor[1]))
        if not len(rows):
            return []
        top = len(self.levels) - 1
        open_ = [(-int(times @ self.levels[top][rows, 0]), int(self.least[top][0]), top, 0)]
        while open_:
            bound, least, level, at = heapq.heappop(open_)
            if (-bound, -least) < worst:  # all others have no higher bound; of equal ones, the least id comes first
                break
            if level:
                lo, hi = at * FANOUT, min((at + 1) * FANOUT, self.levels[level - 1].shape[1])
                bounds = times @ self.levels[level - 1][rows, lo:hi]
                for j, (b, low) in enumerate(zip(bounds.tolist(), self.least[level - 1][lo:hi].tolist(), strict=True), lo):
                    if (b, -low) >= worst:
                        heapq.heappush(open_, (-b, low, level - 1, j))
                continue
            begin, end = at * BLOCK, min((at + 1) * BLOCK, len(self.ids))
            scores = np.zeros(end - begin, np.int64)
            lo = self.cuts[rows, at]
            size = self.cuts[rows, at + 1] - lo
            own = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
            np.add.at(scores, self.place[own] - begin, np.repeat(times, size) * self.value[own])
            for j in np.flatnonzero(scores >= worst[0]).tolist():
                found = (int(scores[j]), -int(self.ids[begin + j]))
                if len(best) < k:
                    if found >= worst:
                        heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)
            if len(best) == k:
                worst = max(worst, best[0])
        return [(score, -minus) for score, minus in sorted(best, reverse=True)]


def _read(batches, stats: Stats) -> Iterator[tuple[int, Segment]]:
    for batch in batches:
        for k in range(batch.num_rows):
            number = batch.column(0)[k].as_py()
            ids, lengths, kinds, first, place, tf = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in (1, 2, 3, 4, 6, 7))
            yield number, Segment(ids, lengths, kinds, first, place, tf, stats)


def _bounds(queries: list[Query], stats: Stats):
    """The segment with the highest bound of each query, of those that a task reads."""

    def run(batches):
        best: dict[int, tuple[int, int]] = {}
        for number, segment in _read(batches, stats):
            for q in queries:
                if b := segment.bound(q):
                    best[q.number] = max(best.get(q.number, (0, 0)), (b, -number))
        rows = list(best.items())
        yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in rows], pa.int64()), pa.array([b for _, (b, _) in rows], pa.int64()), pa.array([s for _, (_, s) in rows], pa.int64())], ["query", "bound", "minus"])

    return run


def _hits(queries: list[Query], stats: Stats, k: int, floors: dict[int, tuple[int, int]], only: dict[int, int] | None):
    """The best of each segment. ``only``: the one segment in which a query is searched; ``floors``: what others need to reach."""

    def run(batches):
        for number, segment in _read(batches, stats):
            rows = [(q.number, score, doc) for q in queries if only is None or only.get(q.number) == number for score, doc in segment.search(q, k, floors.get(q.number))]
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query", "score", "doc"])

    return run


def _query_blocks(items: DataFrame, item_col: str, text_col: str, scratch: Scratch) -> Iterator[list[tuple[object, str]]]:
    """Items in blocks of QUERY_BYTES, read block by block; a running sum over ranges deals them."""
    rows = scratch.keep(items.select(F.col(item_col).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("n", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()), "queries")
    size = F.octet_length("text") + 16
    parts = rows.groupBy("part").agg(F.sum(size).alias("bytes"))
    before = parts.select("part", F.coalesce(F.sum("bytes").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.sum(size).over(Window.partitionBy("part").orderBy("n"))
    dealt = scratch.keep(rows.withColumn("within", within).join(before, "part").select(F.floor((F.col("before") + F.col("within") - 1) / QUERY_BYTES).alias("block"), "n", "item", "text"), "blocks")
    for block in dealt.select("block").distinct().orderBy("block").toLocalIterator():
        yield [(r.item, r.text) for r in dealt.where(F.col("block") == block.block).orderBy("n").collect()]


def _search_block(docs: DataFrame, block: list[tuple[object, str]], k: int, segment_docs: int, scratch: Scratch) -> DataFrame:
    spark = docs.sparkSession
    from pyspark.sql.pandas.types import to_arrow_schema

    numbers: dict[bytes, int] = {}
    queries = [Query(n, item, [(numbers.setdefault(t, len(numbers)), times) for t, times in Counter(terms_of(text)).items()]) for n, (item, text) in enumerate(block)]
    schema = "segment long, ids array<long>, lengths array<long>, terms array<int>, first array<long>, df array<long>, place array<int>, tf array<long>"
    empty = spark.createDataFrame([], schema)
    index = scratch.keep(docs.mapInArrow(_segments(numbers, segment_docs, to_arrow_schema(empty.schema)), schema), "index")
    lengths = index.select(F.explode("lengths").alias("n")).where("n > 0")
    n_docs, total = lengths.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).collect()[0]
    weights = np.zeros(len(numbers), np.int64)
    for r in index.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).groupBy("t.terms").agg(F.sum("t.df").alias("df")).collect():  # no more than the block's terms
        weights[r.terms] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r.df + 1)))
    stats = Stats(n_docs, total, weights)
    queries = [q for q in queries if q.terms and n_docs]
    first = index.mapInArrow(_bounds(queries, stats), "query long, bound long, minus long").groupBy("query").agg(F.max(F.struct("bound", "minus")).alias("b")).collect()
    only = {r.query: -r.b.minus for r in first}
    found = index.where(F.col("segment").isin(sorted(set(only.values())))) if len(set(only.values())) <= 1000 else index
    seeds = found.mapInArrow(_hits(queries, stats, k, {}, only), "query long, score long, doc long").groupBy("query").agg(F.count("*").alias("n"), F.min(F.struct("score", (-F.col("doc")).alias("minus"))).alias("last")).collect()
    floors = {r.query: (r["last"].score, -r["last"].minus) for r in seeds if r.n == k}
    hits = index.mapInArrow(_hits([q for q in queries if q.number in only], stats, k, floors, None), "query long, score long, doc long")
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc"))).where(F.col("rank") <= k)
    return scratch.keep(ranked, "hits")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", segment_docs: int = SEGMENT_DOCS) -> DataFrame:
    """item, rank, id, score: for each row of ``items`` the k best documents with a score above 0.

    The score is a sum, over the item's terms with repeats, of integer weights for rare terms
    times a share that grows with a term's count and shrinks with the document's length.
    Equal scores go by id, null ids last; repeated rows are documents, and items, of their
    own. Null or empty texts have no terms, so they find nothing and are not found. Whole
    texts count, however long. Items are taken in blocks of bounded size, so what is handed
    to each task does not grow with their number; each block searches all documents. Ids are
    whole numbers. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    workers_can_import(docs.sparkSession)
    kind, item_kind = dict(docs.dtypes)[id_col], dict(items.dtypes)[item_col]
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    out: DataFrame | None = None
    for block in _query_blocks(items, item_col, item_text_col, scratch):
        names = docs.sparkSession.createDataFrame([(n, item) for n, (item, _) in enumerate(block)], f"query long, item {item_kind}")
        hits = _search_block(rows, block, k, segment_docs, scratch).join(F.broadcast(names), "query")
        hits = hits.select("item", F.col("rank").cast("int").alias("rank"), F.when(F.col("doc") != _LAST_ID, F.col("doc")).cast(kind).alias("doc"), "score")
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        out = _none(docs.sparkSession, f"item {item_kind}, rank int, doc {kind}, score long")
    return out.toDF(item_col, "rank", id_col, "score")


def _none(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
