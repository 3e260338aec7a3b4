"""Windows of texts that occur elsewhere: what tasks do for the two repeat operators.

Items are bytes or words. Every window owns one anchor: of the grams (a shorter length)
inside it, the leftmost of those with the least name. Equal windows own equal anchors, so
buckets of grams at anchors, a few hundredths of all positions, hold all that can repeat:

* an occurrence that is alone in its bucket has no window that repeats;
* occurrences with equal extents (all that their windows cover) repeat each other throughout;
* others are open: one occurrence of each extent goes on to a finer round.

Names have 128 bits, see ``textcore``. What a chunk of texts can tell by itself it does not
ask of others: equal extents are merged, and extents of a gram that has several in one chunk
go to buckets of their own extents, so neither a group of copies nor a very frequent gram
sends more than a few rows of each chunk to one bucket. Buckets are streamed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textcore as tc

RESOLVED, OPEN = 1, 2  # kinds of occurrences that come out of a round
TWICE, MANY, MARK = 8, 16, 32  # flags of those that go into one

ROWS = "key long, a long, b long, doc long, mark long, lo int, hi int, at int, kind int"
FOUND = "doc long, mark long, lo int, hi int, at int, kind int"
_NAMES = [c.split()[0] for c in ROWS.split(", ")]
_KINDS = [pa.int64() if "long" in c else pa.int32() for c in ROWS.split(", ")]


class Part(NamedTuple):
    """Texts of a batch, or a stretch of one: rows lo to hi, their items' gram names, where texts begin, and items left out before."""

    lo: int
    hi: int
    grams: tc.Names
    offsets: np.ndarray
    base: int


def byte_parts(window: int, gram: int) -> Callable[[pa.Array], Iterator[Part]]:
    """Texts as bytes; very long ones in stretches that overlap by a window."""

    def run(texts):
        step = tc.CHUNK_BYTES
        for c in tc.chunks(texts, tc.CHUNK_BYTES // 8):
            n = len(c.data)
            if c.hi - c.lo > 1 or n <= step + window:
                yield Part(c.lo, c.hi, tc.byte_windows(c.data, gram), c.offsets, 0)
                continue
            for x in range(0, n - window + 1, step):
                data = c.data[x : x + step + window - 1]
                yield Part(c.lo, c.hi, tc.byte_windows(data, gram), np.array([0, len(data)]), x)

    return run


def word_parts(gram: int) -> Callable[[pa.Array], Iterator[Part]]:
    """Texts as words."""

    def run(texts):
        for c in tc.chunks(texts):
            w = tc.words(c)
            yield Part(c.lo, c.hi, tc.windows(tc.word_names(c, w), gram), w.first, 0)

    return run


def _sliding_minima(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive values, by doubling."""
    span, out = 1, x
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    if span < width:
        out = np.minimum(out[: len(out) - (width - span)], out[width - span :])
    return out


class Runs(NamedTuple):
    """Windows lo to hi of a text that own the anchor at ``at``; positions in the part."""

    text: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    at: np.ndarray


def _between(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo, lo + 1 ... for n places each, end to end."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def runs_of(part: Part, window: int, gram: int, asked: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> Runs:
    """Runs of a part's windows, or of those that are asked for: (text, first, last) in the text."""
    first, last = part.offsets[:-1], part.offsets[1:]
    none = np.zeros(0, np.int64)
    if len(part.grams.a) < window - gram + 1:
        return Runs(none, none, none, none)
    if asked is None:
        n = np.maximum(last - first - window + 1, 0)
        text, start = np.repeat(np.arange(len(first)), n), _between(first, n)
    else:
        n = asked[2] - asked[1] + 1
        text, start = np.repeat(asked[0], n), _between(asked[1] + first[asked[0]], n)
    order = (part.grams.a & tc.U64(0xFFFFFFFF00000000)) | np.arange(len(part.grams.a)).astype(tc.U64)
    own = (_sliding_minima(order, window - gram + 1)[start] & tc.U64(0xFFFFFFFF)).astype(np.int64)
    cut = np.ones(len(start), bool)
    cut[1:] = (own[1:] != own[:-1]) | (start[1:] != start[:-1] + 1) | (text[1:] != text[:-1])
    heads = np.flatnonzero(cut)
    tails = np.append(heads[1:], len(start)) - 1 if len(heads) else heads
    return Runs(text[heads], start[heads], start[tails], own[heads])


def _batch(columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(tc.signed(c) if c.dtype == np.uint64 else c, t, safe=False) for c, t in zip(columns, _KINDS, strict=True)], _NAMES)


def shipped(key: np.ndarray, names: tc.Names, doc: np.ndarray, mark: np.ndarray, row: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray, earlier: bool) -> pa.RecordBatch:
    """Occurrences of a part, ready for ``settled``; what the part settles by itself comes out as RESOLVED."""
    order = np.lexsort((doc, names.b, names.a))
    a, b = names.at(order)
    head = np.ones(len(order), bool)
    head[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    group, heads = np.cumsum(head) - 1, np.flatnonzero(head)
    if earlier:
        done = doc[order] > doc[order][heads][group]
        goes, flags = ~done, np.zeros(len(order), np.int64)
    else:
        done = (np.bincount(group) > 1)[group] if len(order) else head
        goes, flags = head, np.where(done, TWICE, 0)
    kinds, times = np.unique(key[order][heads], return_counts=True)
    several = kinds[times > 1]
    many = np.isin(key[order], several)
    flags = flags + np.where(many, MANY, 0)
    bucket = np.where(many, tc.mix(a, 77), key[order])
    s = order[done]
    s = s[np.lexsort((lo[s], row[s]))]
    open_ = np.ones(len(s), bool)
    open_[1:] = (row[s][1:] != row[s][:-1]) | (lo[s][1:] != hi[s][:-1] + 1)
    begin = np.flatnonzero(open_)
    until = np.append(begin[1:], len(s)) - 1 if len(begin) else begin
    zero = np.zeros(len(several), np.int64)
    r, t = s[begin], order[goes]
    nil = np.zeros(len(r), np.int64)
    return _batch(
        [
            np.concatenate([tc.mix(mark[r].astype(np.int64).view(tc.U64) + lo[r].astype(tc.U64), 40), bucket[goes], several]),
            np.concatenate([nil.view(tc.U64), a[goes], zero.view(tc.U64)]),
            np.concatenate([nil.view(tc.U64), b[goes], zero.view(tc.U64)]),
            np.concatenate([doc[r], doc[t], zero]),
            np.concatenate([mark[r], mark[t], zero]),
            np.concatenate([lo[r], lo[t], zero]),
            np.concatenate([hi[s[until]], hi[t], zero]),
            np.concatenate([nil, at[t], zero]),
            np.concatenate([np.full(len(r), RESOLVED), flags[goes], np.full(len(several), MARK)]),
        ]
    )


def _asked(column: pa.Array, part: Part) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.StructArray]:
    """(text, first, last) of the ranges of a part's texts, and the structs themselves."""
    ranges = column.slice(part.lo, part.hi - part.lo)
    flat = ranges.flatten()
    return np.repeat(np.arange(part.hi - part.lo), np.asarray(ranges.value_lengths())), flat.field("lo").to_numpy().astype(np.int64), flat.field("hi").to_numpy().astype(np.int64), flat


def run_rows(parts, window: int, gram: int, earlier: bool):
    """Runs of (doc, mark, text), or of the ranges in a fourth column: bucketed by the gram at the anchor, told apart by their extents."""

    def run(batches):
        for batch in batches:
            docs, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for part in parts(batch.column(2)):
                runs = runs_of(part, window, gram, _asked(batch.column(3), part)[:3] if batch.num_columns > 3 else None)
                if len(runs.text):
                    names = tc.extent_names(part.grams, gram, runs.lo, runs.hi + window)
                    row, shift = runs.text + part.lo, part.base - part.offsets[:-1][runs.text]
                    yield shipped(part.grams.a[runs.at], names, docs[row], marks[row], row, runs.lo + shift, runs.hi + shift, runs.at + shift, earlier)

    return run


def piece_rows(parts, window: int, gram: int, size: int, earlier: bool):
    """The ranges of (doc, mark, text, ranges) in pieces of ``size`` windows, counted from the anchor.

    All windows of a piece share its core; a piece is bucketed by the core's name and told
    apart by its extent. With one window a piece, both are the window.
    """

    def run(batches):
        for batch in batches:
            docs, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for part in parts(batch.column(2)):
                text, lo, hi, flat = _asked(batch.column(3), part)
                at = flat.field("at").to_numpy().astype(np.int64) - part.base
                reach = len(part.grams.a) - 1 + gram - window  # the last window of a stretch
                lo, hi = np.maximum(lo - part.base, 0), np.minimum(hi - part.base, reach if part.base or part.hi - part.lo == 1 else hi)
                some = hi >= lo
                text, lo, hi, at = text[some], lo[some], hi[some], at[some]
                if not len(lo):
                    continue
                near, far = (at - hi) // size, (at - lo) // size
                n = far - near + 1
                of, step = np.repeat(np.arange(len(lo)), n), _between(near, n)
                text, lo, hi, at = text[of], lo[of], hi[of], at[of]
                top = at - step * size
                bottom = np.maximum(top - size + 1, at - (window - gram))
                begin = part.offsets[:-1][text]
                lo, hi = np.maximum(lo, bottom), np.minimum(hi, top)
                core = tc.extent_names(part.grams, gram, top + begin, bottom + begin + window) if size > 1 else None
                names = tc.extent_names(part.grams, gram, lo + begin, hi + begin + window)
                key = tc.mix(core.a + step.astype(tc.U64), 50) if core else names.a
                row = text + part.lo
                yield shipped(key, names, docs[row], marks[row], row, lo + part.base, hi + part.base, at + part.base, earlier)

    return run


def _with_end(batches):
    yield from batches
    yield None


def _settle(earlier: bool):
    """Rows come sorted by (key, a, b, doc); RESOLVED and OPEN occurrences go out.

    earlier: an occurrence is resolved by one in a document with a smaller id, else by any
    other. State is one row for each bucket, besides those of the least id in its first extent.
    """

    def run(batches):
        held: list[tuple] = []  # of the first extent, until a second one shows
        bucket = extent = least = twin = None
        many = False
        rest = None
        for batch in _with_end(batches):
            if batch is None:
                t, final = rest, True
                if t is None:
                    return
            else:
                t, final = pa.Table.from_batches([batch]), False
                if rest is not None:
                    t = pa.concat_tables([rest, t])
            key = t.column("key").to_numpy()
            n = len(key) if final else len(key) - 1
            if n <= 0:
                rest = t
                continue
            same = np.zeros(len(key) + 1, bool)
            same[1:-1] = key[1:] == key[:-1]
            same[0] = bucket is not None and key[0] == bucket
            kind = t.column("kind").to_numpy()[:n]
            busy = np.flatnonzero((same[:n] | same[1 : n + 1]) | ((kind != 0) & (kind != MARK)))  # others are alone in their bucket
            out: list[tuple] = []
            columns = [t.column(c).to_numpy()[busy].tolist() for c in _NAMES]
            for k, a, b, doc, mark, lo, hi, at, what in zip(*columns, strict=True):
                row = (doc, mark, lo, hi, at)
                if what == RESOLVED:
                    out.append((*row, RESOLVED))
                    continue
                if k != bucket:
                    bucket, extent, many, held, least, twin = k, None, False, [], None, None
                if what & (MARK | MANY) and not many:
                    many = True
                    out += [(*r, OPEN) for r in held]
                    held = []
                if what & MARK:
                    continue
                if (a, b) != extent:
                    if extent is not None and not many:
                        many = True
                        out += [(*r, OPEN) for r in held]
                        held = []
                    extent, least = (a, b), doc
                    twin = None if what & TWICE else row  # TWICE: resolved where it was found
                    if many:
                        out.append((*row, OPEN))
                    else:
                        held.append(row)
                elif earlier:
                    if doc > least:
                        out.append((*row, RESOLVED))
                    elif many:
                        out.append((*row, OPEN))
                    else:
                        held.append(row)
                else:
                    if twin is not None:
                        out.append((*twin, RESOLVED))
                        twin = None
                    if not what & TWICE:
                        out.append((*row, RESOLVED))
            if bucket is not None and n and key[n - 1] != bucket:
                bucket, extent, many, held, least, twin = None, None, False, [], None, None
            rest = t.slice(n) if not final else None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.int64() if j < 2 else pa.int32()) for j in range(6)], ["doc", "mark", "lo", "hi", "at", "kind"])

    return run


def settled(rows: DataFrame, earlier: bool) -> DataFrame:
    """One round: rows of ``shipped`` by bucket, sorted by extent; RESOLVED and OPEN occurrences."""
    return rows.repartition("key").sortWithinPartitions("key", "a", "b", "doc").mapInArrow(_settle(earlier), FOUND)


def ranges(kind: int, *columns: str) -> Column:
    """The different occurrences of a kind in order, in an aggregation."""
    return F.sort_array(F.collect_set(F.when(F.col("kind") == kind, F.struct(*columns))))


def covered(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of the half-open spans [lo, hi), as maximal runs."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    cut = np.ones(len(lo), bool)
    cut[1:] = lo[1:] > hi[:-1]
    heads = np.flatnonzero(cut)
    return lo[heads], hi[np.append(heads[1:], len(lo)) - 1] if len(heads) else hi
