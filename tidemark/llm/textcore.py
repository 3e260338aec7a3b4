"""Array code for texts inside tasks: words, and 128-bit names of words and of longer strings.

A word is a maximal run of bytes other than space and 0x09-0x0D. Texts are handled in
chunks of a few megabytes, so that temporaries stay small however large a batch is.

A name is two 64-bit lanes that are mixed apart from each other, eight bytes at a time. The
name of a longer string is made of the names of two shorter ones that cover it; each step
scrambles, so no algebra of the text makes two names equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK_BYTES = 1 << 21
BLOCK = 1 << 14  # positions that are named at a time
LONG_WORD = 128  # bytes; longer words are named one by one
_ODD_A, _ODD_B = U64(0xD1342543DE82EF95), U64(0xA24BAED4963EE407)
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=U64)

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (splitmix64's finaliser)."""
    x = x + U64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    y = x >> U64(30)
    x ^= y
    x *= U64(0xBF58476D1CE4E5B9)
    np.right_shift(x, U64(27), out=y)
    x ^= y
    x *= U64(0x94D049BB133111EB)
    np.right_shift(x, U64(31), out=y)
    x ^= y
    return x


class Chunk(NamedTuple):
    """Rows lo to hi of a batch: their bytes end to end, and where each begins."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray


class Names(NamedTuple):
    """Two lanes of 64 bits for each named string."""

    a: np.ndarray
    b: np.ndarray

    def at(self, where) -> Names:
        return Names(self.a[where], self.b[where])


class Words(NamedTuple):
    """Words of a chunk: first byte, byte after the last, and each text's first word."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def chunks(texts: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string column into chunks of at most ``limit`` bytes, or one longer text. Nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, where, data = texts.buffers()
    n = len(texts)
    if not n:
        return
    off = np.frombuffer(where, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    every = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield Chunk(lo, hi, every[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


def words(chunk: Chunk) -> Words:
    data, offsets = chunk.data, chunk.offsets
    n = len(data)
    if not n:
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))
    inside = ~IS_SPACE[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    before = cut[:-1].copy()
    before[1:] |= ~inside[:-1]
    after = cut[1:].copy()
    after[:-1] |= ~inside[1:]
    starts = np.flatnonzero(inside & before)
    ends = np.flatnonzero(inside & after) + 1
    return Words(starts, ends, np.searchsorted(starts, offsets))


def joined(x: Names, y: Names) -> Names:
    """Names of strings that begin with x and end with y; how far these overlap must be the same for all."""
    a = y.a * _ODD_A
    a ^= x.a
    b = x.b * _ODD_B
    b ^= y.b >> U64(29)
    b ^= y.b << U64(35)
    return Names(mix(a), mix(b, 1))


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as an integer; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))


def lower_cased(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def word_names(chunk: Chunk, found: Words, lower: bool = False) -> Names:
    data = lower_cased(chunk.data) if lower else chunk.data
    eights, size = _eights(data), found.ends - found.starts
    a, b = mix(size.astype(U64), 21), mix(size.astype(U64), 22)
    long = np.flatnonzero(size > LONG_WORD)
    at, left, which = found.starts, size, np.arange(len(size))
    if len(long):
        which = np.flatnonzero(size <= LONG_WORD)
        at, left = at[which], left[which]
    while len(which):
        part = eights[at] & _KEEP[np.minimum(left, 8)]
        a[which] = mix(a[which] ^ part, 23)
        b[which] = mix((b[which] + part) * _ODD_B, 24)
        more = left > 8
        at, left, which = at[more] + 8, left[more] - 8, which[more]
    for k in long.tolist():
        digest = hashlib.blake2b(data[found.starts[k] : found.ends[k]].tobytes(), digest_size=16).digest()
        a[k], b[k] = np.frombuffer(digest, dtype="<u8")
    return Names(a, b)


def windows(names: Names, size: int) -> Names:
    """Names of every ``size`` consecutive items, by doubling; none where there are fewer items."""
    if len(names.a) < size:
        return Names(np.zeros(0, U64), np.zeros(0, U64))
    span = 1
    while span < size:
        step = min(span, size - span)
        names = joined(names.at(slice(0, len(names.a) - step)), names.at(slice(step, None)))
        span += step
    return names


def _few_byte_windows(data: np.ndarray, size: int) -> Names:
    n = len(data)
    if size < 8:
        raw = _eights(data)[: n - size + 1] & _KEEP[size]
        return Names(mix(raw, 31), mix(raw, 32))
    raw = _eights(data)[: n - 7].copy()
    a = mix(raw, 31)
    names, span = Names(a, a * _ODD_B), 8
    while span < size:
        step = min(span, size - span)
        names = joined(names.at(slice(0, len(names.a) - step)), names.at(slice(step, None)))
        span += step
    return names


def byte_windows(data: np.ndarray, size: int) -> Names:
    """Names of every ``size`` consecutive bytes: eight are their own name, longer ones are made by doubling.

    Blocks of the data are named in turn, so that the names of all lengths stay in a core's cache.
    """
    n = max(0, len(data) - size + 1)
    out = Names(np.empty(n, U64), np.empty(n, U64))
    for lo in range(0, n, BLOCK):
        block = _few_byte_windows(data[lo : lo + BLOCK + size - 1], size)
        out.a[lo : lo + BLOCK], out.b[lo : lo + BLOCK] = block
    return out


def extent_names(parts: Names, size: int, lo: np.ndarray, end: np.ndarray) -> Names:
    """Names of the extents [lo, end), no shorter than ``size``, from those of the windows of ``size`` items.

    These are taken at lo, lo + size, lo + 2 size ... and at end - size.
    """
    a, b = mix((end - lo).astype(U64), 41), mix((end - lo).astype(U64), 42)
    which, at = np.arange(len(lo)), lo
    while len(which):
        last = end[which] - size
        part = parts.at(np.minimum(at, last))
        named = joined(Names(a[which], b[which]), part)
        a[which], b[which] = named
        more = at < last
        which, at = which[more], at[more] + size
    return Names(a, b)


def row_hashes(rows: np.ndarray, salt: int) -> np.ndarray:
    """One hash of all columns for each row."""
    out = rows[:, 0].copy()
    for j in range(1, rows.shape[1]):
        out = mix(out * _ODD_A + rows[:, j])
    return mix(out, 1000 + salt)


def distinct(names: Names) -> Names:
    """Different names, sorted."""
    order = np.argsort(names.a, kind="stable")
    a, b = names.at(order)
    if not len(a):
        return names
    tie = a[1:] == a[:-1]
    if (tie & (b[1:] != b[:-1])).any():  # one lane agrees by chance
        order = np.lexsort((names.b, names.a))
        a, b = names.at(order)
        tie = a[1:] == a[:-1]
    keep = np.ones(len(a), bool)
    keep[1:] = ~(tie & (b[1:] == b[:-1]))
    return Names(a[keep], b[keep])


def shingle_set(names: Names, size: int) -> Names:
    """Sorted distinct shingles of a text's words; fewer words than ``size`` make one shingle."""
    n = len(names.a)
    if n and n < size:
        whole = windows(names, n)
        return Names(mix(whole.a, 100 + n), mix(whole.b, 100 + n))
    return distinct(windows(names, size))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
