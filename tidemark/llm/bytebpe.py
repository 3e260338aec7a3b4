"""Byte-level BPE by longest matches and compatible neighbours.

A piece's merges are unique, and a row of tokens is what the merges give exactly if each
pair of neighbours is. So a piece is covered from the left with the longest token at each
place (an Aho-Corasick automaton over bytes as Latin-1 characters finds them all), trying
shorter ones where neighbours do not go together and never a dead end twice: time is linear
in the piece. Whether two tokens go together is worked out once for each pair.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from functools import cache

import ahocorasick
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import workers_can_import

KEEP_UNITS = 1_000_000  # units and pieces whose ids a worker remembers
KEEP_PAIRS = 1_000_000
_NEVER = 1 << 40


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


#: A character of each class that stands for one which the regular expressions put into another class than the library does.
_STAND_INS = {r"\p{L}": "\u01c2", r"\p{N}": "\u00b2", r"\s": "\u2003", "": "\u2603"}


@cache
def class_differences() -> tuple[frozenset[str], dict[int, str], bool]:
    """Characters of another class (letter, number, space) for ``regex`` than for the tiktoken library, as their Unicode versions differ, what stands for each, and whether a space is among them.

    The library is asked for all characters at once: with a class as its pattern, it gives the bytes of those that match.
    """
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    bytes_ = {bytes([b]): b for b in range(256)}
    stand: dict[int, str] = {}
    spaces = False
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        theirs = set(bytes(tiktoken.Encoding("class", pat_str=name, mergeable_ranks=bytes_, special_tokens={}).encode_ordinary(every)).decode())
        ours = set(regex.findall(name, every))
        spaces |= name == r"\s" and ours != theirs
        stand |= {ord(c): _STAND_INS[name] for c in theirs - ours}
        for c in ours - theirs:
            stand.setdefault(ord(c), _STAND_INS[""])
    return frozenset(map(chr, stand)), stand, spaces


class _Units(dict):
    """Ids of units by their text, after ``lead``; made when first asked for, remembered up to a bound."""

    def __init__(self, make, lead: str = ""):
        self.make, self.lead = make, lead

    def __missing__(self, unit: str) -> bytes:
        data = self.make(self.lead + unit) if unit else b""
        if len(self) < KEEP_UNITS and len(unit) < 64:
            self[unit] = data
        return data


class ByteBpe:
    """Encoder and decoder over a table of ranks; ``pattern`` cuts texts into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pieces, self.matches = regex.compile(pattern).findall, regex.compile(pattern).finditer
        self.tokens = [b""] * (max(ranks.values()) + 1)
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.tokens[rank] = token
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._shorter: dict[int, int | None] = {}
        self._together: dict[tuple[int, int], bool] = {}
        self._units, self._spaced = _Units(self._unit), _Units(self._unit, " ")
        self.odd, self.stand, self.odd_spaces = class_differences()

    def merge_plainly(self, piece: bytes, below: int = _NEVER) -> list[bytes]:
        """Repeatedly merge the leftmost pair of least rank, as merges are defined."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens that a token is merged from; None for a byte, or if merges never reach it."""
        if token not in self._parts:
            data = self.tokens[token]
            halves = self.merge_plainly(data, token) if len(data) > 1 else []
            self._parts[token] = (self.ranks[halves[0]], self.ranks[halves[1]]) if len(halves) == 2 else None
        return self._parts[token]

    def shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix of a token and that merges reach."""
        if token not in self._shorter:
            data, found = self.tokens[token], None
            for n in range(len(data) - 1, 0, -1):
                rank = self.ranks.get(data[:n])
                if rank is not None and (n == 1 or self.parts(rank)):
                    found = rank
                    break
            self._shorter[token] = found
        return self._shorter[token]

    def together(self, left: int, right: int) -> bool:
        """Whether merging the bytes of two tokens ends in just these two.

        Undo their merges from the last to the first, along the ends that meet. At no stage
        may the two ends merge with each other before either merges into its own token.
        """
        key = (left, right)
        known = self._together.get(key)
        if known is not None:
            return known
        until_left = until_right = _NEVER
        good = True
        while True:
            rank = self.ranks.get(self.tokens[left] + self.tokens[right])
            if rank is not None and rank < until_left and rank <= until_right:
                good = False
                break
            made_left = left if len(self.tokens[left]) > 1 else -1
            made_right = right if len(self.tokens[right]) > 1 else -1
            if made_left < 0 and made_right < 0:
                break
            if made_left > made_right:
                until_left, left = left, self.parts(left)[1]
            else:
                until_right, right = right, self.parts(right)[0]
        if len(self._together) < KEEP_PAIRS:
            self._together[key] = good
        return good

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest = [0] * n
        for end, (token, size) in self.automaton.iter(piece.decode("latin-1")):
            if size == 1 or self.parts(token):
                longest[end - size + 1] = token
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + len(self.tokens[token])
            if not dead[end] and (not out or self.together(out[-1], token)):
                out.append(token)
                if end == n:
                    return out
                at, token = end, longest[end]
                continue
            shorter = self.shorter(token)
            while shorter is None:
                dead[at] = 1
                last = out.pop()
                at -= len(self.tokens[last])
                shorter = self.shorter(last)
            token = shorter

    def _unit(self, unit: str) -> bytes:
        if not self.odd.isdisjoint(unit):
            return self._encode_odd(unit)
        ids: list[int] = []
        for piece in self.pieces(unit):
            ids += self.encode_piece(piece.encode())
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        A single space, or a line end, between other characters always parts pieces (the
        space goes with what follows), so most texts are looked up word by word.
        """
        if self.odd_spaces and not self.odd.isdisjoint(text):  # else units are parted rightly, and each looks for itself
            return self._encode_odd(text)
        units, spaced = self._units.__getitem__, self._spaced.__getitem__
        if _ODD_SPACE.search(text):
            first, *rest = _SAFE_SPACE.split(text)
            return units(first) + b"".join(map(spaced, rest))
        newline, out = units("\n"), []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(newline)
            first, *rest = line.split(" ")
            out.append(units(first))
            out += map(spaced, rest)
        return b"".join(out)

    def _encode_odd(self, text: str) -> bytes:
        """A text with characters that the library puts into another class: it is cut as one in which others stand for these."""
        ids: list[int] = []
        for m in self.matches(text.translate(self.stand)):
            ids += self.encode_piece(text[m.start() : m.end()].encode())
        return array("I", ids).tobytes()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, array("I", ids)))


_SPACES = r"[\s\x1c-\x1f]"
_ODD_SPACE = re.compile(rf"[ \n](?={_SPACES}|\Z)|\A[ \n]|[^\S \n]")
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_LOADED: dict[tuple[str, str], ByteBpe] = {}


def loaded(path: str, pattern: str) -> ByteBpe:
    """The worker's own encoder, made once."""
    key = (path, pattern)
    if key not in _LOADED:
        _LOADED[key] = ByteBpe(read_ranks(path), pattern)
    return _LOADED[key]


def _digests(path: str, pattern: str, with_ids: bool):
    def run(batches):
        bpe = loaded(path, pattern)
        for batch in batches:
            n, ids_sha, text_sha, ids = [], [], [], []
            for text in batch.column(1):
                data = bpe.encode(text.as_py() or "")
                n.append(len(data) // 4)
                ids_sha.append(hashlib.sha256(data).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(data)).hexdigest())
                ids.append(array("I", data) if with_ids else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), pa.array(ids, pa.list_(pa.int32()))], ["row_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    return run


def encode_and_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 (and ids) for every row of ``docs``.

    Each match of ``pattern`` is encoded by itself and without special tokens, then the ids
    are decoded again. Null texts are empty. Rows are independent of each other, so repeated
    rows and ids give repeated results. Other columns are ignored. ``ranks_path`` is read on
    the executors.
    """
    workers_can_import(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    out = docs.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("text")).mapInArrow(_digests(ranks_path, pattern, with_ids), f"row_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>")
    out = out.withColumnRenamed("row_id", id_col)
    return out if with_ids else out.drop("ids")
