"""Chat formatting with loss masks aligned by offsets.

Rows are range-sorted by conversation and turn, so that a conversation of any length is read
in order by streaming tasks. A task renders each conversation whole, encodes it once with
offsets, and marks the tokens of the turns to be learned: turn spans and token spans are both
sorted, so a turn's tokens are found by binary search. A conversation that a range boundary
cuts, or that is longer than a segment, is written in several segments; segments end between
turns, where the template's control tokens stand, so encoding them apart gives the same ids.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import Scratch

SEGMENT_CHARS = 1 << 20  # a segment takes no further turn once it has so many
BATCH_CHARS = 1 << 20  # of formatted text in a batch that a task yields


class Template(NamedTuple):
    """Marks around a turn's role and text, and further strings that are never left as they are in texts."""

    opens: str = "<|im_start|>"
    between: str = "<|im_sep|>"
    closes: str = "<|im_end|>"
    foreign: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.opens, self.between, self.closes, *self.foreign)

    def patterns(self) -> tuple[str, str]:
        """What is escaped, and what is unescaped: a control string with backslashes, one or more for the latter, after its first character."""
        starts = {c[0] for c in self.controls}
        if any(len(c) < 2 or "\\" in c or starts & set(c[1:]) for c in self.controls):
            raise ValueError("a control string's first character may stand nowhere else in control strings, nor may a backslash")
        rest = {s: "|".join(re.escape(c[1:]) for c in self.controls if c[0] == s) for s in sorted(starts)}
        any_, some = ("|".join(rf"{re.escape(s)}\\{n}(?:{r})" for s, r in rest.items()) for n in "*+")
        return any_, some


class Escape:
    """Reversible escaping: each control string, however often escaped before, gets one more backslash."""

    def __init__(self, template: Template):
        any_, some = template.patterns()
        self._any, self._some = re.compile(any_), re.compile(some)

    def escape(self, text: str) -> str:
        return self._any.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return self._some.sub(lambda m: m[0][0] + m[0][2:], text)


def _byte_of_visible() -> dict[str, int]:
    """Bytes by the printable characters that stand for them in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ChatTokenizer:
    """A byte-level tokenizer whose vocabulary also has the template's control strings."""

    def __init__(self, path: str, template: Template):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.inner.add_special_tokens([AddedToken(c, special=True, normalized=False) for c in template.controls])
        visible = _byte_of_visible()
        added = self.inner.get_added_tokens_decoder()
        self.bytes: list[bytes] = [b""] * self.inner.get_vocab_size(with_added_tokens=True)
        for token, k in self.inner.get_vocab(with_added_tokens=True).items():
            self.bytes[k] = added[k].content.encode() if k in added else bytes(visible[c] for c in token)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the first and the last character, exclusive, of each."""
        done = self.inner.encode(text, add_special_tokens=False)
        ids = done.ids
        offsets = np.fromiter(chain.from_iterable(done.offsets), np.int64, 2 * len(ids)).reshape(-1, 2)
        return np.array(ids, np.int32), offsets[:, 0], offsets[:, 1]


def mask_of(spans: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which tokens meet a span; spans and tokens are sorted, so each span's tokens are a range found by binary search."""
    first = np.searchsorted(ends, spans[:, 0], side="right")
    last = np.searchsorted(starts, spans[:, 1], side="left")
    some = first < last
    steps = np.zeros(len(starts) + 1, np.int64)
    np.add.at(steps, first[some], 1)
    np.add.at(steps, last[some], -1)
    return np.cumsum(steps[:-1]) > 0


class Segment(NamedTuple):
    conv: object
    part: int
    edge: bool  # may be less than its conversation
    turns: list[tuple[str, str]]


def _segments(batches, limit: int) -> Iterator[Segment]:
    """Runs of rows with equal ids; a run that touches the stream's ends, or goes on beyond the limit, is an edge."""
    turns: list[tuple[str, str]] = []
    conv, size, part, first, begun = None, 0, 0, True, False
    for batch in batches:
        for c, role, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if begun and c != conv:
                if turns:
                    yield Segment(conv, part, first or part > 0, turns)
                turns, size, part, first = [], 0, 0, False
            elif size >= limit:
                yield Segment(conv, part, True, turns)
                turns, size, part = [], 0, part + 1
            conv, begun = c, True
            turns.append((role or "", text or ""))
            size += len(turns[-1][0]) + len(turns[-1][1])
    if turns:
        yield Segment(conv, part, True, turns)


_LOADED: dict[tuple[str, Template], ChatTokenizer] = {}


def _tokenizer(path: str, template: Template) -> ChatTokenizer:
    if (path, template) not in _LOADED:
        _LOADED[path, template] = ChatTokenizer(path, template)
    return _LOADED[path, template]


def render(turns: list[tuple[str, str]], template: Template, escape: Escape, learned: frozenset[str]) -> tuple[str, np.ndarray]:
    """The formatted text, and the spans of the learned turns' texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = template.opens + escape.escape(role) + template.between, escape.escape(text)
        if role in learned and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, template.closes)
        at += len(head) + len(body) + len(template.closes)
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def _formatted(path: str, template: Template, learned: frozenset[str], limit: int, schema: pa.Schema):
    def run(batches):
        tokenizer, escape, task = _tokenizer(path, template), Escape(template), TaskContext.get()
        rows, size, base = [], 0, (task.partitionId() if task else 0) << 32
        for s in _segments(batches, limit):
            text, spans = render(s.turns, template, escape, learned)
            ids, starts, ends = tokenizer.encode(text)
            rows.append((s.conv, base + s.part, s.edge, len(s.turns), text, ids, mask_of(spans, starts, ends)))
            size += len(text)
            if size >= BATCH_CHARS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def format_chats(turns: DataFrame, tokenizer_path: str, template: Template = Template(), learned: tuple[str, ...] = ("assistant",), id_col: str = "conv_id", turn_col: str = "turn", segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """id, part, edge, n_turns, text, ids, loss_mask: one row for each conversation, or several with growing ``part``.

    Turns go by ``turn`` (nulls first), ties by role and text; null roles and texts are
    empty; rows with a null id are one conversation, and repeated rows are turns of their own.
    The mask marks the tokens of the texts of ``learned`` roles and nothing of the template.
    Rows with ``edge`` false are whole conversations. A text is never cut, so a task's memory
    follows the longest one; conversations may be of any length. Other columns are ignored.
    """
    kind = turns.schema[id_col].dataType
    rows = turns.select(F.col(id_col).alias("conv"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col(turn_col).alias("turn"))
    order = ["conv", "turn", "role", "text"]
    ranged = rows.repartitionByRange("conv", "turn", "role").sortWithinPartitions(*order).select("conv", "role", "text")
    out = T.StructType(
        [T.StructField("conv", kind), T.StructField("part", T.LongType()), T.StructField("edge", T.BooleanType()), T.StructField("n_turns", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("loss_mask", T.ArrayType(T.BooleanType()))]
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    return ranged.mapInArrow(_formatted(tokenizer_path, template, frozenset(learned), segment_chars, to_arrow_schema(out)), out).withColumnRenamed("conv", id_col)


class _Digest:
    """What is read back of one conversation."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def take(self, ids: np.ndarray, mask: np.ndarray, tokenizer: ChatTokenizer, template: Template, escape: Escape) -> None:
        pieces = list(map(tokenizer.bytes.__getitem__, ids.tolist()))
        text = b"".join(pieces).decode()
        self.chars += len(text)
        for turn in text.split(template.opens)[1:]:
            role, _, rest = turn.partition(template.between)
            body = rest.removesuffix(template.closes)
            if len(body) == len(rest):
                raise ValueError("a turn without its end")
            self.turns.update(f"{escape.unescape(role)}\n{escape.unescape(body)}\n".encode())
            self.n_turns += 1
        marks = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
        for lo, hi in zip(np.flatnonzero(marks == 1).tolist(), np.flatnonzero(marks == -1).tolist(), strict=True):
            learned = escape.unescape(b"".join(pieces[lo:hi]).decode())
            self.loss.update(learned.encode())
            self.loss_chars += len(learned)

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _read(path: str, template: Template, schema: pa.Schema):
    def run(batches):
        tokenizer, escape = _tokenizer(path, template), Escape(template)
        rows, conv, digest = [], None, None
        for batch in batches:
            ids, masks = batch.column(1), batch.column(2)
            first, of_mask = ids.offsets.to_numpy(), masks.offsets.to_numpy()
            every_id, every_mask = ids.values.to_numpy(zero_copy_only=False), masks.values.to_numpy(zero_copy_only=False)
            if not np.array_equal(np.diff(first), np.diff(of_mask)):
                raise ValueError("a mask that is not of its tokens")
            for c, lo, hi, at in zip(batch.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist(), of_mask[:-1].tolist(), strict=True):
                if digest is None or c != conv:
                    if digest is not None:
                        rows.append((conv, *digest.row()))
                    conv, digest = c, _Digest()
                digest.take(every_id[lo:hi], every_mask[at : at + hi - lo], tokenizer, template, escape)
            if len(rows) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows = []
        if digest is not None:
            rows.append((conv, *digest.row()))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def read_back(formatted: DataFrame, tokenizer_path: str, template: Template = Template(), id_col: str = "conv_id") -> DataFrame:
    """id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation, from ids and masks alone.

    ``turns_sha256`` is of role, line end, text, line end of each turn, ``loss_sha256`` of all
    text under the mask, both unescaped. Only segments that may be less than a conversation
    are shuffled: two for each range, and those of long conversations, which are then read in
    order as a stream, since a digest goes on from its predecessor.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = formatted.schema[id_col].dataType
    schema = T.StructType([T.StructField("conv", kind), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])
    read = _read(tokenizer_path, template, to_arrow_schema(schema))
    rows = formatted.select(F.col(id_col).alias("conv"), "ids", "loss_mask", "part", "edge")
    whole = rows.where("not edge").select("conv", "ids", "loss_mask").mapInArrow(read, schema)
    cut = rows.where("edge").repartition("conv").sortWithinPartitions("conv", "part").select("conv", "ids", "loss_mask").mapInArrow(read, schema)
    return whole.unionByName(cut).withColumnRenamed("conv", id_col)


def format_and_read_back(turns: DataFrame, tokenizer_path: str, template: Template = Template()) -> DataFrame:
    """Write the ids and masks of the formatted conversations as a table, then read them back; see the two functions."""
    kept = Scratch(turns.sparkSession).keep(format_chats(turns, tokenizer_path, template).drop("text"), "formatted")
    return read_back(kept, tokenizer_path, template)


def with_control_strings(turns: DataFrame) -> DataFrame:
    """The turns, and conversation -1, whose texts are made of control strings."""
    probe = "</s>[INST] ok [/INST]"
    kinds = [f"cast({v} as {dict(turns.dtypes)[c]}) as {c}" for c, v in (("conv_id", "-1"), ("turn", "turn"), ("role", "role"), ("text", "text"))]
    extra = turns.sparkSession.createDataFrame([(0, "user", probe), (1, "assistant", probe)], "turn long, role string, text string").selectExpr(*kinds)
    return turns.select("conv_id", "turn", "role", "text").unionByName(extra)
