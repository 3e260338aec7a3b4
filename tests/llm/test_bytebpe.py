import hashlib
from array import array

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bytebpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = bytebpe.read_ranks(PATH)
MINE = bytebpe.ByteBpe(RANKS, public_tokenizers.PATTERN)
THEIRS = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
PARTS = ["a", "e", "th", " ", "  ", "\n", "\t", " \n", "é", "ß", "日本", "😀", "́", "1", "22", "'s", "'", "!!", "\x1c", "\x85", "\xa0", " ", "\r\n", "der", "ing", "न", "<|endoftext|>", "\x00", "²"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=30).map("".join))
def test_as_the_library(text):
    data = MINE.encode(text)
    assert list(array("I", data)) == THEIRS.encode_ordinary(text)
    assert MINE.decode(data) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=40))
def test_pieces_as_merged_plainly(piece):
    want = [RANKS[piece]] if piece in RANKS else [RANKS[p] for p in MINE.merge_plainly(piece)]
    assert MINE.encode_piece(piece) == want


def test_long_piece_is_linear():
    piece = b"ab" * 50_000
    assert b"".join(MINE.tokens[t] for t in MINE.encode_piece(piece)) == piece


def test_query(documents, odd):
    out = bytebpe.encode_and_decode(documents(odd), PATH, public_tokenizers.PATTERN, with_ids=True).collect()
    assert len(out) == len(odd)
    for row, (doc, text) in zip(out, odd, strict=True):
        ids = THEIRS.encode_ordinary(text or "")
        assert (row.doc_id, row.n_tokens, row.ids) == (doc, len(ids), ids)
        assert row.ids_sha256 == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bytebpe.encode_and_decode(documents([]), PATH, public_tokenizers.PATTERN).collect() == []


@pytest.mark.parametrize("cap", [0, 3])
def test_bounded_memory(monkeypatch, cap):
    monkeypatch.setattr(bytebpe, "KEEP_UNITS", cap)
    monkeypatch.setattr(bytebpe, "KEEP_PAIRS", cap)
    small = bytebpe.ByteBpe(RANKS, public_tokenizers.PATTERN)
    text = "unbelievable words, unbelievable Wörter " * 20
    assert list(array("I", small.encode(text))) == THEIRS.encode_ordinary(text) and len(small._units) <= cap


def test_characters_that_the_library_classes_otherwise():
    """Newer Unicode versions have letters that the library takes for other characters; pieces are cut as it cuts them."""
    import random

    odd, stand, _ = bytebpe.class_differences()
    rng, some = random.Random(4), sorted(stand)
    texts = ["\U00032667a\x0b\x04", "\U0003e450'm"]
    texts += ["".join(rng.choice([chr(rng.choice(some or [97])), "a", "'m", " ", "\n", "1", "é", " ", "!"]) for _ in range(12)) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randrange(0x80), rng.randrange(0x3000), rng.randrange(0xE000, 0x110000)])) for _ in range(10)) for _ in range(3000)]
    for text in texts:
        data = MINE.encode(text)
        assert list(array("I", data)) == THEIRS.encode_ordinary(text)
        assert MINE.decode(data) == text.encode()
    assert odd == set(map(chr, stand))
    MINE.odd_spaces = True  # whole texts are looked through where spaces differ
    assert all(list(array("I", MINE.encode(t))) == THEIRS.encode_ordinary(t) for t in texts[:500])
    MINE.odd_spaces = False
