import hashlib
from collections import Counter

import pyarrow as pa
import pytest

from tests.llm.conftest import by_null, collected, words
from tidemark.llm import passages, repeats, suffixes
from tidemark.llm import textcore as tc


def brute_bytes(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[s : s + length] for _, b in texts for s in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=by_null)


def brute_words(rows, window):
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in texts:
        for s in range(len(w) - window + 1 if i is not None else 0):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in texts:
        gone = bytearray(len(w))
        for s in range(len(w) - window + 1):
            if i is not None and first[tuple(w[s : s + window])] < i:
                gone[s : s + window] = b"\1" * window
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=by_null)


BYTES = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
WORDS = ("doc_id", "n_words", "n_removed", "kept_sha256")


def passages_among(rng, n):
    shared = [words(rng, rng.randrange(5, 90)) for _ in range(6)]
    rows = []
    for k in range(n):
        w = []
        for _ in range(rng.randrange(1, 5)):
            w += rng.choice(shared) if rng.random() < 0.6 else words(rng, rng.randrange(1, 60))
        rows.append((rng.randrange(1000), (" " if k % 3 else "\n").join(w)))
    return rows


@pytest.mark.parametrize("length", [3, 20, 64, 200])
def test_bytes_as_brute_force(documents, rng, length):
    rows = passages_among(rng, 40)
    assert collected(suffixes.remove_repeated_bytes(documents(rows), length), *BYTES) == brute_bytes(rows, length)


@pytest.mark.parametrize("window", [2, 7, 20, 50])
def test_words_as_brute_force(documents, rng, window):
    rows = passages_among(rng, 60)
    assert collected(passages.remove_repeated_passages(documents(rows), window), *WORDS) == brute_words(rows, window)


@pytest.mark.parametrize("length", [2, 9, 50])
def test_odd_rows(documents, odd, length):
    rows = [(i, t if t is None or len(t) < 50_000 else t[:3000]) for i, t in odd] + [(20, "a" * 300), (21, "ab" * 100), (22, "é" * 90)]
    assert collected(suffixes.remove_repeated_bytes(documents(rows), length), *BYTES) == brute_bytes(rows, length)
    assert collected(passages.remove_repeated_passages(documents(rows), length), *WORDS) == brute_words(rows, length)


def test_long_text_and_empty_table(documents, odd):
    long = [r for r in odd if r[1] and len(r[1]) > 50_000]
    assert len(suffixes.remove_repeated_bytes(documents(long * 2)).collect()) == 2
    assert [r.n_removed for r in suffixes.remove_repeated_bytes(documents(long * 2)).collect()] == [len(long[0][1])] * 2
    assert suffixes.remove_repeated_bytes(documents([])).collect() == [] and passages.remove_repeated_passages(documents([])).collect() == []


def test_many_chunks(documents, rng, monkeypatch):
    """What one chunk settles by itself and what meets in the shuffle must agree."""
    rows = passages_among(rng, 60) * 2
    spread = documents(rows).repartition(7)
    assert collected(suffixes.remove_repeated_bytes(spread, 30), *BYTES) == brute_bytes(rows, 30)
    assert collected(passages.remove_repeated_passages(spread, 10), *WORDS) == brute_words(rows, 10)


def test_stripped_texts(documents, rng):
    rows = [(k, t) for k, (_, t) in enumerate(passages_among(rng, 60))]
    want = {i: (n - gone, sha) for i, n, gone, sha in brute_words(rows, 20)}
    left = passages.strip_repeated_passages(documents(rows), 20)
    assert left.columns == documents(rows).columns
    got = {r.doc_id: hashlib.sha256(b" ".join(r.text.encode().split())).hexdigest() for r in left.collect()}
    assert got == {i: sha for i, (n, sha) in want.items() if n}
    untouched = {i: t for i, t in rows if want[i][1] == hashlib.sha256(b" ".join(t.encode().split())).hexdigest()}
    assert all(r.text == untouched[r.doc_id] for r in left.collect() if r.doc_id in untouched)


def thue_morse(k, a="a", b="b"):
    """Two different words whose polynomial hashes modulo a power of two agree for every odd base."""
    x, y = a, b
    for _ in range(k):
        x, y = x + y, y + x
    return x, y


def test_words_that_polynomial_hashes_confuse(documents):
    x, y = thue_morse(10)
    rows = [(1, " ".join([x] * 60)), (2, " ".join([y] * 60)), (3, " ".join(thue_morse(10, "p", "q")[k % 2] for k in range(60)))]
    rows += [(4, "".join(thue_morse(10))), (5, "".join(reversed(thue_morse(10))))]
    assert collected(passages.remove_repeated_passages(documents(rows)), *WORDS) == brute_words(rows, 50)
    assert collected(suffixes.remove_repeated_bytes(documents(rows)), *BYTES) == brute_bytes(rows, 200)


def test_a_frequent_line_among_others(documents, rng):
    """One long line in every text, and near copies: buckets with many extents, some in one part and some in several."""
    line = " ".join(words(rng, 60))
    base = words(rng, 150)
    rows = [(k, " ".join(words(rng, 30)) + "\n" + line + "\n" + " ".join(words(rng, 30))) for k in range(30)]
    for k in range(30):
        w = list(base)
        w[rng.randrange(150)] = f"e{k}"
        rows.append((100 + k, " ".join(w)))
    docs = documents(rows).repartition(5)
    assert collected(suffixes.remove_repeated_bytes(docs), *BYTES) == brute_bytes(rows, 200)
    assert collected(passages.remove_repeated_passages(docs), *WORDS) == brute_words(rows, 50)


def test_long_texts_go_in_stretches(documents, rng, monkeypatch):
    monkeypatch.setattr(tc, "CHUNK_BYTES", 300)
    long = words(rng, 700)
    rows = [(1, " ".join(long)), (2, " ".join(long[100:400] + words(rng, 50) + long[380:])), (3, " ".join(long[300:360]))]
    parts = repeats.byte_parts(200, 64)
    pieces = list(parts(pa.array([rows[0][1]])))
    assert len(pieces) > 3 and sum(len(p.grams.a) - 136 for p in pieces) == len(rows[0][1]) - 199
    seen = set()
    for p in pieces:
        runs = repeats.runs_of(p, 200, 64)
        seen |= {s + p.base for lo, hi in zip(runs.lo.tolist(), runs.hi.tolist()) for s in range(lo, hi + 1)}
    assert seen == set(range(len(rows[0][1]) - 199))


def test_ids_of_another_type(spark):
    docs = spark.createDataFrame([("x", "ab" * 150), ("y", "ab" * 150), (None, "c" * 50)], "doc_id string, text string")
    assert collected(suffixes.remove_repeated_bytes(docs), "doc_id", "n_removed", "n_spans") == [("x", 300, 1), ("y", 300, 1), (None, 0, 0)]
