import re

import numpy as np
import pytest

from tests.llm.conftest import collected, words
from tests.llm.test_repeats import thue_morse
from tidemark.llm import neardup
from tidemark.llm import textcore as tc
from tidemark.llm.shared import Scratch


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    ids = sorted({i for i, _ in sets if i is not None})
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= 85 * len(s | t):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    out = []
    for i, s in sets:
        c = None if i is None else find(i)
        out.append((i, len(s), c, i is None or i == c))
    return sorted(out, key=lambda r: tuple((v is None, v) for v in r))


COLUMNS = ("doc_id", "n_shingles", "component_id", "kept")


def near(rng, base, edits):
    w = list(base)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return w


def test_links_as_brute_force(documents, rng):
    rows, k = [], 0
    for _ in range(12):
        base = words(rng, rng.choice([8, 30, 120, 300]), 5000)
        for _ in range(6):
            rows.append((1000 - k, " ".join(near(rng, base, rng.randrange(0, max(2, len(base) // 25))))))
            k += 1
    base = words(rng, 200, 5000)  # a chain: neighbours are linked, ends are not
    for _ in range(8):
        rows.append((k, " ".join(base)))
        base = near(rng, base, 2)
        k += 1
    assert collected(neardup.near_duplicates(documents(rows)), *COLUMNS) == brute(rows)


def test_odd_rows(documents, odd):
    assert collected(neardup.near_duplicates(documents(odd)), *COLUMNS) == brute(odd)


def test_empty_table(documents):
    assert neardup.near_duplicates(documents([])).collect() == []


def test_threshold_is_exact(documents):
    a = [f"a{k}" for k in range(104)]  # 100 shingles
    assert brute([(1, " ".join(a)), (2, " ".join(a[:89]))])[1][2] == 1  # 85 of 100
    assert brute([(1, " ".join(a)), (2, " ".join(a[:88]))])[1][2] == 2  # 84 of 100
    for n in (89, 88):
        rows = [(1, " ".join(a)), (2, " ".join(a[:n]))]
        assert collected(neardup.near_duplicates(documents(rows)), *COLUMNS) == brute(rows)


def test_blocks_of_a_large_bucket(documents, rng, monkeypatch):
    """Many texts that resemble each other without links: blocks of the bucket are compared pairwise."""
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 8)
    base = words(rng, 60, 5000)
    rows = [(k, " ".join(near(rng, base, 1 + k % 2))) for k in range(40)]
    assert collected(neardup.near_duplicates(documents(rows)), *COLUMNS) == brute(rows)


def elements(rng, n):
    return np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)


def test_registers_merge(rng):
    a, b = elements(rng, 40), elements(rng, 700)
    both = np.unique(np.concatenate([a, b]))
    assert (np.maximum(neardup.registers(a), neardup.registers(b)) == neardup.registers(both)).all()


@pytest.mark.parametrize("shared", [0.5, 0.85, 0.95])
def test_estimate(rng, shared):
    found = []
    for _ in range(30):
        n = 400
        common = elements(rng, int(n * shared))
        rest = (n - len(common)) // 2
        x, y = np.concatenate([common, elements(rng, rest)]), np.concatenate([common, elements(rng, n - len(common) - rest)])
        r, s = neardup.registers(np.unique(x)), neardup.registers(np.unique(y))
        found.append(neardup.estimate(np.array([(r > s).sum()]), np.array([(r < s).sum()]), len(r), np.array([float(len(x))]), np.array([float(len(y))]))[0])
    assert abs(np.mean(found) - shared) < 0.03


def test_windows_of_words():
    h = np.arange(100, dtype=np.uint64)
    names = tc.Names(tc.mix(np.concatenate([h, h])), tc.mix(np.concatenate([h, h]), 1))
    for size in (1, 2, 5, 20):
        for w in tc.windows(names, size):
            assert len(w) == 201 - size and (w[:50] == w[100:150])[: 101 - size].all() and len(np.unique(w)) == 100


def test_words_that_polynomial_hashes_confuse(documents):
    x, y = thue_morse(10)
    rows = [(1, " ".join([x] * 9)), (2, " ".join([y] * 9)), (3, " ".join([x, y] * 5)), (4, " ".join([y, x] * 5)), (5, x), (6, y), (7, x[:60]), (8, y[:60])]
    assert collected(neardup.near_duplicates(documents(rows)), *COLUMNS) == brute(rows)


def test_links_are_confirmed_on_words(rng):
    a = words(rng, 104, 10**6)
    for n in (89, 88):
        x, y = (" ".join(w).encode() for w in (a, a[:n]))
        assert neardup._exactly(x, y, 5, 85, 100) == (n == 89)
    assert neardup._exactly(b"a b", b" a  b", 5, 85, 100) and not neardup._exactly(b"a b", b"b a", 5, 85, 100)


@pytest.mark.parametrize("turn", [1, -1])
def test_components_of_a_path_take_few_rounds(spark, turn):
    n = 512
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, n)][::turn], "a long, b long")
    scratch = Scratch(spark)
    assert sorted(map(tuple, neardup.components(edges, scratch).collect())) == [(k, 1) for k in range(1, n + 1)]
    assert scratch._n < 40


def test_components_as_brute_force(spark, rng):
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)]
    root = list(range(120))
    for _ in range(120):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    found = neardup.components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark))
    linked = {k for a, b in pairs if a != b for k in (a, b)}
    assert sorted(map(tuple, found.collect())) == sorted((k, root[k]) for k in linked)
    assert neardup.components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).collect() == []


def test_a_frequent_set_is_spread(documents, rng):
    """A third of the rows are copies: the class is broadcast, the others are joined, and all rows are there once."""
    rows = [(k, " ".join(words(rng, 30, 10**6))) for k in range(40)]
    rows += [(100 + k, rows[7][1]) for k in range(20)]
    assert collected(neardup.near_duplicates(documents(rows)), *COLUMNS) == brute(rows)
