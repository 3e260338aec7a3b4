import math
import random
import re
from collections import Counter

import pytest

from tidemark.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall((text or "").translate({k: k + 32 for k in range(65, 91)}))


def by_hand(docs, items, k=10):
    sizes = [(d, Counter(terms(t))) for d, t in docs]
    sizes = [(d, c, sum(c.values())) for d, c in sizes if c]
    n_docs, total = len(sizes), sum(n for *_, n in sizes)
    df = Counter(t for _, c, _ in sizes for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, n in sizes:
            m = 25 + 75 * n * n_docs // total
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in Counter(terms(text)).items() if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, rank, None if none else d, -score) for rank, (score, none, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, **more):
    d = spark.createDataFrame([(a, b, 1, "x", 7) for a, b in docs], "doc_id long, text string, rank int, item string, segment long").repartition(3)
    q = spark.createDataFrame([(a, b, 2) for a, b in items], "item_id long, text string, score int")
    return sorted((tuple(r) for r in lexical.search(d, q, **more).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize("segment_docs", [7, 300, 100_000])
def test_random_documents(spark, segment_docs):
    rng = random.Random(5)
    text = lambda n, v: " ".join(f"w{int(rng.paretovariate(0.6)) % v}" for _ in range(n))
    docs = [(k, text(rng.randrange(40), 60)) for k in range(900)]
    docs += [(5000 + k, docs[k % 7][1]) for k in range(200)]  # copies: equal scores and bounds
    rng.shuffle(docs)
    items = [(k, text(rng.randrange(1, 12), 60)) for k in range(25)] + [(99, docs[0][1]), (100, "w1 W1 w1"), (100, "w1 W1 w1"), (101, "unheard of"), (102, None), (None, "w2"), (103, "")]
    assert found(spark, docs, items, segment_docs=segment_docs) == by_hand(docs, items)


def test_odd_rows(spark, odd):
    items = [(1, "One TWO three four"), (2, "same words"), (3, "日本 x"), (4, "long7 long29999 #"), (5, "É é x\x1fy")]
    docs = [r[:2] for r in odd]
    assert found(spark, docs, items) == by_hand(docs, items)
    assert found(spark, docs, items, k=2) == by_hand(docs, items, k=2)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == []
    assert found(spark, [(1, "a")], []) == []
    assert found(spark, [(1, None), (2, " ")], [(1, "a")]) == []


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "QUERY_BYTES", 60)
    docs = [(k, f"w{k % 5} w{k % 3} common") for k in range(50)]
    items = [(k, f"w{k} common common") for k in range(12)]
    assert found(spark, docs, items, segment_docs=8) == by_hand(docs, items)


def test_terms_follow_their_pattern():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(chr(rng.choice([rng.randrange(128), rng.randrange(128, 0x3000)])) for _ in range(20))
        assert [t.decode() for t in lexical.terms_of(text)] == terms(text)


def test_only_promising_ranges_are_opened():
    """One document holds a rare term: nothing but its own path down the tree reaches its score."""
    import numpy as np

    n = 8192
    places = np.array([*range(0, n, 2), 5000], np.int32)
    stats = lexical.Stats(n, 10 * n, np.array([1, 900], np.int64))
    segment = lexical.Segment(np.arange(n), np.full(n, 10), np.array([0, 1]), np.array([0, n // 2, n // 2 + 1]), places, np.ones(n // 2 + 1, np.int64), stats)
    both = lexical.Query(0, 0, [(0, 1), (1, 1)])
    segment.least = [Counted(x) for x in segment.least]
    best = segment.search(both, 1)
    assert best[0][1] == 5000
    assert sum(x.reads for x in segment.least) <= 2 + len(segment.levels)
    assert segment.search(lexical.Query(0, 0, [(0, 1)]), 1, best[0]) == []


class Counted:
    """An array that counts how often it is looked at."""

    def __init__(self, values):
        self.values, self.reads = values, 0

    def __getitem__(self, at):
        self.reads += 1
        return self.values[at]
