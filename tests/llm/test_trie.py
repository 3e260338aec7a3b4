import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tidemark.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, node string, id long"
EMPTY = hashlib.sha256(b"").hexdigest()


def name(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def by_hand(rows, shared=True):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append(((turn is not None, turn or 0), name(role or "", text or ""), (role or "", text or "")))
    own = {c: [t for *_, t in sorted(ts)] for c, ts in convs.items()}
    seq = dict(own)
    if shared:
        for c in own:
            h = zlib.crc32(str(c).encode()) % 6
            base = c - (c % 100 if c >= 0 else -(-c % 100))
            seq[c] = own.get(base, [])[:h] + own[c][h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in seq.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(cs) - 1) * len(p[-1][1]) if p else 0
    return sorted(
        ((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest() if ends[p] else EMPTY) for p, cs in members.items()),
        key=repr,
    )


def nodes(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in trie.prefix_trie(df, **more).collect()), key=repr)


def random_rows(rng, convs, vocabulary=3, longest=9):
    return [(c, t, rng.choice(["user", "assistant"]), "x" * rng.randrange(vocabulary)) for c in convs for t in range(rng.randrange(1, longest))]


@pytest.mark.parametrize("local_turns", [1, 40, 1000])
def test_random_conversations(spark, local_turns):
    rng = random.Random(local_turns)
    rows = random_rows(rng, [*range(60), *range(100, 120), *range(330, 345), 1000, -5, -120])
    rng.shuffle(rows)
    assert nodes(spark, rows, local_turns=local_turns) == by_hand(rows)
    assert nodes(spark, rows, shared=False, local_turns=local_turns) == by_hand(rows, shared=False)


def test_copies_nulls_ties_and_long_conversations(spark):
    rows = [(c, t, "user", f"common {t}") for c in range(200, 260) for t in range(3)]
    rows += [(c, t, "assistant", "é😀" * t) for c in (1, 2) for t in range(400)]  # far too long for its neighbours
    rows += [(3, None, None, None), (3, 0, None, ""), (3, 0, "", None), (3, 1, "b", "tie"), (3, 1, "a", "tie"), (3, 1, "a", "tie"), (None, 0, "user", "no id")]
    rows += [(7, 0, "user", "only one"), (9, 0, "user", "y" * 300_000)]
    for shared in (True, False):
        assert nodes(spark, rows, shared=shared, local_turns=50) == by_hand(rows, shared)


def test_many_copies_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 20)
    rows = [(c, t, "user", f"t{t}") for c in range(100) for t in range(7)]
    assert nodes(spark, rows, shared=False) == by_hand(rows, shared=False)


def test_no_conversations_and_turnless_ones(spark):
    assert nodes(spark, []) == []
    assert nodes(spark, [(None, 0, "user", "x")]) == []
    one = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 2)
    rows = [(one, 0, "user", "taken over by nothing")]
    assert nodes(spark, rows) == by_hand(rows) == [(one, 0, None, 1, 0, 1, 0, hashlib.sha256(str(one).encode()).hexdigest())]


def test_a_conversation_over_several_ranges(spark):
    rows = [(1, t, "user", str(t % 3)) for t in range(500)] + [(0, t, "user", str(t)) for t in range(6)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert nodes(spark, rows, shared=False, local_turns=10) == by_hand(rows, shared=False)
        assert nodes(spark, rows, local_turns=10) == by_hand(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_quicksort_of_one_bucket():
    rng = random.Random(2)
    classes = {tuple(rng.randrange(3) for _ in range(rng.randrange(1, 7))) for _ in range(200)}
    classes = [(k, 1, [9, *c], [1] * (len(c) + 1)) for k, c in enumerate(sorted(classes))]
    found = trie.solve(trie.Bucket(0, 1, classes))
    assert len(found) == len({tuple(ids[:d]) for _, _, ids, _ in classes for d in range(1, len(ids) + 1)})
    top = found[0]
    assert top[3] == len(classes) and top[5] == sum(n[4] == 0 for n in found) and top[-1] == 1
