import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from tidemark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
WORDS = packing.WordIds(PATH)
PARTS = ["a", "E", "th", " ", "  ", "\n", "\t", "é", "É", "ß", "日本", "😀", "é", "1", "22", "'s", "'RE", "!!", "\x1c", "\x85", "\xa0", " ", "Σ", "ΑΣ", "न", "<|endoftext|>", "\x00", "²", "İ", "ŉ", "ſ", "<|", "½"]


def ids_of(text):
    return WORDS.whole.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]


def test_ids_as_the_library():
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(12)))
        assert list(np.frombuffer(WORDS.encode(text), np.uint16)) == ids_of(text)[:-1]


@pytest.mark.parametrize(("n", "bits"), [(2, 3), (3, 3), (3, 1), (4, 2)])
def test_curve_visits_every_cell_by_single_steps(n, bits):
    points = np.array(list(itertools.product(range(1 << bits), repeat=n)))
    keys = packing.hilbert_keys(points, bits)
    assert sorted(keys) == list(range(len(points)))
    assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def check(out, rows, sequence):
    """Brute force: pieces cover each row's ids once, sequences have no gap and only the last is short."""
    rest = [tuple(ids_of(t)) for _, t in rows]
    pieces = sorted(out, key=lambda r: (r.sequence_id, r.offset))
    place, left = 0, None
    for p in pieces:
        assert (p.sequence_id, p.offset) == divmod(place, sequence) and p.offset + p.length <= sequence
        place += p.length
    docs = {}
    for p in pieces:
        docs.setdefault(p.sequence_id * sequence + p.offset - p.start, []).append(p)
    found = []
    for own in docs.values():
        own.sort(key=lambda p: p.start)
        assert [p.start for p in own] == list(itertools.accumulate([0, *(p.length for p in own)]))[:-1] and sum(p.length for p in own) == own[0].doc_tokens
        match = next(k for k, ids in enumerate(rest) if len(ids) == own[0].doc_tokens and all(zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for p in own))
        rest.pop(match)
        found.append(own[0].doc_id)
    assert not rest and left is None
    assert sorted(map(str, found)) == sorted(str(i) for i, _ in rows)


@pytest.mark.parametrize("sequence", [7, 4096])
def test_every_id_once(documents, odd, sequence):
    rows = odd + [(100 + k, f"document {k % 5} about packing " * (k % 9)) for k in range(40)]
    check(packing.pack(documents(rows), PATH, sequence).collect(), rows, sequence)


def test_neighbours_share_a_sequence(documents):
    rows = [(k, ("sea wind wave ship harbour " if k % 2 else "corn wheat field plough barn ") * 100) for k in range(60)]
    out = packing.pack(documents(rows), PATH).collect()
    for _, own in itertools.groupby(sorted(out, key=lambda r: r.sequence_id), key=lambda r: r.sequence_id):
        assert sum(len({p.doc_id % 2 for p in [q]}) for q in own) >= 1
    order = [p.doc_id % 2 for p in sorted(out, key=lambda r: (r.sequence_id, r.offset))]
    assert sum(a != b for a, b in itertools.pairwise(order)) == 1


def test_empty_table(documents):
    assert packing.pack(documents([]), PATH).collect() == []


def test_other_normalizers_take_the_whole_tokenizer(tmp_path):
    import json
    from array import array

    import public_tokenizers
    from tokenizers import Tokenizer

    from tidemark.llm import packing

    spec = json.loads(open(public_tokenizers.path("word_bpe_49k.json")).read())
    spec["normalizer"] = {"type": "Sequence", "normalizers": [*spec["normalizer"]["normalizers"], {"type": "Replace", "pattern": {"String": "a"}, "content": "b"}, {"type": "StripAccents"}]}
    path = tmp_path / "t.json"
    path.write_text(json.dumps(spec))
    ids, whole = packing.WordIds(str(path)), Tokenizer.from_file(str(path))
    assert not ids.plain
    for text in ("Banana café", "plain words", "a"):
        assert ids.encode(text) == array("H", whole.encode(text, add_special_tokens=False).ids).tobytes()
    assert packing.WordIds(public_tokenizers.path("word_bpe_49k.json")).plain
