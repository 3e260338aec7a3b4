import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from tests.llm.conftest import by_null, collected, words
from tests.llm.test_repeats import thue_morse
from tidemark.llm import quality
from tidemark.llm import textcore as tc
from tidemark.llm.shared import Scratch

COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def brute(rows):
    out = []
    for doc, text in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        often = Counter(windows)
        covered = {k + j for k, g in enumerate(windows) if often[g] > 1 for j in range(3)}
        out.append((doc, len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)))
    return sorted(out, key=by_null)


def test_statistics(documents, odd, rng):
    rows = odd + [(100 + k, "\n".join(" ".join(words(rng, 9, 12 + k)) for _ in range(8)) + "\n#| $x\n#| $x") for k in range(40)]
    assert collected(quality.judge(documents(rows)), *COLUMNS) == brute(rows)
    assert quality.judge(documents([])).collect() == []


class Reference:
    """Modified Kneser-Ney by dictionaries, from the published formulas."""

    def __init__(self, texts, order):
        self.order = order
        counts = [Counter() for _ in range(order + 1)]
        for t in texts:
            for k in range(len(t) - order + 1):
                counts[order][t[k : k + order]] += 1
        for n in range(order - 1, 0, -1):
            for g in counts[n + 1]:
                counts[n][g[1:]] += 1
        self.counts, self.total, self.given, self.d = counts, [], [], [None]
        for n in range(1, order + 1):
            sizes = Counter(counts[n].values())
            n1, n2, n3, n4 = (sizes.get(k, 0) for k in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            self.d.append([min(max(k - (k + 1) * y * b / a, 0.05), k * 0.95) if a else 0.5 * k for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))])
        for n in range(order + 1):
            total, given = defaultdict(int), defaultdict(float)
            for g, c in counts[n].items():
                total[g[:-1]] += c
                given[g[:-1]] += self.d[n][min(c, 3) - 1]
            self.total.append(total)
            self.given.append(given)

    def p(self, g):
        if not g:
            return 1 / 256
        n, ctx = len(g), g[:-1]
        if not self.total[n][ctx]:
            return self.p(g[1:])
        c = self.counts[n].get(g, 0)
        return (max(c - self.d[n][min(c, 3) - 1], 0) if c else 0) / self.total[n][ctx] + self.given[n][ctx] / self.total[n][ctx] * self.p(g[1:])


def test_model_as_by_dictionaries(spark, rng):
    texts = [" ".join(words(rng, 40, 60)) for _ in range(60)] + [None, "", "ab"]
    model = quality.kneser_ney(spark.createDataFrame([(t,) for t in texts], "text string"), Scratch(spark))
    reference = Reference([(t or "").encode() for t in texts], quality.ORDER)
    seen = list(reference.counts[quality.ORDER])[:300] + [b"zzzzz", b"w1 zz", b"w10 w"]
    keys = np.array([int.from_bytes(g, "big") for g in seen])
    assert np.allclose(model.log_probabilities(keys), [math.log(reference.p(g)) for g in seen], atol=1e-9)
    for ctx in (b"w1 w", b" w10", b"qqqq"):
        keys = np.array([int.from_bytes(ctx + bytes([b]), "big") for b in range(256)])
        assert abs(np.exp(model.log_probabilities(keys)).sum() - 1) < 1e-6


def test_ngrams_stay_within_texts():
    chunk = next(tc.chunks(pa.array(["abcdef", "", "gh\tijk", "xyz"])))
    keys, first = quality.packed(chunk, 5)
    assert [k.tobytes()[:5][::-1] for k in keys] == [b"abcde", b"bcdef", b"gh ij", b"h ijk"] and first.tolist() == [0, 2, 2, 4, 4]


def test_bands_reject_what_reads_unlike_its_language(documents, rng):
    rows = [(k, " ".join(words(rng, 120, 300)), "aa", "s") for k in range(200)]
    rows += [(900 + k, "".join(chr(rng.randrange(33, 126)) for _ in range(2500)).replace("a", " ").replace("b", " ").replace("c", " ").replace("d", " ").replace("e", " ").replace("f", " ").replace("g", " ").replace("h", " "), "aa", "s") for k in range(3)]
    out = {r.doc_id: r for r in quality.judge(documents(rows)).collect()}
    assert all(out[k].kept for k in range(200))
    assert not any(out[900 + k].kept for k in range(3)) and not any(out[900 + k].base_failed for k in range(3))


def test_copies_of_one_text_do_not_narrow_the_bands(documents, rng):
    letters = "abcdefghijklmnopqrstuvwxyz"
    lexicon = ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    clean = [(k, " ".join(rng.choice(lexicon) for _ in range(rng.randrange(130, 250))), "aa", "s") for k in range(120)]
    copied = clean[0][1]
    out = {r.doc_id: r.kept for r in quality.judge(documents(clean + [(1000 + k, copied, "aa", "s") for k in range(400)])).collect()}
    assert all(out.values())


def test_model_in_many_files(spark, rng, monkeypatch):
    """Whatever a worker remembers of the files, the probabilities are those of the whole model, and sum to 1."""
    texts = spark.createDataFrame([(" ".join(words(rng, 60, 900)),) for _ in range(80)], "text string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        model = quality.kneser_ney(texts, Scratch(spark))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    files = model.orders[-1][0].files
    assert len(files) > 2 and all(a[2] < b[1] for a, b in zip(files, files[1:]))
    contexts = [b"w1 w", b" w10", b"w99 ", b"zzzz", b"w\x00\xff "]
    keys = np.array([int.from_bytes(c + bytes([b]), "big") for c in contexts for b in range(256)])
    want = model.log_probabilities(keys)
    assert np.allclose(np.exp(want).reshape(len(contexts), 256).sum(axis=1), 1)
    monkeypatch.setattr(quality, "REMEMBERED_BYTES", 1)
    quality._READ.clear()
    assert (model.log_probabilities(keys) == want).all() and len(quality._READ) == 1


def test_verdicts_as_from_bands_by_hand(documents, rng):
    """Bands recomputed from the scores: quartiles over different texts of a language and length, or of the language."""
    rows = []
    for k in range(260):
        lang = ("aa", "bb", None)[k % 3]
        w = words(rng, rng.choice([60, 80, 140, 200, 300]), 300 if lang == "aa" else 90)
        if k % 29 == 0:
            w = [f"{rng.getrandbits(60):x}" for _ in w]
        rows.append((k, " ".join(w), lang, "s"))
    rows += [(1000 + k, rows[4][1], rows[4][2], "s") for k in range(90)]
    found = {r.doc_id: r for r in quality.judge(documents(rows)).collect()}
    groups = defaultdict(dict)
    for doc, text, lang, _ in rows:
        if not found[doc].base_failed:
            groups[lang][text] = groups[lang, int(math.log2(found[doc].n_words))][text] = found[doc].nats

    def band(group):
        q = np.percentile(np.round(np.array(list(group.values())) / quality.STEP), [25, 50, 75]) * quality.STEP
        spread = max((q[2] - q[0]) / 1.349, quality.LEAST_SPREAD)
        return q[1] - quality.BELOW * spread, q[1] + quality.ABOVE * spread

    kept = {}
    for doc, text, lang, _ in rows:
        r = found[doc]
        near = groups[lang, int(math.log2(max(r.n_words, 1)))]
        lower, upper = band(near if len(near) >= quality.LEAST_TEXTS else groups[lang])
        kept[doc] = not r.base_failed and lower <= r.nats <= upper
    assert kept == {d: r.kept for d, r in found.items()}
    assert not all(kept.values()) and sum(kept.values()) > 200


def test_repeated_words_that_polynomial_hashes_confuse(documents):
    x, y = thue_morse(10)
    rows = [(1, " ".join([x, y, y, x, y, x, x, y])), (2, " ".join([x, x, y, y] * 3))]
    assert collected(quality.judge(documents(rows)), *COLUMNS) == brute(rows)


def test_no_language_is_not_an_empty_one(documents, rng):
    rows = [(k, " ".join(words(rng, 80, 300)), None, "s") for k in range(40)] + [(100 + k, " ".join(f"{rng.getrandbits(60):x}" for _ in range(60)), "", "s") for k in range(40)]
    assert all(r.kept for r in quality.judge(documents(rows)).collect())


def test_a_large_model_is_read_once_for_many_chunks(spark, rng, monkeypatch):
    """With a memory of one file each file is opened once for a group of chunks, however many these are; scores stay the same."""
    import pyarrow as pa

    from tidemark.llm import textcore as tc

    texts = [" ".join(words(rng, 60, 900)) for _ in range(60)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        model = quality.kneser_ney(spark.createDataFrame([(t,) for t in texts], "text string"), Scratch(spark))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    monkeypatch.setattr(tc, "CHUNK_BYTES", 300)
    chunks = tc.chunks
    monkeypatch.setattr(tc, "chunks", lambda t: chunks(t, 300))
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + 20)), pa.array(["="] * 20), pa.array([1] * 20), pa.array(texts[k : k + 20])], ["a", "b", "c", "d"]) for k in (0, 20, 40)]
    scores = lambda: [x for b in quality._scores(model, quality.ORDER)(iter(batches)) for x in b.column("nats").to_pylist()]
    want = scores()
    reads, files = [], sum(len(a.files) for pair in model.orders for a in pair)
    read = quality.pq.read_table
    monkeypatch.setattr(quality.pq, "read_table", lambda *a, **k: reads.append(a[0]) or read(*a, **k))
    monkeypatch.setattr(quality, "REMEMBERED_BYTES", 1)
    quality._READ.clear()
    assert np.allclose(scores(), want, rtol=1e-12)
    assert len(reads) <= files and len(reads) == len(set(reads))
