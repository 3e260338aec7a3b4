import math
import re
import zlib
from collections import Counter

import pytest

from tests.llm.conftest import collected
from tidemark.llm import langid

VOCABULARY = {"aa": ["mara", "tolin", "veske", "orna", "lumi"], "bb": ["grutz", "schnak", "dorf", "wirt", "klop"], "cc": ["zoé", "ñandu", "queso", "lliu", "ciao"]}


def corpus(rng, n):
    rows = []
    for k in range(n):
        lang = rng.choice(list(VOCABULARY))
        rows.append((k, " ".join(rng.choice(VOCABULARY[lang]) for _ in range(rng.randrange(3, 30))).capitalize() + ".", lang, "s"))
    return rows


def held_out(doc):
    return zlib.crc32(str(doc).encode()) % 3 == 1


def test_held_out_texts(documents, rng):
    rows = corpus(rng, 300)
    out = langid.identify(documents(rows)).collect()
    assert all(r.held_out == held_out(r.doc_id) for r in out)
    truth = {r[0]: r[2] for r in rows}
    assert all(r.lang_pred == truth[r.doc_id] and 1 / 3 <= r.score <= 1 for r in out)


def test_learns_from_the_others_alone(documents, rng):
    rows = corpus(rng, 200)
    lied = [(d, t, "zz" if held_out(d) else lang, "other") for d, t, lang, _ in rows]
    columns = ("doc_id", "held_out", "lang_pred", "score")
    assert collected(langid.identify(documents(rows)), *columns) == collected(langid.identify(documents(lied)), *columns)


def test_unknown_words_back_off(documents, rng):
    rows = [*corpus(rng, 200), (1000, "schnakdorf grutzwirt", None, None), (1001, "ornalumi", None, None)]
    out = {r.doc_id: r.lang_pred for r in langid.identify(documents(rows)).collect()}
    assert (out[1000], out[1001]) == ("bb", "aa")


def test_odd_rows(documents, odd, rng):
    out = langid.identify(documents(corpus(rng, 60) + odd)).collect()
    assert len(out) == 60 + len(odd)
    found = {}
    for r in out:
        found.setdefault(r.doc_id, (r.lang_pred, r.score))
    shown = langid.identify(documents([(500, "²³ 12 _ !", "aa", "s"), *corpus(rng, 30)])).where("doc_id = 500").collect()
    assert (shown[0].lang_pred, shown[0].score) == (langid.UNKNOWN, 0.0)
    nothing = langid.identify(documents([(1, "some text", None, None), (2, None, "aa", None)])).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {(langid.UNKNOWN, 0.0)}
    assert langid.identify(documents([])).collect() == []


@pytest.mark.parametrize("carry", [False, True])
def test_carried_columns(documents, rng, carry):
    docs = documents(corpus(rng, 30))
    out = langid.identify(docs, carry=carry, prefix="__")
    assert out.columns == [*(docs.columns if carry else ["doc_id"]), "__held_out", "__lang_pred", "__score"]


def test_sample_is_shared_among_languages(spark):
    rows = spark.range(20_000).selectExpr("case when id < 15000 then 'aa' when id < 19900 then 'bb' else concat('l', id % 10) end lang", "'t' text", "xxhash64(id) draw")
    got = {r.lang: r["count"] for r in langid.sampled(rows, 2000).groupBy("lang").count().collect()}
    assert all(got[f"l{k}"] == 10 for k in range(10)) and abs(got["aa"] - 950) < 120 and abs(got["bb"] - 950) < 120
    assert langid.sampled(rows, 100_000).count() == 20_000
    assert langid.sampled(rows.limit(0), 10).collect() == []


def by_hand(rows, text):
    """The scores of a text from counts in dictionaries."""
    counts = {}
    for lang, t in rows:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            for order in range(langid.LONGEST + 1):
                for item in [w] if not order else [f" {w} "[k : k + order] for k in range(len(w) + 3 - order)]:
                    own = counts.setdefault(order, {}).setdefault(lang, Counter())
                    own[item] += 1
    langs = sorted({lang for lang, _ in rows})

    def logs(order, item):
        mass = [sum(counts[order].get(g, {}).values()) + 0.5 * (len(counts[order].get(g, {})) + 1) for g in langs]
        return [math.log((counts[order][g][item] + 0.5) / m) if item in counts[order].get(g, {}) else math.log(0.5 / max(mass)) for g, m in zip(langs, mass)]

    known = lambda order, item: any(item in c for c in counts[order].values())
    sums, found = [0.0] * len(langs), re.findall(r"[^\W\d_]+", text.lower())
    floor = lambda order: math.log(0.5 / max(sum(counts[order].get(g, {}).values()) + 0.5 * (len(counts[order].get(g, {})) + 1) for g in langs))
    for w in found:
        order, items = 0, [w]
        if not known(0, w):
            for order in range(langid.LONGEST, 0, -1):
                items = [g for k in range(len(w) + 3 - order) if known(order, g := f" {w} "[k : k + order])]
                if items:
                    break
        for item in items:
            sums = [s + (v - floor(order)) / len(items) / len(found) for s, v in zip(sums, logs(order, item))]
    best = max(range(len(langs)), key=lambda k: (sums[k], -k))
    return langs[best], 1 / sum(math.exp(s - sums[best]) for s in sums)


def test_scores_as_by_hand(documents, rng, monkeypatch):
    monkeypatch.setattr(langid, "SLICE", 7)
    rows = corpus(rng, 60) + [(500, "mara schnakdorf xqzw tolinveske Zoé", "bb", "s"), (501, "wirtklop lum ñ", None, None)]
    learned = [(lang, t) for d, t, lang, _ in rows if lang and not held_out(d)]
    for r in langid.identify(documents(rows)).collect():
        lang, score = by_hand(learned, next(t for d, t, *_ in rows if d == r.doc_id))
        assert r.lang_pred == lang and abs(r.score - score) < 1e-9


def invented(rng, n):
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(4, 10))) for _ in range(n)]


def test_a_rare_label_takes_no_others(documents, rng):
    common, rare = invented(rng, 3000), invented(rng, 60)
    rows = [(k, " ".join(rng.choice(common) for _ in range(100)), "aa", "s") for k in range(200)]
    ids = [k for k in range(1000, 1100) if not held_out(k)][:1] + [k for k in range(1000, 1100) if held_out(k)][:3]
    rows += [(k, " ".join(rng.sample(rare, 50)), "zz", "s") for k in ids]
    truth = {r[0]: r[2] for r in rows}
    assert all(r.lang_pred == truth[r.doc_id] for r in langid.identify(documents(rows)).collect())


def test_more_than_200_labels(documents, rng):
    rows = []
    for label in range(230):
        lexicon = invented(rng, 8)
        rows += [(label * 10 + k, " ".join(rng.choices(lexicon, k=20)), f"l{label:03d}", "s") for k in range(6)]
    truth, learned = {r[0]: r[2] for r in rows}, {r[2] for r in rows if not held_out(r[0])}
    out = langid.identify(documents(rows)).collect()
    assert len(learned) > 200 and all(r.lang_pred == truth[r.doc_id] for r in out if truth[r.doc_id] in learned)


def test_a_word_has_its_counts_in_all_languages(documents):
    from tidemark.llm.shared import Scratch

    docs = documents([(1, "mara " * 10, "aa"), (2, "dorf " * 10 + "mara " * 5, "bb")])
    model = langid.train(docs.select("lang", "text"), Scratch(docs.sparkSession))
    row = model.items[0]["mara"]
    assert sorted(model.of[model.first[row] : model.first[row + 1]].tolist()) == [0, 1]


def test_sample_has_a_row_of_each_language_and_keeps_its_bounds(spark):
    from pyspark.sql import functions as F

    rows = spark.range(12_000).select((F.col("id") % 4000).cast("string").alias("lang"), F.lit("text").alias("text"), F.xxhash64("id").alias("draw"))
    assert langid.sampled(rows, 2000).groupBy("lang").count().where("count = 1").count() == 4000
    few = rows.withColumn("lang", (F.col("draw") % 2 == 0).cast("string"))
    assert 850 <= langid.sampled(few, 1000).count() <= 1150  # five standard deviations
    long = few.withColumn("text", F.repeat(F.lit("x"), 1000))
    assert 130 <= langid.sampled(long, 1000, 200_000).count() <= 270
