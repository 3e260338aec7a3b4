import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import words
from tests.llm.test_neardup import brute as brute_components
from tests.llm.test_packing import check
from tests.llm.test_quality import brute as brute_quality
from tests.llm.test_repeats import brute_words
from tidemark.llm import packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, kept[-1], SF).write.parquet(path)
        kept.append(spark.read.parquet(path))
    return kept


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_quality(stages):
    failed = {r[0] for r in brute_quality(rows(stages[0])) if r[-1]}
    left = {i for i, _ in rows(stages[1])}
    assert not failed & left
    assert len(left) >= 0.98 * (stages[0].count() - len(failed))


def test_language(stages):
    assert {i for i, _ in rows(stages[2])} <= {i for i, _ in rows(stages[1])} and stages[2].count() >= 0.98 * stages[1].count()


def test_one_of_each_group(stages):
    assert sorted(i for i, _ in rows(stages[3])) == sorted(r[0] for r in brute_components(rows(stages[2])) if r[3])


def test_substrings(stages):
    import hashlib

    want = {i: sha for i, n, gone, sha in brute_words(rows(stages[3]), 50) if n > gone or not gone}
    assert {i: hashlib.sha256(b" ".join(t.encode().split())).hexdigest() for i, t in rows(stages[4])} == want


def test_packed(spark, stages):
    check(stages[5].collect(), rows(stages[4]), packing.SEQUENCE)


def test_run_gives_the_stages(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages[5].collect()))


def test_odd_rows(spark, documents, odd, rng):
    good = [(200 + k, " ".join(words(rng, 80)), "en", "s") for k in range(10)]
    docs = documents([*odd, *good, good[0], (None, good[1][1], None, None)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert {k for k in range(200, 210)} <= {r.doc_id for r in out.collect()}
        assert stage(spark, docs.limit(0), SF).collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()


def test_columns_with_names_used_inside(spark, documents, rng):
    docs = documents([(200 + k, " ".join(words(rng, 80)), "en", "s") for k in range(12)])
    names = "row row_0 doc mark kept found foundlang_pred foundscore __row __kept __lang_pred hash nats lang_pred kept_text uid_0 key a b".split()
    for k, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(k))
    want = sorted(map(tuple, docs.collect()))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == want
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= 12
