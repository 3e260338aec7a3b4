import zlib
from collections import Counter

import pytest

from tests.llm.conftest import collected
from tidemark.llm import sharding


@pytest.mark.parametrize("n", [0, 1, 39, 40, 41, 1000])
def test_shards(documents, n):
    rows = [(k, f"text {k % 17}", "en", None if k % 11 == 0 else f"s{min(k % 9, 3)}") for k in range(n)]
    out = sharding.interleave(documents(rows)).collect()
    assert sorted(r.doc_id for r in out) == list(range(n))
    size = Counter(r.shard for r in out)
    assert not n or max(size.values()) - min(size.get(s, 0) for s in range(40)) <= 1
    for s in size:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(size[s]))
    total = Counter(r.source for r in out)
    for (shard, source), k in Counter((r.shard, r.source) for r in out).items():
        assert abs(k - total[source] * size[shard] / n) < 2.5, (shard, source)
    for r in out:
        text = f"text {r.doc_id % 17}".encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 16, zlib.crc32(text), "rows", None)


def test_same_whatever_the_partitions(documents):
    rows = [(k, f"t{k}", "en", f"s{k % 3}") for k in range(300)]
    columns = ("doc_id", "shard", "slot")
    assert collected(sharding.interleave(documents(rows).repartition(7)), *columns) == collected(sharding.interleave(documents(rows[::-1]).coalesce(1)), *columns)


def test_odd_rows(documents, odd):
    out = sharding.interleave(documents(odd), shards=4).collect()
    assert len(out) == len(odd) and sorted(Counter(r.shard for r in out).values()) == [3, 4, 4, 4]
    null = [r for r in out if r.doc_id == 1]
    assert (null[0].size, null[0].text_crc32) == (16, 0)


def test_no_python_on_the_way(documents):
    plan = sharding.interleave(documents([(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_no_source_is_another_than_odd_ones(spark, documents):
    rows = [(k, f"t{k}", "en", s) for k, s in enumerate([None, "\x00", "", "="] * 30)]
    got = {r.doc_id: r.source for r in sharding.interleave(documents(rows), shards=4).collect()}
    assert got == {k: s for k, _, _, s in rows}
    shards = sharding.interleave(documents(rows), shards=4).groupBy("shard", "source").count().collect()
    assert all(7 <= r["count"] <= 8 for r in shards)
