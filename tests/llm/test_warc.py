import hashlib
import random
from collections import defaultdict

import pytest

from tidemark.llm import warc

SCHEMA = "page_id long, url string, html string, file string, offset int, digest string"


def brute(rows):
    groups = defaultdict(list)
    for page, _, html in rows:
        groups[(html or "").encode()].append(page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        known = [p for p in groups[data] if p is not None]
        again = len(data) >= 1000 and page is not None and page != max(known)
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", max(known) if again else None))
    return sorted(out, key=lambda r: tuple((v is None, v) for v in r))


@pytest.fixture
def rows():
    rng = random.Random(5)
    bodies = [None, "", "short", "é" * 499, "é" * 500, "x" * 999, "x" * 1000, "y" * 200_000, "<p>\r\n\r\nWARC/1.1\r\n" * 100]
    urls = [None, "", "http://www.Example.com/a", "https://example.com:8443/b?q=1#f", "no scheme", "http://b.example.org/\nodd", "HTTP://example.com/a"]
    return [(k, rng.choice(urls), rng.choice(bodies)) for k in range(150)] + [(None, None, "x" * 1000), (7, "u", None), (7, "u", None)]


def test_as_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    pages = spark.createDataFrame([(*r, "f", 1, "d") for r in rows], SCHEMA).repartition(5)
    out = warc.archive(pages).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=lambda r: tuple((v is None, v) for v in r))
    assert got == brute(rows)
    text = {p: (h or "").encode() for p, _, h in rows if p is not None}
    assert all(r.payload == text[r.page_id] for r in out if r.record_type == "response" and r.page_id is not None)
    ordered = sorted(out, key=lambda r: (r.range, r.place))
    keys = [(r.urlkey, r.captured, -1 if r.page_id is None else r.page_id) for r in ordered]
    assert keys == sorted(keys)
    assert [r.position for r in ordered] == list(range(len(out)))


def test_ranges_grow_with_the_index(spark, rows, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 10)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    out = warc.archive(spark.createDataFrame([(*r, "f", 1, "d") for r in rows], SCHEMA).repartition(3)).collect()
    assert len({r.range for r in out}) > 8
    ordered = sorted(out, key=lambda r: r.position)
    assert [r.position for r in ordered] == list(range(len(rows)))
    keys = [(r.urlkey, r.captured, -1 if r.page_id is None else r.page_id) for r in ordered]
    assert keys == sorted(keys)


def test_empty_table(spark):
    assert warc.archive(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16, 33])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted(rng.randrange(40) for _ in range(rng.randrange(9))) for _ in range(k)]
    assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_url_keys():
    assert warc.url_key("http://www.Example.com/A?b=C#d") == "com,example)/a?b=c"
    assert warc.url_key("https://user@sub.example.org:8443") == "org,example,sub:8443)/"
    assert warc.url_key(None) == warc.url_key("  ") == "-"
