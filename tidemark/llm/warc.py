"""WARC archives of pages, with revisit records and a globally ordered capture index.

Tasks write archives of bounded size to the shared folder and index each as a run, sorted by
URL key and time. Runs are dealt out by range, and each range merges its slices of all runs
with a tournament tree of losers; ranges one after the other are the index of all captures,
in which every record has its position. Archives are then read back along that index.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import Scratch, join_spread

LEAST_REVISIT = 1000
ARCHIVE_BYTES = 32 << 20
RANGE_ROWS = 100_000  # of the index that one task merges, about
EPOCH_2020 = 1_577_836_800

_INDEX = "urlkey string, captured long, page_id long, record_type string, file string, offset long, length int"
_NAMES = ["urlkey", "captured", "page_id", "record_type", "file", "offset", "length"]
_URL = re.compile(r"^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)(?::(\d*))?([^#]*)", re.IGNORECASE)


def url_key(url: str | None) -> str:
    """Host labels in reverse, then path and query, lower-cased: org,example)/path. Null or blank: '-'."""
    if not url or not url.strip():
        return "-"
    host, port, rest = _URL.match(url.strip()).groups()
    host = host.lower().removeprefix("www.")
    key = ",".join(reversed(host.split(".")))
    if port and port not in ("80", "443"):
        key += f":{port}"
    return f"{key}){rest.lower() or '/'}"


def _date(seconds: int) -> str:
    return str(np.datetime64(seconds, "s")) + "Z"


def _header_text(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, captured: int, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member with a response record, or a revisit record that has headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {_date(captured)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url:
        head.append(f"WARC-Target-URI: {_header_text(url)}")
    body = http + payload
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        body = http
    head.append(f"Content-Length: {len(body)}")
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def _headers(block: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in block.decode("utf-8", "replace").split("\r\n")[1:])}


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a gzip member."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    warc = _headers(head)
    http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    return warc, _headers(http), payload


def _write(root: str):
    def run(batches):
        store, folder = fs.FileSystem.from_uri(root)
        store.create_dir(folder, recursive=True)
        task = TaskContext.get()
        run_rows: list[tuple] = []
        out, size, n = None, 0, 0

        def finished():
            out.close()
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32())
            cols = list(zip(*sorted(run_rows, key=lambda r: (r[0], r[1], -1 if r[2] is None else r[2], r[5])), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], _NAMES)

        for batch in batches:
            for k in range(batch.num_rows):
                page, url, html, digest, refers = (batch.column(c)[k].as_py() for c in range(5))
                if out is None:
                    name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{n:04d}.warc.gz"  # attempts never share a file
                    out, size, n = store.open_output_stream(f"{folder}/{name}", compression=None), 0, n + 1
                captured = EPOCH_2020 + (page or 0) % (1 << 31)
                member = record(page, url, captured, (html or "").encode(), digest, refers)
                out.write(member)
                run_rows.append((url_key(url), captured, page, "response" if refers is None else "revisit", name, size, len(member)))
                size += len(member)
                if size >= ARCHIVE_BYTES:
                    yield finished()
                    out, run_rows[:] = None, []
        if out is not None:
            yield finished()

    return run


class LoserTree:
    """Merge of sorted runs: inner nodes keep the loser of each match, so a step replays one path."""

    def __init__(self, runs: list[Iterator]):
        self.runs = runs
        self.k = len(runs)
        self.heads = [next(r, None) for r in runs]
        self.tree = [-1] * self.k
        for leaf in range(self.k):
            self._play(leaf, first=True)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return x is not None or (y is None and a < b)
        return (x, a) < (y, b)

    def _play(self, leaf: int, first: bool = False) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            rival = self.tree[node]
            if rival < 0 and first:
                self.tree[node] = winner
                return
            if self._beats(rival, winner):
                self.tree[node], winner = winner, rival
            node //= 2
        self.tree[0] = winner

    def __iter__(self):
        while self.k and self.heads[winner := self.tree[0]] is not None:
            yield self.heads[winner]
            self.heads[winner] = next(self.runs[winner], None)
            self._play(winner)


def _merge(batches):
    """The rows of one range: its slices of the sorted runs, merged."""
    batches = list(batches)
    if not batches:
        return
    table = pa.Table.from_batches(batches).combine_chunks()
    files = table.column("file").to_pylist()
    pages = table.column("page_id").to_pylist()
    keys = list(zip(table.column("urlkey").to_pylist(), table.column("captured").to_pylist(), [-1 if p is None else p for p in pages], files, table.column("offset").to_pylist(), range(len(files)), strict=True))
    runs: dict[str, list] = {}
    for key in keys:
        runs.setdefault(key[3], []).append(key)
    for run in runs.values():
        if any(a > b for a, b in zip(run, run[1:])):  # a shuffle may hand over blocks in any order
            run.sort()
    order = [key[-1] for key in LoserTree([iter(run) for _, run in sorted(runs.items())])]
    part = TaskContext.get().partitionId()
    merged = table.take(pa.array(order, pa.int64()))
    merged = merged.append_column("range", pa.array([part] * len(order), pa.int32())).append_column("place", pa.array(range(len(order)), pa.int64()))
    yield from merged.to_batches(max_chunksize=10_000)


def merge_index(runs: DataFrame, scratch: Scratch) -> DataFrame:
    """Index rows with range, place in it, and position among all captures, by URL key, time and page.

    ``runs``: rows of sorted runs, one run for each file. One URL's captures may be split
    between ranges, so no URL is too frequent; there are as many ranges as keep each small.
    """
    ranges = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE_ROWS))
    merged = scratch.keep(runs.repartitionByRange(ranges, "urlkey", "captured", "page_id", "file", "offset").mapInArrow(_merge, f"{_INDEX}, range int, place long"), "index")
    sizes = merged.groupBy("range").agg(F.count("*").alias("n"))  # a row for each range
    before = sizes.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return merged.join(before, "range").withColumn("position", F.col("before") + F.col("place")).drop("before")


def _read(root: str):
    def run(batches):
        store, folder = fs.FileSystem.from_uri(root)
        name, data = None, b""
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["file"] != name:
                    name = row["file"]
                    with store.open_input_file(f"{folder}/{name}") as f:
                        data = f.read()
                warc, http, payload = parse(data[row["offset"] : row["offset"] + row["length"]])
                page = warc["warc-record-id"].strip("<>").rpartition(":")[2]
                stated = base64.b32decode(warc["warc-payload-digest"].partition(":")[2]).hex()
                if warc["warc-type"] == "revisit":
                    size, digest, refers, html = int(http["content-length"]), stated, int(warc["warc-refers-to"].strip("<>").rpartition(":")[2]), None
                else:
                    size, digest, refers, html = len(payload), hashlib.sha1(payload).hexdigest(), None, payload
                    if digest != stated:
                        raise ValueError(f"{name}: payload of page {page} differs from its digest")
                out.append((int(page) if page else None, size, digest, warc["warc-type"], refers, warc.get("warc-target-uri"), row["urlkey"], row["captured"], row["range"], row["place"], row["position"], html))
            cols = list(zip(*out, strict=True)) or [()] * 12
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "urlkey", "captured", "range", "place", "position", "payload"])

    return run


def write_archives(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for every row of ``pages`` below ``root``; the runs of the index come back.

    Of rows with equal payloads of at least 1000 bytes, that with the largest id gets a
    response record and the others revisit it. Null payloads are empty; null URLs have the
    key '-'. A row without an id is a response. Rows repeated with one id are all written.
    ``root`` must be a folder that all executors share, in a store that pyarrow opens.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.sha1(F.encode(html, "utf-8")).alias("digest"))
    large = rows.where(F.octet_length("html") >= LEAST_REVISIT).select("page_id", "digest")
    groups = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    revisits = join_spread(large, groups, ["digest"], "n").where("page_id < refers_to").distinct()
    decided = rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")
    return decided.mapInArrow(_write(root), _INDEX)


def read_archives(index: DataFrame, root: str) -> DataFrame:
    """The records that an index names, each archive read once; payload is null for revisits."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, urlkey string, captured long, range int, place long, position long, payload binary"
    return index.repartition("file").sortWithinPartitions("file", "offset").mapInArrow(_read(root), schema)


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write, index and read back ``pages``: a row for each record, with its place in the capture index."""
    scratch = Scratch(pages.sparkSession)
    root = f"{scratch.root}/archives"
    runs = scratch.keep(write_archives(pages, root, id_col, url_col, html_col), "runs")
    return read_archives(merge_index(runs, scratch), root)
