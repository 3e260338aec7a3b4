"""GIF as a column: encode bytes as frames, decode LZW streams, composite, histogram.

Frames follow the public GIF89a format: palettes (global or local), graphic control blocks
(delay, disposal, transparency), LZW code streams in sub-blocks, interlacing.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import Scratch, workers_can_import

WIDTH = 64
FRAME_ROWS = 64  # 4096 samples in a frame
FULL = 4096  # codes of 12 bits
MOST_PIXELS = 1 << 24  # of a canvas or an image; larger ones are not decoded


class Frame(NamedTuple):
    """A composited frame: RGB canvas, delay in hundredths of a second, and the decoded samples."""

    canvas: np.ndarray
    delay: int
    samples: np.ndarray


def _widths(minimum: int) -> np.ndarray:
    """Bits of the codes that follow a clear code: entry 2**minimum + 2 + k exists once code k + 1 is read."""
    entries = (1 << minimum) + 1 + np.arange(FULL + 64)
    return np.clip(np.floor(np.log2(entries)).astype(np.int64) + 1, minimum + 1, 12)


_W8 = np.concatenate([[9], _widths(8)])  # the clear code first
_AT8 = np.cumsum(_W8) - _W8
SLOTS = 4096


def lzw_encode_many(images: list[bytes], lanes: int = 1024) -> list[bytes]:
    """Code streams of images of at most 4096 8-bit samples each, all walked in step.

    Each image is a lane with a direct-mapped table of (prefix, sample) -> code. Where a slot
    is taken the string simply ends there, which any decoder follows.
    """
    out: list[bytes] = [b""] * len(images)
    order = sorted(range(len(images)), key=lambda k: -len(images[k]))
    for lo in range(0, len(order), lanes):
        part = order[lo : lo + lanes]
        size = np.array([len(images[k]) for k in part])
        if size[0] > 4096:
            raise ValueError("at most 4096 samples")
        wide = np.zeros((len(part), int(size[0]) or 1), np.uint8)
        for r, k in enumerate(part):
            wide[r, : size[r]] = np.frombuffer(images[k], np.uint8)
        columns = np.ascontiguousarray(wide.T).astype(np.int32)
        active = np.searchsorted(-size, -np.arange(len(columns)), side="left")  # lanes longer than t
        keys, values = np.full(len(part) * SLOTS, -1, np.int32), np.zeros(len(part) * SLOTS, np.int32)
        base = np.arange(len(part), dtype=np.int32) * SLOTS
        codes, n = np.zeros((len(part), len(columns) + 1), np.int32), np.zeros(len(part), np.int32)
        prefix = columns[0].copy()
        for t in range(1, len(columns)):
            a = int(active[t])
            sample, p = columns[t, :a], prefix[:a]
            key = (p << 8) | sample
            slot = base[:a] + (((key * np.int32(40503)) >> 5) & np.int32(SLOTS - 1))
            hit = keys[slot] == key
            ends = np.flatnonzero(~hit)
            codes[ends, n[ends]] = p[ends]
            entry = n[ends] + 258
            room = entry < FULL
            keys[slot[ends[room]]], values[slot[ends[room]]] = key[ends[room]], entry[room]
            n[ends] += 1
            prefix[:a] = np.where(hit, values[slot], sample)
        some = np.flatnonzero(size > 0)
        codes[some, n[some]] = prefix[some]
        n[some] += 1
        for r, k in enumerate(part):
            run = np.concatenate([[256], codes[r, : n[r]], [257]])
            out[k] = _pack(run, _AT8[: len(run)], int(_AT8[len(run) - 1] + _W8[len(run) - 1]))
    return out


def _pack(codes: np.ndarray, first: np.ndarray, total: int) -> bytes:
    """Codes at the given bits, least significant bit first; they never overlap, so adding is joining."""
    size = (total + 7) // 8 + 3
    wide = codes.astype(np.int64) << (first & 7)  # 19 bits at most
    at = first >> 3
    out = np.zeros(size, np.float64)
    for k in range(3):
        out += np.bincount(at + k, (wide >> (8 * k)) & 255, size)
    return out[: (total + 7) // 8].astype(np.uint8).tobytes()


def _decode_run(data: bytes, limit: int) -> bytes | None:
    """Samples of an 8-bit stream that has one clear code, at its start; None for any other.

    The string of code 258 + j is the output of code j and the sample after it. So lengths
    follow from those of earlier codes, and every sample is a literal or a copy of an earlier
    one; both are resolved by following references for all codes and samples at once.
    """
    bits = 8 * len(data)
    n = int(np.searchsorted(_AT8 + _W8, bits, side="right"))
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    at = _AT8[:n] >> 3
    codes = ((raw[at] | raw[at + 1] << 8 | raw[at + 2] << 16) >> (_AT8[:n] & 7)) & ((1 << _W8[:n]) - 1)
    marks = np.flatnonzero((codes == 256) | (codes == 257))
    if len(marks) < 2 or marks[0] != 0 or codes[0] != 256 or codes[marks[1]] != 257:
        return None
    codes = codes[1 : marks[1]]
    n = len(codes)
    if not n:
        return b""
    literal = codes < 256
    source = np.where(literal, 0, codes - 258)
    if (source > np.arange(n) - 1)[~literal].any() or (codes[~literal] >= FULL).any():
        return None
    hop = np.where(literal, 0, 1)
    to = np.where(literal, np.arange(n), source)
    while True:
        further = hop + hop[to]
        if (further == hop).all():
            break
        hop, to = further, to[to]
    size = hop + 1
    end = np.cumsum(size)
    start = end - size
    total = int(end[-1])
    origin = np.repeat(np.where(literal, 0, start[source] - start), size) + np.arange(total)
    sample = np.repeat(codes, size).astype(np.uint8)
    while True:
        further = origin[origin]
        if (further == origin).all():
            break
        origin = further
    return sample[origin].tobytes()[:limit]


def lzw_decode(data: bytes, minimum: int, limit: int) -> bytes:
    """At most ``limit`` samples of a code stream; a broken or early end gives what came before."""
    if minimum == 8 and (out := _decode_run(data, limit)) is not None:
        return out
    clear, stop = 1 << minimum, (1 << minimum) + 1
    base = [bytes([k]) for k in range(clear)] + [b"", b""]
    table, out, got = base.copy(), [], 0
    width, bits, held, at, n = minimum + 1, 0, 0, 0, len(data)
    grow = 1 << width
    previous: bytes | None = None
    append, emit = table.append, out.append
    size = len(table)
    while got < limit:
        while held < width:
            if at >= n:
                return b"".join(out)[:limit]
            chunk = data[at : at + 6]
            bits |= int.from_bytes(chunk, "little") << held
            held += 8 * len(chunk)
            at += 6
        code = bits & (grow - 1)
        bits >>= width
        held -= width
        if code < size and code != clear and code != stop:
            entry = table[code]
        elif code == clear:
            table = base.copy()
            append = table.append
            width, size, previous = minimum + 1, len(base), None
            grow = 1 << width
            continue
        elif code == stop or previous is None or code > size or size >= FULL:
            break
        else:
            entry = previous + previous[:1]
        emit(entry)
        got += len(entry)
        if previous is not None and size < FULL:
            append(previous + entry[:1])
            size += 1
            if size == grow and width < 12:
                width += 1
                grow <<= 1
        previous = entry
    return b"".join(out)[:limit]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[k : k + 255])]) + data[k : k + 255] for k in range(0, len(data), 255)) + b"\0"


def encode_many(payloads: list[bytes], delay: int = 10) -> list[bytes]:
    """GIFs whose frames of 64 x 64 (the last may be lower) hold the bytes of a payload, a positive
    multiple of 64, as 8-bit samples in a palette of grays. Black is transparent and each frame is
    cleared to the background before the next, so what is composited is the frame alone."""
    step = WIDTH * FRAME_ROWS
    images = [p[k : k + step] for p in payloads for k in range(0, len(p), step)]
    streams = iter(lzw_encode_many(images))
    gray = bytes(v for k in range(256) for v in (k, k, k))
    made = []
    for p in payloads:
        out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(len(p) // WIDTH, FRAME_ROWS), 0xF7, 0, 0), gray]
        for k in range(0, len(p), step):
            out += [b"\x21\xf9\x04", struct.pack("<BHB", 2 << 2 | 1, delay, 0), b"\0", b"\x2c", struct.pack("<HHHHB", 0, 0, WIDTH, min(len(p) - k, step) // WIDTH, 0)]
            out += [b"\x08", _blocks(next(streams))]
        made.append(b"".join([*out, b"\x3b"]))
    return made


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(data) and data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def _deinterlaced(samples: np.ndarray) -> np.ndarray:
    n = len(samples)
    out = np.empty_like(samples)
    out[np.concatenate([np.arange(0, n, 8), np.arange(4, n, 8), np.arange(2, n, 4), np.arange(1, n, 2)])] = samples
    return out


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    """The colours of a palette that the flags announce, and where it ends; None if there is none, or not all of it."""
    n = 3 * (2 << (flags & 7)) if flags & 0x80 else 0
    part = data[at : at + n]
    return (np.frombuffer(part, np.uint8).reshape(-1, 3) if n and len(part) == n else None), at + n


def frames(data: bytes):
    """Frames of a GIF, one after the other.

    ValueError: not a GIF, or a canvas of more than ``MOST_PIXELS``. A broken end, an image
    that large, or a code size beyond 8 bits gives the frames before it.
    """
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags, background, _ = struct.unpack("<HHBBB", data[6:13])
    if width * height > MOST_PIXELS:
        raise ValueError("too large")
    table, at = _palette(data, 13, flags)
    canvas = np.zeros((height, width, 3), np.uint8)
    delay, disposal, transparent = 0, 0, None
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            if at + 1 >= len(data):
                return
            label = data[at + 1]
            body, at = _sub_blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                delay, disposal, transparent = struct.unpack("<H", body[1:3])[0], body[0] >> 2 & 7, body[3] if body[0] & 1 else None
            continue
        if data[at] != 0x2C or at + 11 > len(data):
            return
        left, top, w, h, flags = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        at += 10
        palette, at = _palette(data, at, flags) if flags & 0x80 else (table, at)
        minimum = data[at] if at < len(data) else 0
        if palette is None or not 1 <= minimum <= 8 or w * h > MOST_PIXELS:
            return
        stream, at = _sub_blocks(data, at + 1)
        raw = lzw_decode(stream, minimum, w * h)
        if len(raw) < w * h:
            return
        samples = np.frombuffer(raw, np.uint8).reshape(h, w)
        if flags & 0x40:
            samples = _deinterlaced(samples)
        before = canvas.copy() if disposal == 3 else None
        part = canvas[top : top + h, left : left + w]
        seen = samples[: part.shape[0], : part.shape[1]]
        colours = palette[np.minimum(seen, len(palette) - 1)]
        part[...] = colours if transparent is None else np.where((seen != transparent)[..., None], colours, part)
        yield Frame(canvas.copy(), delay, samples)
        if disposal == 2:
            canvas[top : top + h, left : left + w] = 0
        elif disposal == 3:
            canvas = before
        delay, disposal, transparent = 0, 0, None


def histogram(pixels: np.ndarray) -> list[int]:
    """Pixels in each of 64 colours: two bits of red, green and blue."""
    q = pixels.reshape(-1, 3) >> 6
    return np.bincount((q[:, 0].astype(np.int64) << 4) | (q[:, 1] << 2) | q[:, 2], minlength=64).tolist()


FRAME_SCHEMA = "id long, frame int, width int, height int, start_ms long, delay_ms int, histogram array<long>, pixels binary"


def _frame_rows(batches):
    for batch in batches:
        for key, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows, start = [], 0
            try:
                for k, f in enumerate(frames(media or b"")):
                    h, w = f.canvas.shape[:2]
                    rows.append((key, k, w, h, start, f.delay * 10, histogram(f.canvas), f.canvas.tobytes()))
                    start += f.delay * 10
            except ValueError:
                pass
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["id", "frame", "width", "height", "start_ms", "delay_ms", "histogram", "pixels"])


def decode_frames(media: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """A row for each frame of each GIF, composited and timed.

    Nulls, what is no GIF, and canvases of more than ``MOST_PIXELS`` give none; a GIF that
    breaks off gives the frames before that.
    """
    workers_can_import(media.sparkSession)
    return media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media")).mapInArrow(_frame_rows, FRAME_SCHEMA)


def _store(batches):
    for batch in batches:
        ids, texts, lo = batch.column(0), batch.column(1), 0
        while lo < len(ids):
            payloads, n, held = [], [], 0
            while lo + len(n) < len(ids) and held < 1 << 23:
                data = (texts[lo + len(n)].as_py() or "").encode()
                n.append(len(data))
                payloads.append(data.ljust(max(64, -(-len(data) // 64) * 64), b"\0"))
                held += len(payloads[-1])
            yield pa.RecordBatch.from_arrays([ids.slice(lo, len(n)), pa.array(n, pa.int64()), pa.array(encode_many(payloads), pa.binary())], ["row_id", "n_bytes", "media"])
            lo += len(n)


_TIMED = "uid long, n_bytes long, media_bytes long, media_sha256 string, frame int, start_ms long, delay_ms long, n_samples long, payload_sha256 string, tail_crc32 long, histogram array<long>"
_TIMED_KINDS = [pa.string() if f.endswith("string") else pa.list_(pa.int64()) if "array" in f else pa.int32() if f.endswith(" int") else pa.int64() for f in _TIMED.split(", ")]


def _timed(batches):
    """A row for each frame of (row_id, uid, n_bytes, media); the last frame's also has the digest of all samples. A GIF without a frame gives a row without one."""
    names = ["row_id", *(f.split()[0] for f in _TIMED.split(", "))]
    for batch in batches:
        for k in range(batch.num_rows):
            row_id, uid, n_bytes, data = batch.column(0).slice(k, 1), *(batch.column(c)[k].as_py() for c in (1, 2, 3))
            digest, tail, start, rows = hashlib.sha256(), b"", 0, []
            about = (uid, n_bytes, len(data), hashlib.sha256(data).hexdigest())
            for n, f in enumerate(frames(data)):
                raw = f.samples.tobytes()
                digest.update(raw)
                tail = raw[-64:]
                rows.append([*about, n, start, 10 * f.delay, len(raw), None, None, histogram(f.canvas[: len(f.samples)])])
                start += 10 * f.delay
            rows = rows or [[*about, None, None, None, 0, None, None, [0] * 64]]
            rows[-1][8:10] = digest.hexdigest(), zlib.crc32(tail)
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TIMED_KINDS, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([row_id] * len(rows)), *columns], names)


def texts_to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and media: each text's UTF-8 bytes, zero-padded to a positive multiple of 64, as a GIF.

    Null texts are empty. Rows are independent; repeated rows give repeated results.
    """
    workers_can_import(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("text")).mapInArrow(_store, f"row_id {kind}, n_bytes long, media binary").withColumnRenamed("row_id", id_col)


def timed_frames(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row for each frame of each GIF of (id, n_bytes, media): uid, the media's size and digest, frame, start_ms, delay_ms, n_samples, and a histogram of the composited canvas."""
    kind = dict(media.dtypes)[id_col]
    rows = media.select(F.col(id_col).alias("row_id"), F.monotonically_increasing_id().alias("uid"), "n_bytes", "media")
    return rows.mapInArrow(_timed, f"row_id {kind}, {_TIMED}").withColumnRenamed("row_id", id_col)


def frame_features(timed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Describe each media by its frames: payload digests, stored form, each frame's time, histogram of all frames. Frames of a media are summed in Spark."""
    bins = F.array(*(F.sum(F.get("histogram", F.lit(k))) for k in range(64)))
    by_media = timed.groupBy("uid").agg(
        F.first(id_col).alias(id_col), F.first("n_bytes").alias("n_bytes"), F.sum("n_samples").alias("payload_bytes"), F.max("payload_sha256").alias("payload_sha256"), F.max("tail_crc32").alias("tail_crc32"),
        F.first("media_bytes").alias("media_bytes"), F.first("media_sha256").alias("media_sha256"), F.sort_array(F.collect_list(F.when(F.col("frame").isNotNull(), F.struct("frame", "start_ms", "delay_ms")))).alias("times"), bins.alias("histogram"),
    )
    total = F.aggregate("times", F.lit(0).cast("long"), lambda s, t: s + t["delay_ms"])
    grays = F.concat_ws("-", *(F.get("histogram", F.lit(k)).cast("string") for k in (0, 21, 42, 63)))
    feature = F.concat(F.lit("frames="), F.size("times").cast("string"), F.lit(";ms="), total.cast("string"), F.lit(";hist="), grays)
    return by_media.select(id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), F.col("times.start_ms").alias("start_ms"), F.col("times.delay_ms").alias("delay_ms"), "histogram")


def media_features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``frame_features`` of GIFs whose frames are first written to the shared folder as a table, and read from there. Rows come in no order."""
    return frame_features(Scratch(media.sparkSession).keep(timed_frames(media, id_col), "frames"), id_col)


def stored_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``media_features`` of texts whose GIFs are themselves first written to the shared folder."""
    media = Scratch(docs.sparkSession).keep(texts_to_media(docs, id_col, text_col), "media")
    return media_features(media, id_col)
