import hashlib
import struct
import zlib

import numpy as np
import pytest

from tidemark.llm import gif


def slow_encode(data, minimum, clear_every=None):
    """Plain LZW with one code at a time; clears the table when it is full, or more often."""
    clear, stop = 1 << minimum, (1 << minimum) + 1
    bits, n = 0, 0

    def put(code, width):
        nonlocal bits, n
        bits |= code << n
        n += width

    table, width = {bytes([k]): k for k in range(clear)}, minimum + 1
    size = stop + 1
    put(clear, width)
    prefix, written = b"", 0
    for k in range(len(data)):
        grown = prefix + data[k : k + 1]
        if grown in table:
            prefix = grown
            continue
        put(table[prefix], width)
        written += 1
        if size < 4096 and not (clear_every and written % clear_every == 0):
            table[grown] = size
            if size == 1 << width and width < 12:
                width += 1
            size += 1
        else:
            put(clear, width)
            table, width, size = {bytes([k]): k for k in range(clear)}, minimum + 1, stop + 1
        prefix = data[k : k + 1]
    if prefix:
        put(table[prefix], width)
        size += 1
        if size - 1 == 1 << width and width < 12:
            width += 1
    put(stop, width)
    return bits.to_bytes((n + 7) // 8, "little")


@pytest.mark.parametrize("alphabet", [1, 2, 30, 256])
@pytest.mark.parametrize("n", [1, 2, 3, 254, 255, 256, 257, 1000, 4096])
def test_round_trip(n, alphabet):
    data = np.random.default_rng(n).integers(0, alphabet, n).astype(np.uint8).tobytes()
    (stream,) = gif.lzw_encode_many([data])
    assert gif.lzw_decode(stream, 8, n) == data


@pytest.mark.parametrize("every", [None, 5, 300])
def test_streams_of_others(every):
    rng = np.random.default_rng(3)
    for minimum, n in ((8, 30_000), (2, 3000), (4, 9000)):
        data = rng.integers(0, 1 << minimum, n).astype(np.uint8).tobytes()
        assert gif.lzw_decode(slow_encode(data, minimum, every), minimum, n) == data


def test_both_decoders_agree(monkeypatch):
    data = (b"the cat sat on the mat " * 200)[:4096]
    (stream,) = gif.lzw_encode_many([data])
    quick = gif._decode_run(stream, len(data))
    monkeypatch.setattr(gif, "_decode_run", lambda *a: None)
    assert gif.lzw_decode(stream, 8, len(data)) == quick == data


def test_broken_streams_end():
    rng = np.random.default_rng(1)
    for n in range(200):
        out = gif.lzw_decode(rng.integers(0, 256, n).astype(np.uint8).tobytes(), 8, 500)
        assert len(out) <= 500


def image(samples, left, top, local=None, disposal=0, transparent=None, delay=5, interlaced=False):
    h, w = samples.shape
    if interlaced:
        samples = samples[[*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]]
    flags = (0x80 | 1 if local else 0) | (0x40 if interlaced else 0)
    control = b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (transparent is not None), delay, transparent or 0) + b"\0"
    return control + b"\x2c" + struct.pack("<HHHHB", left, top, w, h, flags) + (bytes(local) if local else b"") + b"\x02" + gif._blocks(slow_encode(samples.tobytes(), 2))


def animation(*images):
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    return b"GIF89a" + struct.pack("<HHBBB", 4, 8, 0x81, 0, 0) + palette + b"\x21\xfe\x02hi\0" + b"".join(images) + b"\x3b"


def test_disposal_transparency_palettes_and_time(spark):
    full = np.full((8, 4), 1, np.uint8)
    patch = np.array([[2, 3], [3, 2]], np.uint8)
    white = [255] * 12
    rows = np.arange(8, dtype=np.uint8)[:, None].repeat(4, 1) % 4
    data = animation(image(full, 0, 0), image(patch, 1, 1, disposal=3, transparent=3), image(patch, 0, 0, disposal=2), image(patch, 2, 6, local=white), image(rows, 0, 0, interlaced=True))
    media = spark.createDataFrame([(1, bytearray(data)), (2, None), (3, bytearray(b"no gif")), (4, bytearray(data[:40]))], "id long, media binary")
    out = sorted((r for r in gif.decode_frames(media).collect() if r.id == 1), key=lambda r: r.frame)
    canvas = [np.frombuffer(r.pixels, np.uint8).reshape(8, 4, 3) for r in out]
    red, green, blue = [255, 0, 0], [0, 255, 0], [0, 0, 255]
    assert [r.start_ms for r in out] == [0, 50, 100, 150, 200] and [r.delay_ms for r in out] == [50] * 5
    assert (canvas[0] == red).all()
    assert canvas[1][1, 1].tolist() == green and canvas[1][1, 2].tolist() == red  # transparent
    assert canvas[2][1, 2].tolist() == red and canvas[2][0, 1].tolist() == blue  # the one before was put back
    assert canvas[3][0, 0].tolist() == [0, 0, 0] and canvas[3][6, 2].tolist() == [255] * 3  # cleared; own palette
    assert [canvas[4][k, 0].tolist() for k in range(4)] == [[0, 0, 0], red, green, blue]
    assert sum(out[0].histogram) == 32 and out[0].histogram[0b110000] == 32
    assert {r.id for r in gif.decode_frames(media).collect()} == {1}


def test_broken_files_give_the_frames_before(spark):
    rng = np.random.default_rng(2)
    full, white = np.full((8, 4), 1, np.uint8), [255] * 12
    data = animation(image(full, 0, 0), image(full, 0, 0, local=white), image(full, 0, 0, interlaced=True))
    whole = [f.canvas.tobytes() for f in gif.frames(data)]
    for n in range(len(data)):
        try:
            got = [f.canvas.tobytes() for f in gif.frames(data[:n])]
        except ValueError:
            assert n < 13
            continue
        assert got == whole[: len(got)]
    odd = [data[:n] for n in range(0, len(data), 3)]
    for _ in range(400):
        broken = bytearray(data)
        for k in rng.integers(6, len(data), 3):
            broken[k] = rng.integers(0, 256)
        odd.append(bytes(broken))
    odd += [b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0), data[:13] + b"\x21", data[:25] + b"\x2c" + struct.pack("<HHHHB", 0, 0, 65535, 65535, 0) + b"\x08"]
    out = gif.decode_frames(spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate(odd)], "id long, media binary")).collect()
    assert len(out) >= 3 and all(r.width * r.height <= gif.MOST_PIXELS for r in out)


def test_media_are_stored(documents):
    text = "x" * (3 * 4096 + 100)
    (r,) = gif.stored_features(documents([(1, text)])).collect()
    assert r.start_ms == [0, 100, 200, 300] and r.delay_ms == [100] * 4
    assert sum(r.histogram) == r.payload_bytes and r.histogram[21] == len(text)


def feature_by_hand(payload):
    """Frames of 64 x 64 gray samples; black is transparent over a cleared canvas, so black again."""
    images = [payload[k : k + 4096] for k in range(0, len(payload), 4096)]
    gray = [sum(v >> 6 == level for v in payload) for level in range(4)]
    return f"frames={len(images)};ms={100 * len(images)};hist=" + "-".join(map(str, gray))


def test_query(documents, odd):
    out = gif.stored_features(documents(odd).coalesce(1)).collect()
    want = []
    for doc, text in odd:
        data = (text or "").encode()
        payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        (media,) = gif.encode_many([payload])
        want.append((doc, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature_by_hand(payload)))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:8]) for r in out)
    assert gif.media_features(gif.texts_to_media(documents([]))).collect() == []


def test_stored_frames(spark, documents):
    """The table of frames: times, transparency and disposal in use, histograms of what is composited."""
    text = "a\0" * 3000
    media = gif.texts_to_media(documents([(5, text)]))
    raw = media.collect()[0].media
    assert raw.count(b"\x21\xf9\x04\x09") == 2  # cleared to the background, black transparent
    out = sorted(gif.timed_frames(media).collect(), key=lambda r: r.frame)
    assert [(r.doc_id, r.frame, r.start_ms, r.delay_ms, r.n_samples) for r in out] == [(5, 0, 0, 100, 4096), (5, 1, 100, 100, 1920)]
    assert [(r.histogram[0], r.histogram[21]) for r in out] == [(2048, 2048), (1920 - 952, 952)]
    none = spark.createDataFrame([(1, 0, bytearray(b"GIF89a" + bytes(7)))], "doc_id long, n_bytes long, media binary")
    (r,) = gif.media_features(none).collect()
    assert (r.feature, r.payload_bytes, r.start_ms) == ("frames=0;ms=0;hist=0-0-0-0", 0, [])
