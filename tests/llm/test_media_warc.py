"""PNG columns and WARC archives: round trips, checksums, odd rows."""

import hashlib
import struct
import time
import zlib

import numpy as np
import pytest
import zstandard

from fairway.llm import media, warc


def png_of(rows, width, height, colour=0, palette=None):
    head = media._chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0))
    pal = media._chunk(b"PLTE", palette) if palette else b""
    return media.SIGNATURE + head + pal + media._chunk(b"IDAT", zlib.compress(rows)) + media._chunk(b"IEND", b"")


def filtered(samples, kind, channels):
    """Rows under one filter, by the format's definition."""
    out, above = [], [0] * samples.shape[1]
    for row in samples.tolist():
        line = []
        for x, v in enumerate(row):
            a = row[x - channels] if x >= channels else 0
            b, c = above[x], above[x - channels] if x >= channels else 0
            p = a + b - c
            near = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
            line.append((v - (0, a, b, (a + b) // 2, near)[kind]) & 255)
        out.append(bytes([kind, *line]))
        above = row
    return b"".join(out)


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize("channels, colour", [(1, 0), (2, 4), (3, 2), (4, 6)])
def test_all_filters(kind, channels, colour):
    samples = np.random.default_rng(kind).integers(0, 256, (7, 5 * channels)).astype(np.uint8)
    got = media.decode_png(png_of(filtered(samples, kind, channels), 5, 7, colour))
    assert (got.reshape(7, -1) == samples).all()


@pytest.mark.parametrize("channels, colour", [(1, 0), (3, 2)])
@pytest.mark.parametrize("front", [7, 4096])
def test_mixed_filters(monkeypatch, channels, colour, front):
    """Rows of all filters in turn, by wavefronts of several blocks and by single rows."""
    monkeypatch.setattr(media, "FRONT", front)
    rng = np.random.default_rng(3)
    samples = rng.integers(0, 256, (90, 11 * channels)).astype(np.uint8)
    kinds = np.r_[rng.integers(0, 5, 40), [0, 1, 2] * 8, [4], [2] * 20, [3, 4, 1, 4, 2]]
    by_kind = {k: filtered(samples, k, channels) for k in range(5)}
    width = 1 + samples.shape[1]
    rows = b"".join(by_kind[k][y * width : (y + 1) * width] for y, k in enumerate(kinds.tolist()))
    assert (media.decode_png(png_of(rows, 11, 90, colour)).reshape(90, -1) == samples).all()


@pytest.mark.parametrize("kind", [3, 4])
@pytest.mark.parametrize("height, width", [(3200, 3200), (100_000, 100)])
def test_ten_megabytes_of_hard_rows(kind, height, width):
    rows = np.random.default_rng(kind).integers(0, 256, (height, 1 + width)).astype(np.uint8)
    rows[:, 0] = kind
    began = time.process_time()
    media.unfilter(rows, 1)
    assert time.process_time() - began < 6  # some 1 s on a free core


@pytest.mark.parametrize("shape", [(1, 576), (40, 24), (9, 5, 3), (3, 4, 4)])
def test_round_trip(shape):
    samples = np.random.default_rng(0).integers(0, 256, shape).astype(np.uint8)
    assert (media.decode_png(media.encode_png(samples)).reshape(shape) == samples).all()


def test_palette():
    rows = b"\x00\x01\x00" + b"\x00\x00\x01"
    assert media.decode_png(png_of(rows, 2, 2, 3, bytes([1, 2, 3, 9, 8, 7]))).tolist() == [[[9, 8, 7], [1, 2, 3]], [[1, 2, 3], [9, 8, 7]]]


def test_damage_is_seen():
    good = media.encode_png(np.arange(576, dtype=np.uint8).reshape(1, -1))
    for at in range(8, len(good)):
        bad = good[:at] + bytes([good[at] ^ 1]) + good[at + 1 :]
        with pytest.raises(ValueError):
            media.decode_png(bad)
    with pytest.raises(ValueError):
        media.decode_png(good[:-20])


def malformed():
    c, s, end = media._chunk, media.SIGNATURE, media._chunk(b"IEND", b"")
    head = lambda w, h, colour=0: c(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0))
    data = lambda rows: c(b"IDAT", zlib.compress(rows))
    return {
        "short header": s + c(b"IHDR", b"\0\0\0\1") + data(b"\0\0") + end,
        "two headers": s + head(1, 1) + head(1, 1) + data(b"\0\0") + end,
        "no palette": png_of(b"\0\1", 1, 1, 3),
        "ragged palette": s + head(1, 1, 3) + c(b"PLTE", b"\1\2") + data(b"\0\0") + end,
        "colour beyond the palette": png_of(b"\0\7", 1, 1, 3, bytes(6)),
        "huge": s + head(2**32 - 1, 2**32 - 1) + data(b"\0") + end,
        "empty": s + head(0, 3) + data(b"\0\0\0") + end,
        "more data than samples": png_of(b"\0" * 50_000_000, 1, 1),
        "less data than samples": png_of(b"\0", 3, 3),
        "data after the stream": s + head(1, 1) + c(b"IDAT", zlib.compress(b"\0\0") + b"x") + end,
        "unknown filter": png_of(b"\x09\0", 1, 1),
        "not zlib": s + head(1, 1) + c(b"IDAT", b"nonsense") + end,
        "nothing": b"",
        "only the signature": s,
    }


def test_any_bytes_give_an_error_row(spark):
    bad = malformed()
    for name, blob in bad.items():
        with pytest.raises(ValueError):
            media.decode_png(blob)
            raise AssertionError(name)
    good = media.encode_png(np.zeros((2, 576), np.uint8))
    rows = [(i, b) for i, b in enumerate(bad.values())] + [(98, None), (99, good)]
    got = {r.key: r for r in media.media_features(spark.createDataFrame(rows, "key long, media binary"), ["key"]).collect()}
    assert len(got) == len(rows)
    assert all(r.error and r.payload_bytes is None for k, r in got.items() if k < 99)
    assert got[99].error is None and got[99].payload_bytes == 1152


@pytest.mark.parametrize("shape", [(32, 32, 1), (64, 96, 1), (40, 576, 1), (64, 32, 3)])
def test_hash_by_its_definition(shape):
    """Means of 32x32 equal areas, the cosine sums of the 8x8 lowest frequencies, and their median, one by one."""
    a = np.random.default_rng(5).integers(0, 256, shape).astype(np.uint8)
    grey = a.astype(float).mean(axis=2)

    def area(v, k):  # overlap of sample v.. with part k
        n = len(v)
        return sum(x * max(0.0, min(i + 1, (k + 1) * n / 32) - max(i, k * n / 32)) for i, x in enumerate(v)) / (n / 32)

    tall = np.array([[area(grey[:, x], k) for x in range(shape[1])] for k in range(32)])
    grid = np.array([[area(tall[y], k) for k in range(32)] for y in range(32)])
    cos = lambda u, x: np.cos(np.pi * u * (2 * x + 1) / 64)
    low = [[sum(grid[y][x] * cos(u, y) * cos(v, x) for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)]
    flat = [round(c, 6) for row in low for c in row]
    middle = np.median(flat[1:])
    assert media.cosine_hash(a) == f"{int(''.join('1' if c > middle else '0' for c in flat), 2):016x}"


def test_hash_ignores_small_noise():
    waves = np.cos(np.pi * np.outer(np.arange(8), 2 * np.arange(64) + 1) / 128)  # all low frequencies are present
    image = np.clip(128 + waves.T @ np.random.default_rng(2).normal(0, 9, (8, 8)) @ waves, 0, 255).astype(np.uint8)[:, :, None]
    noisy = np.clip(image.astype(int) + np.random.default_rng(1).integers(-3, 4, image.shape), 0, 255).astype(np.uint8)
    bits = lambda s: int(media.cosine_hash(s), 16)
    assert (bits(image) ^ bits(noisy)).bit_count() <= 12
    assert (bits(image) ^ bits(image[::-1, ::-1])).bit_count() > 12


def test_text_media(spark):
    texts = ["", None, "abc", "é" * 288, "x" * 576, "y" * 577, "abc", "long " * 40_000]
    df = spark.createDataFrame([(i, t, b"m") for i, t in enumerate(texts)] + [(None, "n", b"m")], "doc_id long, text string, media binary")
    got = {r.doc_id: r for r in media.text_media(df).collect()}
    assert len(got) == 9
    for i, t in [*enumerate(texts), (None, "n")]:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.error) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), None)
    assert got[2][2:] == got[6][2:]
    assert media.text_media(df.limit(0)).count() == 0
    broken = media.media_features(spark.createDataFrame([(1, b"no png"), (2, None)], "k int, media binary"), ["k"])
    assert [r.error is not None for r in broken.collect()] == [True, True]


@pytest.fixture(scope="module")
def pages():
    big = "<p>" + "copy " * 400
    rows = [(1, "http://a/1", big), (5, "http://a/5", big), (3, None, big), (None, "http://a/n", big), (7, "http://a b\r\n", "small"), (8, "u", "small"), (9, "u", None), (10, "u", ""), (11, "u", "é" * 500), (12, "u", "é" * 500), (12, "u", "é" * 500)]
    return rows + [(100 + i, f"http://x/{i}", f"<html>{i} {'text ' * (i % 90)}</html>") for i in range(300)]


def test_warc(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    archives = warc.write_archives(df)
    got = warc.read_archives(archives).collect()
    assert len(got) == len(pages) and not [r.error for r in got if r.error]
    groups = {}
    for i, _, h in pages:
        groups.setdefault(h or "", []).append(i)
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        top = max((x for x in groups[h or ""] if x is not None), default=None) if len(raw) >= 1000 else i
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if i == top else "revisit", None if i == top else top))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    assert all(hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in got if r.record_type == "response")
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def test_archive_layout(pages):
    records = [warc.build_record(i, u, (h or "").encode(), None, "2024-01-01T00:00:00Z") for i, u, h in pages]
    data = warc.build_archive(records)
    magic, size = struct.unpack("<II", data[:8])
    assert magic == warc.DICTIONARY_FRAME
    trained = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size], max_output_size=1 << 20))
    stream = zstandard.ZstdDecompressor(dict_data=trained).stream_reader(data[8 + size :], read_across_frames=True)
    assert stream.read() == b"".join(records)
    assert len(list(warc.parse_archive(data))) == len(records)


def test_broken_archives(spark):
    record = warc.build_record(1, "u", b"payload", None, "2024-01-01T00:00:00Z")
    c = zstandard.ZstdCompressor().compress
    good, short = c(record), c(record.replace(b"Content-Length: 7\r\n", b"Content-Length: 6\r\n"))
    wrong = c(record.replace(b"payload\r\n", b"PAYLOAD\r\n"))
    headless, extra = c(b"x" + record), c(record + b"x")
    errors = [r["error"] for r in warc.parse_archive(good + short + wrong + headless + extra + good + b"rubbish!")]
    assert [e is None for e in errors] == [True, False, False, False, False, True, False]
    assert [r["error"] is None for r in warc.parse_archive(good + good[:-3])] == [True, False]
    rows = spark.createDataFrame([("a", None), ("b", b""), ("c", good)], "archive string, content binary")
    assert warc.read_archives(rows).count() == 1


def test_hostile_archives(spark):
    """Numbers beyond 64 bits, frames that inflate too far, with and without saying so, and skippable frames that end beyond the archive."""
    date = "2024-01-01T00:00:00Z"
    record, revisit = warc.build_record(1, "u", b"payload", None, date), warc.build_record(2, "u", b"payload", 1, date)
    c = zstandard.ZstdCompressor().compress
    silent = zstandard.ZstdCompressor(write_content_size=False).compress
    good = c(record)
    big = warc.build_record(3, "u", b"x" * 3_000_000, None, date)
    block = len(revisit.partition(b"\r\n\r\n")[2]) - 4
    longer = revisit.replace(b"Content-Length: 7\r\n", b"Content-Length: " + b"7" * 25 + b"\r\n").replace(b"Content-Length: %d\r\n" % block, b"Content-Length: %d\r\n" % (block + 24))
    bad = {
        "id": c(record.replace(b"urn:page:1>", b"urn:page:" + b"9" * 25 + b">")),
        "target": c(revisit.replace(b"urn:page:1>", b"urn:page:-" + b"9" * 19 + b">")),
        "payload length": c(longer),
        "length": c(record.replace(b"Content-Length: 7", b"Content-Length: 7" + b"0" * 5000)),
        "bomb": c(big),
        "silent bomb": silent(big),
    }
    skip = struct.pack("<II", 0x184D2A51, 3) + b"abc"
    dictionary = c(b"\0" * (warc.MOST_DICTIONARY + 1))
    rows = [(name, good + data + good) for name, data in bad.items()]
    rows += [("skipped", skip + good), ("short skip", good + struct.pack("<II", 0x184D2A51, 9) + b"abc"), ("short dictionary", struct.pack("<II", warc.DICTIONARY_FRAME, 99) + b"abc"), ("dictionary bomb", struct.pack("<II", warc.DICTIONARY_FRAME, len(dictionary)) + dictionary + good)]
    found = {}
    for r in warc.read_archives(spark.createDataFrame(rows, "archive string, content binary"), most=1 << 20).collect():
        found.setdefault(r.archive, []).append(r.error is None)
    assert found == {**{name: [True, False, True] for name in bad}, "skipped": [True], "short skip": [True, False], "short dictionary": [False], "dictionary bomb": [False]}
    assert [r["error"] for r in warc.parse_archive(c(big))] == [None]


def test_clashing_names_of_pages(spark, pages):
    df = spark.createDataFrame(pages[:20], "page_id long, url string, html string")
    clash = df.selectExpr("*", "1 AS sender", "2 AS rid", "'x' AS payload", "3 AS key", "4 AS refers_to", "5 AS top")
    shown = lambda d: sorted(map(str, warc.read_archives(warc.write_archives(d)).drop("archive").collect()))
    assert shown(clash) == shown(df)
