"""PNG media columns: texts or samples stored as PNG, read back with every checksum tested, and hashed.

The hash has one bit for each of the 8x8 lowest frequencies of the cosine transform of the image, averaged down to
32x32 samples: whether the coefficient is above their median.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairway.llm.common import by_bytes, materialise, rows_as_bytes, tidy

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by colour type.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
GRID, LOW, IDAT = 32, 8, 1 << 20
#: Bytes of samples that an image may have to be decoded.
MOST = 1 << 28


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(samples: np.ndarray, level: int = 6) -> bytes:
    """The PNG of (height, width) or (height, width, channels) 8-bit samples; each row takes the filter (none, sub or up) of the least sum."""
    shape = samples.shape
    channels = shape[2] if samples.ndim == 3 else 1
    raw = np.ascontiguousarray(samples, np.uint8).reshape(shape[0], -1)
    sub, up = raw.copy(), raw.copy()
    sub[:, channels:] -= raw[:, :-channels]
    up[1:] -= raw[:-1]
    kinds = np.stack([raw, sub, up])
    cost = np.abs(kinds.view(np.int8).astype(np.int16)).sum(2)
    pick = np.argmin(cost, 0)
    rows = np.empty((shape[0], raw.shape[1] + 1), np.uint8)
    rows[:, 0] = pick
    rows[:, 1:] = kinds[pick, np.arange(shape[0])]
    data = zlib.compress(rows.tobytes(), level)
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[channels]
    head = _chunk(b"IHDR", struct.pack(">IIBBBBB", shape[1], shape[0], 8, colour, 0, 0, 0))
    return SIGNATURE + head + b"".join(_chunk(b"IDAT", data[i : i + IDAT]) for i in range(0, len(data), IDAT)) + _chunk(b"IEND", b"")


def _predicted(kinds: np.ndarray, left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """What the filters none, sub, up, average and Paeth predict, by row."""
    a, b, c = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
    paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
    return np.where(kinds == 4, paeth, np.where(kinds == 3, (left + up) >> 1, np.where(kinds == 2, up, np.where(kinds == 1, left, 0))))


def _wavefront(kinds: np.ndarray, rows: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Undoes any filters of rows (height, width, channels) by anti-diagonals: a pixel needs those to its left, above and at the corner.

    Both arrays are skewed, so that a diagonal is a row of them: pixel x of row y is in row x + y.
    """
    h, w, c = rows.shape
    skew = np.zeros((w + h - 1, h, c), np.int16)
    item = skew.itemsize * c
    np.lib.stride_tricks.as_strided(skew, (h, w, c), ((h + 1) * item, h * item, skew.itemsize))[:] = rows
    done = np.zeros((w + h + 1, h + 1, c), np.int16)  # two rows and the row above the first in front
    done[1 : w + 1, 0] = above
    kinds = kinds[:, None].astype(np.int16)
    for d in range(w + h - 1):
        lo, hi = max(0, d - w + 1), min(h, d + 1)
        left, up, corner = done[d + 1, lo + 1 : hi + 1], done[d + 1, lo:hi], done[d, lo:hi]
        done[d + 2, lo + 1 : hi + 1] = (skew[d, lo:hi] + _predicted(kinds[lo:hi], left, up, corner)) & 255
    out = done[2:, 1:]
    s0, s1, s2 = out.strides
    return np.lib.stride_tricks.as_strided(out, (h, w, c), (s0 + s1, s0, s2)).astype(np.uint8)


def _by_sample(kind: int, row: list[int], above: list[int]) -> list[int]:
    """Undoes average or Paeth in one channel of one row."""
    out, left, corner = [], 0, 0
    for v, up in zip(row, above):
        if kind == 3:
            near = (left + up) >> 1
        else:
            a, b, c = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
            near = left if a <= b and a <= c else up if b <= c else corner
        left, corner = (v + near) & 255, up
        out.append(left)
    return out


#: Rows of a wavefront at most; rows from which one pays; rows of other filters that end it.
FRONT, SOME, GAP = 4096, 6, 16


def unfilter(rows: np.ndarray, channels: int) -> np.ndarray:
    """Undoes the five row filters; rows: (height, 1 + bytes of a row)."""
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    if kinds.size and kinds.max() > 4:
        raise ValueError("unknown row filter")
    width = out.shape[1] // channels
    hard = np.flatnonzero(kinds > 2)
    front = kinds.copy()  # 5: rows that go by wavefront, with the few of other filters between them
    for part in np.split(hard, np.flatnonzero(np.diff(hard) > GAP) + 1) if len(hard) else []:
        if part[-1] - part[0] + 1 >= SOME:
            front[part[0] : part[-1] + 1] = 5
    edges = np.r_[0, np.flatnonzero(np.diff(front.astype(np.int16))) + 1, len(kinds)].tolist() if len(kinds) else [0]
    for a, b in zip(edges[:-1], edges[1:]):
        kind = front[a]
        if kind == 1:
            out[a:b] = np.cumsum(out[a:b].reshape(b - a, -1, channels), axis=1, dtype=np.uint8).reshape(b - a, -1)
        elif kind == 2:
            if a:
                out[a] += out[a - 1]
            out[a:b] = np.cumsum(out[a:b], axis=0, dtype=np.uint8)
        elif kind == 5:
            step = min(FRONT, max(256, width))
            for y in range(a, b, step):
                z, above = min(b, y + step), out[y - 1] if y else np.zeros(out.shape[1], np.uint8)
                out[y:z] = _wavefront(kinds[y:z], out[y:z].reshape(z - y, width, channels), above.reshape(width, channels)).reshape(z - y, -1)
        elif kind in (3, 4):
            for y in range(a, b):
                above = out[y - 1] if y else np.zeros(out.shape[1], np.uint8)
                for c in range(channels):
                    out[y, c::channels] = _by_sample(int(kind), out[y, c::channels].tolist(), above[c::channels].tolist())
    return out


def decode_png(data: bytes, most: int = MOST) -> np.ndarray:
    """(height, width, channels) samples of an 8-bit PNG that isn't interlaced; ValueError for any other bytes.

    All checksums and lengths must hold. Palette images give their colours. Images of more than `most` bytes of samples
    are refused before anything is inflated, and no more is inflated than the header says.
    """
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, palette, parts, ended = 8, None, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("truncated chunk")
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body, check = data[at + 8 : at + 8 + n], data[at + 8 + n : at + 12 + n]
        if len(check) < 4 or zlib.crc32(body, zlib.crc32(kind)) != struct.unpack(">I", check)[0]:
            raise ValueError(f"bad checksum of chunk {kind!r}")
        if kind == b"IHDR":
            if head is not None or n != 13:
                raise ValueError("bad header")
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            if n % 3 or not 3 <= n <= 768:
                raise ValueError("bad palette")
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            parts.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if head is None or not ended:
        raise ValueError("no header or end")
    width, height, depth, colour, packing, filtering, interlaced = head
    if depth != 8 or colour not in CHANNELS or packing or filtering or interlaced:
        raise ValueError("this kind of PNG is not supported")
    if not width or not height:
        raise ValueError("no samples")
    if colour == 3 and palette is None:
        raise ValueError("no palette")
    channels = CHANNELS[colour]
    size = height * (1 + width * channels)
    if size > most:
        raise ValueError("too many samples")
    d = zlib.decompressobj()
    try:
        raw = d.decompress(b"".join(parts), size)
        if not d.eof:  # the end of the stream may be left to read; one byte more is one too many
            raw += d.decompress(d.unconsumed_tail, 1)
    except zlib.error as e:
        raise ValueError(f"bad data: {e}") from e
    if len(raw) != size or not d.eof or d.unused_data:
        raise ValueError("wrong number of samples")
    out = unfilter(np.frombuffer(raw, np.uint8).reshape(height, -1), channels).reshape(height, width, channels)
    if colour != 3:
        return out
    if out.max() >= len(palette):
        raise ValueError("a colour is not in the palette")
    return palette[out[:, :, 0]]


def _shrink(a: np.ndarray, to: int) -> np.ndarray:
    """Means of `to` equal parts along the first axis, parts of samples by area."""
    total = np.concatenate([np.zeros((1, *a.shape[1:])), np.cumsum(a, axis=0, dtype=np.float64)])
    where = np.arange(to + 1) * (len(a) / to)
    low = np.minimum(where.astype(int), len(a) - 1)
    at = total[low] + (where - low)[:, None] * (total[low + 1] - total[low])
    return np.diff(at, axis=0) / (len(a) / to)


_COSINES = np.cos(np.pi * np.outer(np.arange(LOW), 2 * np.arange(GRID) + 1) / (2 * GRID))


def cosine_hash(samples: np.ndarray) -> str:
    """16 hex digits: which of the lowest 8x8 cosine frequencies exceed their median. Colours are averaged."""
    grey = samples.mean(axis=2) if samples.shape[2] > 1 else samples[:, :, 0]
    grid = _shrink(_shrink(grey, GRID).T, GRID).T
    low = np.round(_COSINES @ grid @ _COSINES.T, 6)
    bits = low > np.median(low.ravel()[1:])
    return np.packbits(bits.ravel()).tobytes().hex()


def _store(unit: int, width: int, fill: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 4 << 20):
            texts = rows_as_bytes(batch.column(1))
            sizes = [max(1, -(-len(t) // unit)) * unit for t in texts]
            media = [encode_png(np.frombuffer(t.ljust(n, bytes([fill])), np.uint8).reshape(-1, width), level) for t, n in zip(texts, sizes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    return run


def store_texts(df: DataFrame, unit: int = 576, width: int = 576, fill: int = 255, level: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each row's text in UTF-8, filled up to a positive multiple of `unit`, as a grey PNG of `width` samples a row.

    Null counts as empty; null ids and repeated rows pass through; equal texts give equal media. Other columns are ignored.
    """
    kind = df.schema[id_col].dataType.simpleString()
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(tidy(_store(unit, width, fill, level)), f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "media", 4 << 20):
        rows = []
        for data in rows_as_bytes(batch.column(1)):
            try:
                samples = decode_png(data)
            except ValueError as e:
                rows.append((None,) * 6 + (str(e),))
                continue
            payload = samples.tobytes()
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(samples), None))
        columns = list(zip(*rows))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["key", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"])


def media_features(df: DataFrame, key_cols: list[str], media_col: str = "media") -> DataFrame:
    """The key columns, then payload and media figures and the cosine hash of each PNG; `error` tells why one can't be read, whatever its bytes. Null media are unreadable."""
    packed = df.select(F.struct(*key_cols).alias("key"), F.col(media_col).alias("media"))
    kind = packed.schema["key"].dataType.simpleString()
    out = packed.mapInArrow(tidy(_features), f"key {kind}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")
    return out.select("key.*", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error")


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text as PNG in a table of the shared folder, reads the table back and returns its figures."""
    stored = materialise(store_texts(df, id_col=id_col, text_col=text_col), "media")
    return media_features(stored, [id_col, "n_bytes"])
