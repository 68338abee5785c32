"""Tokens of a batch of texts as arrays: hashes, owners and byte offsets, without a Python object per token."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_R = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S1, _S2, _S3 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads 64-bit values."""
    x = (x ^ (x >> _S1)) * _M1
    x = (x ^ (x >> _S2)) * _M2
    return x ^ (x >> _S3)


#: Bytes that are hashed at once.
BLOCK = 1 << 19


def _powers(base: int) -> np.ndarray:
    return np.r_[np.uint64(1), np.cumprod(np.full(BLOCK, np.uint64(base)))]


#: Powers of an odd number and of its inverse modulo 2**64.
_UP, _DOWN = _powers(int(_R)), _powers(pow(int(_R), -1, 1 << 64))
#: Kinds of bytes: 0 ASCII white space and controls, 1 letters, digits and all beyond ASCII, 2 punctuation.
_KIND = np.array([0 if b <= 32 or b == 127 else 1 if b >= 128 or chr(b).isalnum() else 2 for b in range(256)], np.uint8)
_LOW = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


@dataclass
class Tokens:
    hashes: np.ndarray  # of each token's bytes
    owner: np.ndarray  # row of each token
    start: np.ndarray  # its first byte, and the one after its last, in the row
    end: np.ndarray
    words: np.ndarray  # whether it is a word, not punctuation
    rows: int


def tokens(texts: pa.Array, lower: bool = False, punctuation: bool = True) -> Tokens:
    """Runs of letters and digits, and of punctuation if asked for; null counts as empty. lower: A-Z count as a-z.

    Works in blocks of BLOCK bytes; the parts of a token that lies in several blocks are put together by their lengths.
    """
    data = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    base = int(offsets[0])
    raw = np.frombuffer(data.buffers()[2], np.uint8)[base : int(offsets[-1])] if data.buffers()[2] is not None else np.empty(0, np.uint8)
    offsets = offsets - base
    found: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint8))]
    total = np.zeros(BLOCK + 1, np.uint64)
    open_kind = 0  # of a token that the block before may have left unfinished
    for at in range(0, len(raw), BLOCK):
        part = raw[at : at + BLOCK]
        if lower:
            part = _LOW[part]
        kind = _KIND[part]
        breaks = np.empty(len(part) + 1, bool)
        breaks[0] = breaks[-1] = True
        np.not_equal(kind[1:], kind[:-1], out=breaks[1:-1])
        inner = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, at + len(part), side="right")] - at
        breaks[inner] = True
        cuts = np.flatnonzero(breaks)
        start, end = cuts[:-1], cuts[1:]
        keep = kind[start] > 0 if punctuation else kind[start] == 1
        start, end = start[keep], end[keep]
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _UP[: len(part)], out=total[1 : len(part) + 1])
        hashes = (total[end] - total[start]) * _DOWN[start]
        if open_kind and len(start) and not start[0] and kind[0] == open_kind and not (len(inner) and not inner[0]):
            h, s, e, _ = found[-1]
            far = np.uint64(pow(int(_R), int(e[-1] - s[-1]), 1 << 64))
            h[-1:] += hashes[:1] * far
            e[-1] = at + end[0]
            start, end, hashes = start[1:], end[1:], hashes[1:]
        if len(start):
            found.append((hashes, at + start, at + end, kind[start]))
        last = found[-1]
        open_kind = int(last[3][-1]) if len(last[2]) and last[2][-1] == at + len(part) else 0
    hashes, start, end, kinds = (np.concatenate(c) for c in zip(*found))
    owner = np.searchsorted(offsets, start, side="right") - 1
    first = offsets[owner]
    return Tokens(mix(hashes), owner.astype(np.int32), (start - first).astype(np.int32), (end - first).astype(np.int32), kinds == 1, len(data))


def shingles(t: Tokens, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of `words` tokens of one row, and where each starts among the tokens; rows with fewer have none."""
    n = len(t.hashes) - words + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(words):
        h = h * _R + t.hashes[j : j + n]
    same = np.flatnonzero(t.owner[:n] == t.owner[words - 1 :])
    return mix(h[same]), same
