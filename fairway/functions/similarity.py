"""Matching-blocks similarity of many pairs at once, and an index that finds the forms a text may be similar to.

The similarity is twice the letters in matching blocks over the letters of both texts: the longest common block (of equal
ones the first in the first text, then in the second), then the same to its left and to its right. All open stretches of
all pairs go through one table of common suffix lengths per round, held as arrays.
"""

from __future__ import annotations

from collections.abc import Iterable
from difflib import SequenceMatcher

import numpy as np

#: Letters of a text in the tables; pairs in one table. Longer texts are compared one pair at a time.
WIDE, PAIRS = 64, 4096


class Letters:
    """Numbers for letters, from 1 on in order of appearance; 0 fills up short texts."""

    def __init__(self):
        self.code: dict[str, int] = {}

    def table(self, texts: list[str], new: bool = True) -> np.ndarray:
        """(texts, longest) letters of texts of at most WIDE; a letter that has no number is -1 unless `new`."""
        out = np.zeros((len(texts), max(map(len, texts), default=0)), np.int32)
        code = self.code
        for row, text in zip(out, texts):
            if new:
                row[: len(text)] = [code.setdefault(c, len(code) + 1) for c in text]
            else:
                row[: len(text)] = [code.get(c, -1) for c in text]
        return out


def _longest(a: np.ndarray, b: np.ndarray, alo, ahi, blo, bhi) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start in a, start in b, length) of the longest common block of each stretch."""
    n, width = b.shape
    place = np.arange(width)
    inside = (place >= blo[:, None]) & (place < bhi[:, None])
    before = np.zeros((n, width + 1), np.uint8)
    size, at_a, at_b = np.zeros(n, np.uint8), np.zeros(n, np.int64), np.zeros(n, np.int64)
    every = np.arange(n)
    for i in range(int(alo.min()), int(ahi.max())):
        same = (b == a[:, i : i + 1]) & inside
        same &= ((alo <= i) & (i < ahi))[:, None]
        now = np.zeros_like(before)
        np.add(before[:, :-1], 1, out=now[:, 1:], where=same)
        best = now.argmax(1)
        long = now[every, best]
        more = long > size
        size[more], at_a[more], at_b[more] = long[more], i + 1, best[more]
        before = now
    return at_a - size, at_b - size, size.astype(np.int64)


def matching_letters(a: np.ndarray, b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Letters in matching blocks of each pair of rows of two letter tables."""
    total = np.zeros(len(a), np.int64)
    pair, alo, ahi, blo, bhi = np.arange(len(a)), np.zeros_like(a_size), a_size, np.zeros_like(b_size), b_size
    while True:
        open_ = (alo < ahi) & (blo < bhi)
        pair, alo, ahi, blo, bhi = (x[open_] for x in (pair, alo, ahi, blo, bhi))
        if not len(pair):
            return total
        i, j, size = _longest(a[pair], b[pair], alo, ahi, blo, bhi)
        np.add.at(total, pair, size)
        hit = size > 0
        pair, alo, ahi, blo, bhi, i, j, size = (x[hit] for x in (pair, alo, ahi, blo, bhi, i, j, size))
        pair, alo, ahi, blo, bhi = (np.concatenate(x) for x in ((pair, pair), (alo, i + size), (i, ahi), (blo, j + size), (j, bhi)))


def block_ratios(first: list[str], second: list[str]) -> np.ndarray:
    """The similarity of each pair, first text first: it is not symmetric. 1 where both are empty, as difflib has it."""
    out = np.zeros(len(first))
    short = [k for k, (x, y) in enumerate(zip(first, second)) if len(x) <= WIDE and len(y) <= WIDE]
    for s in range(0, len(short), PAIRS):
        some = short[s : s + PAIRS]
        letters = Letters()
        b = letters.table([second[k] for k in some])
        a = letters.table([first[k] for k in some], new=False)
        n, m = (np.array([len(x[k]) for k in some], np.int64) for x in (first, second))
        total = n + m
        out[some] = np.where(total > 0, 2.0 * matching_letters(a, b, n, m) / np.maximum(total, 1), 1.0)
    if len(short) < len(first):
        known = set(short)
        matcher, held = SequenceMatcher(None), None
        for k in sorted(set(range(len(first))) - known, key=lambda k: second[k]):
            if second[k] != held:
                held = second[k]
                matcher.set_seq2(held)
            matcher.set_seq1(first[k])
            out[k] = matcher.ratio()
    return out


def common_subsequence(pattern: np.ndarray, rows: np.ndarray, letters: int) -> np.ndarray:
    """Length of the longest common subsequence of a text (its letters, WIDE at most) and each row, bit-parallel over the rows."""
    masks = np.zeros(letters + 2, np.uint64)  # the last one for letters without a number
    for k, c in enumerate(pattern.tolist()):
        masks[c] |= np.uint64(1 << k)
    masks[0] = 0
    masks[-1] = 0
    left = np.full(len(rows), ~np.uint64(0), np.uint64)
    for column in rows.T:
        hit = left & masks[column]
        left = (left + hit) | (left - hit)
    return np.bitwise_count(~left & np.uint64((1 << len(pattern)) - 1)).astype(np.int64)


class FormIndex:
    """Finds among many distinct forms those that equal, contain, are contained in, or may be similar to a text.

    An inverted index over numbered letters (the second e of a text is another entry than the first) counts, for every
    form, the letters it shares with a text, by adding up posting lists in one array. All of a text's letters shared: the
    form may contain it; all of the form's: it may be contained. A similarity of r needs r / 2 of the letters of both, so
    the count rules out most others, and the longest common subsequence, no shorter than all matching blocks together,
    most of the rest. `seen` and `verified` count pairs.
    """

    def __init__(self, forms: Iterable[str]):
        self.forms = list(forms)
        self.size = np.array([len(f) for f in self.forms], np.int64)
        self.place = {f: k for k, f in enumerate(self.forms)}
        self.letters = Letters()
        short = np.flatnonzero(self.size <= WIDE)
        self.row = np.full(len(self.forms), -1, np.int64)
        self.row[short] = np.arange(len(short))
        flat = np.fromiter((self.letters.code.setdefault(c, len(self.letters.code) + 1) for f in self.forms for c in f), np.int64, int(self.size.sum()))
        self.table = np.zeros((len(short), int(self.size[short].max()) if len(short) else 0), np.int32)
        owner = np.repeat(np.arange(len(self.forms)), self.size)
        starts = np.cumsum(self.size) - self.size
        within = np.arange(len(flat)) - np.repeat(starts, self.size)
        fits = self.row[owner] >= 0
        self.table[self.row[owner[fits]], within[fits]] = flat[fits]
        order = np.lexsort((owner, flat)) if len(flat) else np.zeros(0, np.int64)
        owner, flat = owner[order], flat[order]
        new = np.flatnonzero(np.r_[True, (np.diff(flat) != 0) | (np.diff(owner) != 0)]) if len(flat) else np.zeros(0, np.int64)
        nth = np.arange(len(flat)) - np.repeat(new, np.diff(np.r_[new, len(flat)]))
        order = np.lexsort((owner, nth, flat)) if len(flat) else np.zeros(0, np.int64)
        flat, nth, self.owner = flat[order], nth[order], owner[order].astype(np.int32)
        heads = np.flatnonzero(np.r_[True, (np.diff(flat) != 0) | (np.diff(nth) != 0)]) if len(flat) else np.zeros(0, np.int64)
        self.posting = {(c, k): (a, b) for c, k, a, b in zip(flat[heads].tolist(), nth[heads].tolist(), heads.tolist(), np.r_[heads[1:], len(flat)].tolist())}
        self.seen = self.verified = 0

    def shared(self, text: str) -> np.ndarray:
        """Letters that each form shares with a text, repeats counted."""
        count, nth = np.zeros(len(self.forms), np.int32), {}
        for c in text:
            code = self.letters.code.get(c)
            if code is None:
                continue
            k = nth[code] = nth.get(code, -1) + 1
            if at := self.posting.get((code, k)):
                count[self.owner[at[0] : at[1]]] += 1
        return count

    def related(self, text: str) -> tuple[int | None, np.ndarray, np.ndarray]:
        """(the equal form or None, forms that contain the text or are contained in it, letters shared)."""
        count = self.shared(text)
        maybe = np.flatnonzero((count == len(text)) | (count == self.size))
        inside = [k for k in maybe.tolist() if text in self.forms[k] or self.forms[k] in text]
        return self.place.get(text), np.array(inside, np.int64), count

    def candidates(self, text: str, count: np.ndarray, least: float, but: np.ndarray) -> np.ndarray:
        """Forms, except those in `but`, whose similarity to a text may be `least` or more."""
        self.seen += len(self.forms)
        if not text:
            return np.zeros(0, np.int64)
        fair = 2.0 * count >= least * (len(text) + self.size)
        fair[but] = False
        fair &= self.size > 0
        found = np.flatnonzero(fair)
        if least > 0 and len(text) <= WIDE:
            short = found[self.row[found] >= 0]
            if len(short):
                pattern = np.array([self.letters.code.get(c, -1) for c in text], np.int64)
                rows = self.table[self.row[short], : int(self.size[short].max())]
                common = common_subsequence(pattern, rows, len(self.letters.code))
                good = 2.0 * common >= least * (len(text) + self.size[short])
                found = np.concatenate([short[good], found[self.row[found] < 0]])
        return found

    def ratios(self, texts: list[str], found: list[np.ndarray]) -> list[np.ndarray]:
        """The similarity of each text to each of its candidates, all pairs in one go."""
        owner = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        flat = np.concatenate(found) if found else np.zeros(0, np.int64)
        out = np.zeros(len(flat))
        self.verified += len(flat)
        fits = np.array([len(t) <= WIDE for t in texts], bool)
        short = np.flatnonzero(fits[owner] & (self.row[flat] >= 0)) if len(flat) else np.zeros(0, np.int64)
        table = self.letters.table([t if len(t) <= WIDE else "" for t in texts], new=False)
        sizes = np.array([len(t) for t in texts], np.int64)
        for s in range(0, len(short), PAIRS):
            some = short[s : s + PAIRS]
            a, f = owner[some], flat[some]
            wide_a, wide_b = int(sizes[a].max()), int(self.size[f].max())
            hits = matching_letters(table[a, :wide_a], self.table[self.row[f], :wide_b], sizes[a], self.size[f])
            out[some] = 2.0 * hits / (sizes[a] + self.size[f])
        rest = np.setdiff1d(np.arange(len(flat)), short)
        if len(rest):
            out[rest] = block_ratios([texts[owner[k]] for k in rest], [self.forms[flat[k]] for k in rest])
        return np.split(out, np.cumsum([len(f) for f in found])[:-1]) if found else []
