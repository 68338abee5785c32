"""Periodic runs of words, by the branching tandem repeats of a suffix tree (Stoye and Gusfield).

The tree is kept as a suffix array with its LCP intervals: an interval is an internal node, its suffixes the node's leaf
list, so a leaf is looked up by its rank. Each node tests the leaves of all children but the largest (the smaller half):
with leaves i and i + D under a node of depth D, and different words after both, i starts a branching tandem repeat of
period D. It is the last of its run; rotating it to the left as far as the words agree gives the run, and repeats of the
same run (multiples of its period) merge into the smallest. All steps are array operations over the words of many texts
at once; a word's code holds its text, so no repeat reaches across texts.

Null texts have no words; null ids and repeated rows pass through; other columns are ignored. Texts are never cut: the
arrays of one batch grow with its longest text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairway.llm.common import by_bytes, group_bounds, rows_as_bytes, tidy

#: Leaves tested at once; bytes of text in a batch.
LEAVES, BATCH = 1 << 20, 1 << 19


def suffix_ranks(codes: np.ndarray, stops: np.ndarray) -> list[np.ndarray]:
    """Ranks of all positions by their first 1, 2, 4, ... words, until no two are equal; each with a -1 at the end.

    `stops` has the end of each position's text. Equal ranks mean equal words, and a rank is the number of smaller suffixes.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    starts = group_bounds(codes[order])
    sizes = np.diff(starts)
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = np.repeat(starts[:-1], sizes)
    levels, active, width = [rank.astype(np.int32)], order[np.repeat(sizes > 1, sizes)], 1
    while len(active):
        after = np.minimum(active + width, n)
        key = rank[active] * (n + 2) + np.where(active + width < stops[active], rank[after] + 1, 0)
        sub = np.argsort(key, kind="stable")
        active, key = active[sub], key[sub]
        old = group_bounds(key // (n + 2))
        slot = rank[active] + np.arange(len(active)) - np.repeat(old[:-1], np.diff(old))
        new = group_bounds(key)
        sizes = np.diff(new)
        rank[active] = np.repeat(slot[new[:-1]], sizes)
        levels.append(rank.astype(np.int32))
        active, width = active[np.repeat(sizes > 1, sizes)], width * 2
    return levels


def _agree(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, left: bool = False) -> np.ndarray:
    """How many words from a and b on are equal (left: before a and b); a < b there, and both in one text."""
    length = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 2, -1, -1):  # none agree on the last level
        if left:
            x, y = a - length - (1 << k), b - length - (1 << k)
            same = (x >= 0) & (levels[k][np.maximum(x, 0)] == levels[k][np.maximum(y, 0)])
        else:
            same = levels[k][a + length] == levels[k][b + length]
        length[same] += 1 << k
    return length


def _nearest(lcp: np.ndarray, at: np.ndarray, step: int, equal: bool) -> np.ndarray:
    """For the positions `at`, the nearest one in a direction with a smaller (or equal) value, by pointer jumping."""
    to, todo = np.arange(len(lcp)) + step, at
    while len(todo):
        p = to[todo]
        open_ = lcp[p] > lcp[todo] if equal else lcp[p] >= lcp[todo]
        todo = todo[open_]
        to[todo] = to[p[open_]]
    return to[at]


def _branching(codes: np.ndarray, stops: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of all branching tandem repeats."""
    n, rank = len(codes), levels[-1][:-1]
    suffix = np.empty(n, np.int64)
    suffix[rank] = np.arange(n)
    lcp = np.zeros(n + 1, np.int64)  # lcp[j]: of the suffixes j - 1 and j
    near = np.flatnonzero(codes[suffix[:-1]] == codes[suffix[1:]])
    lcp[near + 1] = _agree(levels, suffix[near], suffix[near + 1])
    at = near + 1
    if not len(at):
        return at, at
    low, high, before = _nearest(lcp, at, -1, False), _nearest(lcp, at, 1, False), _nearest(lcp, at, -1, True)
    _, last, node = np.unique(low[::-1] * (n + 1) + high[::-1], return_index=True, return_inverse=True)
    node, last = node[::-1], len(at) - 1 - last  # the last split of each node has the last child on its right
    owner = np.r_[node, np.arange(len(last))]
    begin, end = np.r_[before, at[last]], np.r_[at, high[last]]
    largest = np.lexsort((end - begin, owner))
    largest = largest[np.r_[np.flatnonzero(np.diff(owner[largest])), len(largest) - 1]]
    small = np.ones(len(owner), bool)
    small[largest] = False
    begin, end, owner = begin[small], end[small], owner[small]
    low, high, deep = low[last], high[last], lcp[at[last]]
    total, starts, periods = np.cumsum(end - begin), [], []
    for a, b in _slices(total):
        size = end[a:b] - begin[a:b]
        leaf = np.arange(int(size.sum())) + np.repeat(begin[a:b] - np.cumsum(size) + size, size)
        v = np.repeat(owner[a:b], size)
        i, d, lo, hi = suffix[leaf], deep[v], low[v], high[v]
        for first, second in ((i, i + d), (i - d, i)):
            other = second if first is i else first
            inside = (other >= 0) & (other < n)
            r = rank[np.where(inside, other, 0)]
            ok = np.flatnonzero(inside & (r >= lo) & (r < hi))
            x, p = first[ok], d[ok]
            nxt = x + 2 * p
            branch = (nxt >= stops[x]) | (codes[np.minimum(nxt, n - 1)] != codes[x])
            starts.append(x[branch])
            periods.append(p[branch])
    pairs = np.unique(np.concatenate(starts) * (n + 1) + np.concatenate(periods))
    return pairs // (n + 1), pairs % (n + 1)


def _slices(total: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of segments with about LEAVES leaves each (one segment at least), from the running total of their sizes."""
    a = 0
    while a < len(total):
        base = total[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(total, base + LEAVES, side="right")))
        yield a, b
        a = b


def find_runs(codes: np.ndarray, bounds: np.ndarray, least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs of at least `least` words, by text, start and period.

    `codes` are the words of all texts as numbers (0 and more), text t has those from bounds[t] to bounds[t + 1].
    """
    none = np.zeros(0, np.int64)
    if not len(codes):
        return none, none, none, none
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    stops, codes = bounds[1:][text], text * (int(codes.max()) + 1) + codes
    levels = suffix_ranks(codes, stops)
    at, period = _branching(codes, stops, levels)
    if not len(at):
        return none, none, none, none
    end = at + 2 * period
    start = at - _agree(levels, at, at + period, left=True)  # rotated to the left
    long = end - start >= least
    start, end, period = start[long], end[long], period[long]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.r_[True, (np.diff(start) != 0) | (np.diff(end) != 0)][: len(start)]  # the smallest period of each run
    start, end, period = start[first], end[first], period[first]
    order = np.lexsort((period, start))
    start, end, period = start[order], end[order], period[order]
    return text[start], start - bounds[text[start]], end - start, period


def rewritten(number: int, n: int) -> np.ndarray | None:
    """The fixed change of the words of every tenth document or so: from some word on they repeat. Word numbers, or None."""
    h = zlib.crc32(str(number).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def _words(batch: pa.RecordBatch, rewrite: bool) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of every text, their codes, and the bounds of the texts in these."""
    words = [t.split() for t in rows_as_bytes(batch.column(1))]  # at ASCII white space
    if rewrite:
        for k, number in enumerate(batch.column(0).to_pylist()):
            if number is not None and (to := rewritten(number, len(words[k]))) is not None:
                words[k] = [words[k][i] for i in to.tolist()]
    codes = pa.array(chain.from_iterable(words), pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    return words, codes, np.r_[0, np.cumsum([len(w) for w in words], dtype=np.int64)]


def _collapse(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    """The words that no run repeats, joined by a space."""
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    keep = np.flatnonzero(np.cumsum(depth[:-1]) == 0)
    return b" ".join([words[i] for i in keep.tolist()])


def _each(batches: Iterator[pa.RecordBatch], least: int, rewrite: bool) -> Iterator[tuple[pa.RecordBatch, list, np.ndarray, tuple]]:
    """Batches with the words, the bounds of each text's runs, and the runs."""
    for batch in by_bytes(batches, "text", BATCH):
        words, codes, bounds = _words(batch, rewrite)
        found = find_runs(codes, bounds, least)
        yield batch, words, np.searchsorted(found[0], np.arange(len(words) + 1)), found[1:]


def _list(least: int, rewrite: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, edges, found in _each(batches, least, rewrite):
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), np.diff(edges))))
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, found)], names=["id", "start", "length", "period"])

    return run


def _texts(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words, edges, found in _each(batches, least, False):
            out = [_collapse(w, *(x[a:b] for x in found)).decode() for w, a, b in zip(words, edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["id", "text"])

    return run


DIGEST = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _digest(least: int, rewrite: bool):
    names = [x.split()[0] for x in DIGEST.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words, edges, found in _each(batches, least, rewrite):
            rows = []
            for w, a, b in zip(words, edges[:-1].tolist(), edges[1:].tolist()):
                start, length, period = (x[a:b] for x in found)
                if a == b:
                    rows.append((0, None, None, None, None, "", b" ".join(w)))
                    continue
                top = int(np.argmax(length))  # the first of the longest: by start, then period
                s, n, p = int(start[top]), int(length[top]), int(period[top])
                lines = "".join(f"{x},{y},{z}\n" for x, y, z in zip(start.tolist(), length.tolist(), period.tolist()))
                rows.append((b - a, s, n, p, 1000 * n // p, lines, _collapse(w, start, length, period)))
            columns = [pa.array(c, pa.int64()) for c in list(zip(*rows))[:5]]
            columns += [pa.array([hashlib.sha256(r[5].encode()).hexdigest() for r in rows]), pa.array([hashlib.sha256(r[6]).hexdigest() for r in rows])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", *names])

    return run


def _input(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), df.schema[id_col].dataType.simpleString()


def periodic_runs(df: DataFrame, least: int = 12, id_col: str = "doc_id", text_col: str = "text", rewrite: bool = False) -> DataFrame:
    """(id, start, length, period) of every run: `length` words from word `start` on, each equal to the one `period` before.

    Runs have at least `least` words and twice their (smallest) period, and can't be extended. `rewrite` applies
    rewritten() first, for which ids are integers.
    """
    rows, kind = _input(df, id_col, text_col)
    return rows.mapInArrow(tidy(_list(least, rewrite)), f"id {kind}, start long, length long, period long").withColumnRenamed("id", id_col)


def collapsed(df: DataFrame, least: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with only the first period of every run, words joined by one space."""
    rows, kind = _input(df, id_col, text_col)
    return rows.mapInArrow(tidy(_texts(least)), f"id {kind}, text string").withColumnRenamed("id", id_col)


def run_digests(df: DataFrame, least: int = 12, id_col: str = "doc_id", text_col: str = "text", rewrite: bool = False) -> DataFrame:
    """Per row: number of runs, the longest (ties: smallest start, then period; none: nulls), and digests of all runs and of the collapsed text."""
    rows, kind = _input(df, id_col, text_col)
    return rows.mapInArrow(tidy(_digest(least, rewrite)), f"id {kind}, {DIGEST}").withColumnRenamed("id", id_col)
