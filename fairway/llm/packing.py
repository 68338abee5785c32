"""Best-fit packing by linear grouping.

Lengths are whole numbers up to the capacity, so the plan is made from the histogram of lengths, whose size does not
grow with the input. Large lengths are rounded up within groups of equal cardinality; configurations of the few rounded
sizes are optimised by column generation; actual lengths are substituted for the rounded ones, the largest that fit, and
the last two so that they fill the sequence exactly where any do; the few large lengths that no configuration takes, and
all small ones, go best fit into the gaps. The plan is a list of runs; each piece finds its place by its rank among the
pieces of its length, and ranks are counted per partition and summed over partitions.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairway.llm.bpe import LibraryBpe, piece_table
from fairway.llm.common import by_bytes, materialise, small, tidy

#: Groups of large lengths; lengths of over 1/LARGE of the capacity are large.
GROUPS, LARGE = 96, 8
#: Ids that a configuration may leave free, from any number to none.
GAPS = (1 << 30, 256, 64, 32, 16, 8, 4, 2, 1, 0)


def _tokenise(vocabulary: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part = piece_table(vocabulary, LibraryBpe), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in by_bytes(batches, "text", 1 << 19):
            flat, bounds = table.encode(batch.column(1))
            n = np.diff(bounds) + 1
            ends = np.cumsum(n)
            ids = np.full(int(ends[-1]), end, "<u4")
            inner = np.ones(len(ids), bool)
            inner[ends - 1] = False
            ids[inner] = flat
            cuts = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), cuts)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            start = piece * capacity
            length = np.minimum(n[doc] - start, capacity)
            first = (ends - n)[doc] + start
            data = memoryview(ids).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + length).tolist())]
            order = np.argsort(length, kind="stable")
            run_of = length[order]
            begin = np.searchsorted(run_of, run_of)
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order)) - begin
            rank += seen[length]
            seen += np.bincount(length, minlength=capacity + 1)
            columns = {"piece": piece.astype(np.int32), "start": start, "length": length, "ids_crc32": np.array(crc, np.int64), "part": np.full(len(doc), part, np.int64), "rank": rank}
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), *map(pa.array, columns.values())], names=["id", *columns])

    return run


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(copies, {size: count}) that cover at most `demand`: column generation over the sizes, solution rounded down."""
    if not sizes:
        return []
    s, d = np.array(sizes), np.array(demand, float)
    patterns = np.diag(capacity // s).astype(float)
    for _ in range(2000):
        basis = np.linalg.inv(patterns)
        x = basis @ d
        price = np.ones(len(s)) @ basis
        best = np.zeros(capacity + 1)
        for size, p in zip(s.tolist(), price.tolist()):
            if p > 0:
                for at in range(size, capacity + 1, size):
                    block = best[at : at + size]
                    np.maximum(block, best[at - size : at - size + len(block)] + p, out=block)
        if best[capacity] <= 1 + 1e-7:
            break
        column, left = np.zeros(len(s)), capacity
        while left > 0:  # read the best pattern off its values
            for j, (size, p) in enumerate(zip(s.tolist(), price.tolist())):
                if p > 0 and size <= left and abs(best[left - size] + p - best[left]) < 1e-12:
                    column[j] += 1
                    left -= size
                    break
            else:
                left -= 1
        into = basis @ column
        grows = into > 1e-9
        if not grows.any():
            break
        ratio = np.where(grows, np.maximum(x, 0) / np.where(grows, into, 1), np.inf)
        patterns[:, int(np.argmin(ratio))] = column
    out = []
    copies = np.floor(np.maximum(np.linalg.solve(patterns, d), 0) + 1e-9).astype(int)
    for j in np.flatnonzero(copies):
        out.append((int(copies[j]), {int(size): int(c) for size, c in zip(s, patterns[:, j]) if c}))
    return out


def _grouped(hist: dict[int, int], least: int, groups: int) -> list[tuple[int, list[list[int]]]]:
    """(rounded size, [[length, count], ...]) of lengths of at least `least`: groups of equal cardinality, largest first; no more lengths than groups stay as they are."""
    lengths = sorted((x for x in hist if x >= least), reverse=True)
    if len(lengths) <= groups:
        return [(x, [[x, hist[x]]]) for x in lengths]
    total = sum(hist[x] for x in lengths)
    quota = max(1, -(-total // groups))
    out: list[tuple[int, list[list[int]]]] = []
    room = 0
    for x in lengths:
        n = hist[x]
        while n:
            if not room:
                out.append((x, []))
                room = quota
            k = min(n, room)
            out[-1][1].append([x, k])
            n, room = n - k, room - k
    merged: list[tuple[int, list[list[int]]]] = []
    for size, runs in out:  # groups of one size are one size
        if merged and merged[-1][0] == size:
            merged[-1][1].extend(runs)
        else:
            merged.append((size, runs))
    return merged


def _filled(slots: list[int], lengths: list[int], left: dict[int, int], capacity: int) -> tuple[int, dict[int, int]]:
    """(gap, {length: times}) of one configuration with actual lengths, from `lengths` (sorted, of those in `left`).

    Each slot takes the largest length that leaves the later slots their rounded sizes. Of the last two, the first goes
    down from there until the second fills the rest exactly; where none does they too take the largest.
    """
    room, later, used = capacity, sum(slots), {}
    free = lambda x: left.get(x, 0) - used.get(x, 0)
    for k, slot in enumerate(slots):
        later -= slot
        at = bisect_right(lengths, room - later) - 1
        if k == len(slots) - 2:
            for x in reversed(lengths[: at + 1]):
                if (y := room - x) > capacity:
                    break
                if y >= lengths[0] and free(x) > 0 and free(y) > (x == y):
                    used[x] = used.get(x, 0) + 1
                    used[y] = used.get(y, 0) + 1
                    return 0, used
        while at >= 0 and free(lengths[at]) <= 0:
            at -= 1
        if at >= 0:
            used[lengths[at]] = used.get(lengths[at], 0) + 1
            room -= lengths[at]
    return room, used


def _substituted(left: dict[int, int], capacity: int, groups: int) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Kinds of sequences (copies, gap, [(length, times), ...]): configurations of rounded sizes with actual lengths in them; takes those off `left`."""
    grouped = _grouped(left, capacity // LARGE + 1, groups)
    found = configurations([g for g, _ in grouped], [sum(n for _, n in r) for _, r in grouped], capacity)
    lengths = sorted(x for x, n in left.items() if n and x > capacity // LARGE)
    kinds: list[tuple[int, int, list[tuple[int, int]]]] = []
    for copies, counts in sorted(found, key=lambda c: sum(c[1].values())):
        slots = [size for size in sorted(counts, reverse=True) for _ in range(counts[size])]
        while copies and lengths:
            gap, used = _filled(slots, lengths, left, capacity)
            step = min(copies, *(left[x] // times for x, times in used.items()))  # as many copies as the lengths last
            for x, times in used.items():
                left[x] -= step * times
                if not left[x]:
                    lengths.remove(x)
            kinds.append((step, gap, list(used.items())))
            copies -= step
    return kinds


def sequences(kinds: list[tuple[int, list[tuple[int, int]]]]) -> int:
    return sum(copies for copies, _ in kinds)


def pack_histogram(hist: dict[int, int], capacity: int, groups: int = GROUPS) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(copies, [(length, times), ...])]: kinds of sequences that hold all lengths of the histogram.

    Configurations that the actual lengths fill badly may cost more than they save, so plans that keep those of a gap of
    at most GAPS, each best fit into the rest, are compared, and the plan of the fewest sequences is taken.
    """
    whole = {x: n for x, n in hist.items() if n}
    full = [(n, 0, [(capacity, 1)])] if (n := whole.pop(capacity, 0)) else []
    made = _substituted(dict(whole), capacity, groups)
    plans = []
    for most in GAPS:
        kept, left = [k for k in made if k[1] <= most], dict(whole)
        for copies, _, items in kept:
            for x, times in items:
                left[x] -= copies * times
        plans.append(_best_fit([*full, *kept], left, capacity))
    return min(plans, key=sequences)


def _best_fit(kinds: list[tuple[int, int, list[tuple[int, int]]]], left: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Puts the lengths that are left, largest first, into the fullest sequences with room, or into new ones."""
    by_gap: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    gaps: list[int] = []

    def put(copies: int, gap: int, items: list[tuple[int, int]]) -> None:
        if gap not in by_gap:
            by_gap[gap] = []
            insort(gaps, gap)
        by_gap[gap].append((copies, items))

    for copies, gap, items in kinds:
        put(copies, gap, items)
    for x in sorted((x for x, n in left.items() if n), reverse=True):
        n = left[x]
        while n:
            at = bisect_left(gaps, x)
            if at == len(gaps):
                copies, gap, items = max(1, n // (capacity // x)), capacity, []
            else:
                gap = gaps[at]
                copies, items = by_gap[gap].pop()
                if not by_gap[gap]:
                    del by_gap[gap]
                    gaps.pop(at)
            times = min(gap // x, n)
            filled = min(copies, n // times)
            put(filled, gap - times * x, [*items, (x, times)])
            if items and copies > filled:
                put(copies - filled, gap, items)
            n -= filled * times
    return [kind for gap in gaps for kind in by_gap[gap]]


def _places(kinds: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """Runs of places, sorted by length and rank: the k-th piece of a run goes to sequence base + k // times."""
    rows, used, base = [], {}, 0
    for copies, items in kinds:
        at = 0
        for length, times in items:
            rank = used.get(length, 0)
            rows.append((length, rank, base, at, times))
            used[length] = rank + copies * times
            at += length * times
        base += copies
    rows.sort()
    length, rank, base_, at, times = (np.array(c, np.int64) for c in zip(*rows))
    return {"key": (length << 44) | rank, "rank": rank, "base": base_, "at": at, "times": times}


def _place(places):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = places.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            i = np.searchsorted(p["key"], (length << 44) | rank, side="right") - 1
            k = rank - p["rank"][i]
            columns = [batch.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(p["base"][i] + k // p["times"][i]), pa.array(p["at"][i] + k % p["times"][i] * length)], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(df: DataFrame, vocabulary: str, capacity: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) per piece of every row.

    A row's ids are those of the tokenizers library without added tokens, then the id `end`. Only rows of more than
    `capacity` ids are cut, into pieces of `capacity` and a rest. Sequences hold at most `capacity` ids without gaps.
    Null and empty texts are one piece of one id; null ids and repeated rows pass through, each packed; an empty table
    gives none. Other columns are ignored.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, part long, rank long"
    pieces = materialise(texts.mapInArrow(tidy(_tokenise(vocabulary, capacity, end)), schema), "packing-pieces")
    counts = materialise(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "packing-counts")
    hist = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `capacity` rows at most
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = materialise(counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("base")), "packing-bases")
    ranked = pieces.join(small(bases), ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base"))
    places = spark.sparkContext.broadcast(_places(pack_histogram(hist, capacity)) if hist else {})  # grows with the capacity, not with the rows
    out = ranked.select("id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(tidy(_place(places)), f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
