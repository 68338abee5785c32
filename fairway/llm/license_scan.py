"""License scan: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

Templates fall into classes by length; each class has windows of its own size, two blocks long and one block apart, so
that every run of shingles as long as a template of the class lies within one window. Windows and templates are compared
in BANDS bands of one MinHash each: with a window that is at most a few times as long as the template, a template that
is contained by 0.8 collides in some band with a chance of at least collision_probability(), over 0.999 in each class.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairway.llm.common import by_bytes, rows_as_bytes, tidy
from fairway.llm.licenses import TEMPLATES
from fairway.llm.textstream import Tokens, mix, shingles, tokens

#: Bytes of templates that may be read from a table.
TEMPLATE_BYTES = 64 << 20
#: Words of a shingle, MinHash bands, and shingles of the smallest block.
WORDS, BANDS, BLOCK = 5, 64, 4
_ODD = mix(np.arange(1, BANDS + 1, dtype=np.uint64)) | np.uint64(1)
_FLIP = mix(np.arange(1001, BANDS + 1001, dtype=np.uint64))


def size_class(words: int) -> int:
    """The least power of two, from 8 on, of at least so many words."""
    return max(8, 1 << (words - 1).bit_length())


def blocks_of(size: int) -> int:
    """Smallest blocks in half a window of the class."""
    return max(1, -(-(size - WORDS + 1) // BLOCK))


def collision_probability(size: int, words: int, containment: float = 0.8) -> float:
    """Least chance that a window with this much of a template of `words` words shares a band with it."""
    shared = max(1, np.ceil(containment * (words - WORDS + 1)))
    union = 2 * BLOCK * blocks_of(size) + (words - WORDS + 1) - shared
    return 1 - (1 - shared / union) ** BANDS


def _words(text: bytes, t: Tokens, first: int, end: int) -> list[bytes]:
    """Words `first` to `end` of all tokens, which lie in one text."""
    if first >= end:
        return []
    base = int(t.start[first])
    low = text[base : int(t.end[end - 1])].lower()
    return [low[a - base : b - base] for a, b in zip(t.start[first:end].tolist(), t.end[first:end].tolist())]


def word_shingles(words: list[bytes]) -> list[bytes]:
    return [b" ".join(words[i : i + WORDS]) for i in range(len(words) - WORDS + 1)]


class Index:
    """The templates' shingles and MinHashes by class."""

    def __init__(self, templates: dict[str, str], containment: float):
        self.containment = containment
        self.shingles: dict[str, dict[bytes, int]] = {}
        self.classes: dict[int, list[tuple[str, np.ndarray]]] = defaultdict(list)
        for name, text in templates.items():
            data = text.encode()
            t = tokens(pa.array([data], pa.binary()), lower=True, punctuation=False)
            words = _words(data, t, 0, len(t.hashes))
            if len(words) < WORDS:
                raise ValueError(f"template {name} has fewer than {WORDS} words")
            own: dict[bytes, int] = {}
            for i, s in enumerate(word_shingles(words)):
                own.setdefault(s, i)
            self.shingles[name] = own
            h, _ = shingles(t, WORDS)
            self.classes[size_class(len(words))].append((name, np.array([((h ^ f) * o).min() for f, o in zip(_FLIP, _ODD)])))

    def windows(self, h: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, int, str]]:
        """(first shingle, end, template) of each window that shares a band with a template."""
        if not len(h):
            return
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        place = np.arange(len(h)) - np.repeat(first, np.diff(np.r_[first, len(h)]))
        block = np.flatnonzero(place % BLOCK == 0)
        number = place[block] // BLOCK
        levels = {}
        for size in self.classes:
            half = np.flatnonzero(number % blocks_of(size) == 0)
            same = owner[block[half[1:]]] == owner[block[half[:-1]]]
            levels[size] = (half, same, np.zeros((len(half), len(self.classes[size])), bool))
        for f, o, band in zip(_FLIP, _ODD, range(BANDS)):
            low = np.minimum.reduceat((h ^ f) * o, block)
            for size, (half, same, hit) in levels.items():
                m = np.minimum.reduceat(low, half)
                m[:-1] = np.where(same, np.minimum(m[:-1], m[1:]), m[:-1])
                for j, (_, least) in enumerate(self.classes[size]):
                    hit[:, j] |= m == least[band]
        for size, (half, same, hit) in levels.items():
            start = block[half]
            stop = np.r_[start[1:], len(h)]
            stop[:-1] = np.where(same, np.r_[start[2:], len(h)], stop[:-1])
            for i, j in zip(*np.nonzero(hit)):
                yield int(start[i]), int(stop[i]), self.classes[size][j][0]

    def matches(self, texts: list[bytes], t: Tokens) -> Iterator[tuple[int, str, int, int, float]]:
        """(row, template, first word, end word, containment) of the verified matches."""
        h, at = shingles(t, WORDS)
        owner = t.owner[at]
        regions: dict[tuple[int, str], list[list[int]]] = defaultdict(list)
        for a, b, name in self.windows(h, owner):
            runs = regions[int(owner[a]), name]
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(b, runs[-1][1])
            else:
                runs.append([a, b])
        for (row, name), runs in sorted(regions.items()):
            base, words, end = int(np.searchsorted(owner, row)), *np.searchsorted(t.owner, [row, row + 1]).tolist()
            own = self.shingles[name]
            span = 2 * len(own) + 2 * WORDS
            around: list[list[int]] = []
            for a, b in runs:
                a, b = max(0, a - base - span), min(b - base + span, end - words - WORDS + 1)
                if around and a <= around[-1][1]:
                    around[-1][1] = max(b, around[-1][1])
                else:
                    around.append([a, b])
            for a, b in around:
                found = word_shingles(_words(texts[row], t, words + a, words + b + WORDS - 1))
                hits = [(i, k) for i, s in enumerate(found, a) if (k := own.get(s)) is not None]
                for first, last, n in occurrences(hits, self.containment * len(own) - 1e-9, span, len(own)):
                    yield row, name, first, last + WORDS, round(n / len(own), 6)


def occurrences(hits: list[tuple[int, int]], least: float, span: int, length: int) -> list[tuple[int, int, int]]:
    """(first, last, distinct shingles) of runs of `hits` (place, shingle; by place) with `least` distinct shingles or more.

    A run is `span` places long at most, whatever the order of its shingles, and runs do not overlap. From the
    first run that has enough on, until `length` places bring no more shingles, the one with the most is taken, then the
    shortest; what lies before it and after it is searched for itself.
    """
    out, todo = [], [(0, len(hits))]
    while todo:
        start, stop = todo.pop()
        count: dict[int, int] = defaultdict(int)
        best, horizon, low, begin = None, None, start, start
        for r in range(start, stop):
            place, k = hits[r]
            if horizon is not None and place > horizon:
                break
            count[k] += 1
            while place - hits[low][0] > span or count[hits[low][1]] > 1:
                old = hits[low][1]
                count[old] -= 1
                if not count[old]:
                    del count[old]
                low += 1
            if len(count) >= least:
                if best is None:
                    begin = low
                if best is None or -len(count) < best[0]:
                    horizon = place + length
                now = (-len(count), place - hits[low][0], low, r)
                best = now if best is None else min(best, now)
        if best is not None:
            out.append((hits[best[2]][0], hits[best[3]][0], -best[0]))
            todo += [(best[3] + 1, stop), (begin, best[2])]
    return sorted(out)


def read_templates(df: DataFrame, name_col: str = "path", text_col: str = "value") -> dict[str, str]:
    """Templates from rows (name, text), for example of spark.read.text(folder, wholetext=True) with the path; whole licenses may be among them.

    They go to every task, so more than TEMPLATE_BYTES of them are refused. Texts of fewer than WORDS words are left out.
    """
    size = df.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    if size > TEMPLATE_BYTES:
        raise ValueError(f"{size} bytes of templates, at most {TEMPLATE_BYTES}")
    rows = df.where(F.col(name_col).isNotNull() & F.col(text_col).isNotNull()).select(name_col, text_col).collect()
    return {r[0]: r[1] for r in sorted(rows) if len(tokens(pa.array([r[1]]), punctuation=False).hashes) >= WORDS}


def _scan(templates: dict[str, str], containment: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, containment)
        for batch in by_bytes(batches, "text", 1 << 20):
            t = tokens(batch.column(1), lower=True, punctuation=False)
            rows = list(index.matches(rows_as_bytes(batch.column(1)), t))
            if rows:
                row, name, a, b, c = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(name), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c)], names=["id", "template", "start_word", "end_word", "containment"])

    return run


def license_matches(df: DataFrame, templates: dict[str, str] = TEMPLATES, containment: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, template, start_word, end_word, containment) per match: at least this share of the template's distinct 5-word shingles.

    The shingles of a match may come in any order, within about twice the template's length; matches of a template do not
    overlap. Words are runs of letters and digits, A-Z lower-cased. A row without matches, or with a null text, gives none; a row
    may match several templates, and one several times. Null ids and repeated rows pass through; other columns are ignored.
    """
    kind = df.schema[id_col].dataType.simpleString()
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(tidy(_scan(templates, containment)), f"id {kind}, template string, start_word long, end_word long, containment double").withColumnRenamed("id", id_col)
