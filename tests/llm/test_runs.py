"""Periodic runs against their definition."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fairway.llm import registry, runs
from fairway.llm.common import table


def brute(words, least=12):
    """Maximal stretches with each period, and of equal stretches the smallest period."""
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def dropped(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def of(texts, least):
    codes = np.array([c for t in texts for c in t], np.int64)
    bounds = np.r_[0, np.cumsum([len(t) for t in texts], dtype=np.int64)]
    out = [[] for _ in texts]
    for t, *r in zip(*(x.tolist() for x in runs.find_runs(codes, bounds, least))):
        out[t].append(tuple(r))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=4), st.sampled_from([2, 5, 12]))
def test_random(texts, least):
    assert of(texts, least) == [brute(t, least) for t in texts]


@pytest.mark.parametrize("pick", ["fibonacci", "one", "squares", "nested", "lines"])
def test_repetitive(pick):
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    rnd = random.Random(1)
    line = [rnd.randrange(50) for _ in range(37)]
    words = {"fibonacci": b, "one": [0] * 700, "squares": [0, 0, 1, 1] * 40 + [2] * 9 + [0, 1] * 30, "nested": ([0] * 9 + [1]) * 12 + [3] + ([0] * 9 + [1]) * 12, "lines": (line * 3 + [99, 98]) * 4 + line[:20]}[pick]
    assert of([words, words[::-1]], 12) == [brute(words), brute(words[::-1])]


def test_leaves_in_slices(monkeypatch):
    monkeypatch.setattr(runs, "LEAVES", 7)
    rnd = random.Random(3)
    words = [rnd.randrange(2) for _ in range(500)]
    assert of([words], 6) == [brute(words, 6)]


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    four = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(found), *four, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(dropped(words, found))))


def test_query(spark):
    got = registry.QUERIES["op13_runs"](spark, "/root/testdata/sf0.001")
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(expected(*r) for r in docs)


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "la " * 12), (5, "la " * 12), (None, "la " * 30), (6, "la " * 11), (7, "a\u00a0b " * 13), (8, "\x0b".join(["x", "y"] * 9)), (30, "w " * 100)]


def test_odd_rows(spark):
    plain = spark.createDataFrame(ODD, "doc_id long, text string")
    got = [tuple(r) for r in runs.run_digests(plain, rewrite=True).collect()]
    assert sorted(map(str, got)) == sorted(str(expected(*r)) for r in ODD)
    clash = plain.selectExpr("*", "1 AS id", "'x' AS start", "2 AS n_runs", "3 AS period")
    assert sorted(map(str, runs.run_digests(clash, rewrite=True).collect())) == sorted(map(str, runs.run_digests(plain, rewrite=True).collect()))
    none = plain.where("false")
    assert [f(none).count() for f in (runs.periodic_runs, runs.collapsed, runs.run_digests)] == [0, 0, 0]
    listed = {(r.doc_id, r.start, r.length, r.period) for r in runs.periodic_runs(plain).collect()}
    assert listed == {(5, 0, 12, 1), (None, 0, 30, 1), (7, 0, 13, 1), (8, 0, 18, 2), (30, 0, 100, 1)}
    assert {r.doc_id: r.text for r in runs.collapsed(plain).collect()} == {1: "", 2: "", 3: "", 4: "a", 5: "la", None: "la", 6: " ".join(["la"] * 11), 7: "a\u00a0b", 8: "x y", 30: "w"}


def test_very_long_text(spark):
    rnd = random.Random(5)
    words = [str(rnd.randrange(2000)) for _ in range(300_000)]
    text = " ".join(words[:200_000] + words[100_000:200_000] + ["echo"] * 200_000 + words)
    got = {(r.start, r.length, r.period) for r in runs.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    assert {(300_000, 200_000, 1)} <= got
    assert (100_000, 200_000, 100_000) in got
