"""Exact top-k search against all inner products."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from fairway.llm import topk


def brute(rows, k=5, every=50, scale=256):
    """The definition, in Python's own integers."""
    fine = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(Fraction(x) * scale) for x in v]) for i, v in fine]
    out = []
    for a, (q, w) in enumerate(whole):
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(w, u)), i) for b, (i, u) in enumerate(whole) if a != b)
            out += [(q, r, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    return sorted(map(tuple, topk.top_k(df, **options).collect()))


@pytest.mark.parametrize("shards", [None, 1, 5])
def test_random(spark, monkeypatch, shards):
    monkeypatch.setattr(topk, "BLOCK", 64)
    rnd = random.Random(1)
    pool = [[rnd.choice([0.0, rnd.gauss(0, 0.2), -1 / 512]) for _ in range(rnd.choice([8, 8, 8, 3]))] for _ in range(150)]
    rows = [(i, rnd.choice(pool)) for i in range(700)]  # many ties
    assert found(spark, rows, shards=shards) == brute(rows)
    assert found(spark, rows, shards=shards, k=1, every=7, scale=3) == brute(rows, 1, 7, 3)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (50, []), (100, None), (150, [1.0, None]), (200, [nan, 1.0]), (250, [inf]), (None, [9.0, 9.0]), (-50, [-1.0]), (3, [0.5, 0.5, 7.0]), (4, [-0.001, 1.0])]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == [] and found(spark, [(50, [1.0])]) == []
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    clash = df.selectExpr("*", "1 AS rid", "2 AS rank", "'x' AS vector", "3 AS shard", "4 AS score")
    assert sorted(map(tuple, topk.top_k(clash).collect())) == brute(rows)


def test_huge_components(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.choice([-1, 1]) * rnd.random() * 10.0 ** rnd.choice([1, 9, 15, 150]) for _ in range(4)]) for i in range(120)]
    assert found(spark, rows) == brute(rows)
    mid = [(i, [rnd.choice([-1, 1]) * rnd.random() * 1e6 for _ in range(4)]) for i in range(120)]
    assert found(spark, mid) == brute(mid)


def test_weights_are_floors():
    x = np.array([0.0, 0.999, -0.001, 1 / 256, -1 / 256, 3.7])
    assert topk.whole_weights(x, 256).tolist() == [math.floor(256 * v) for v in x]
    assert topk.whole_weights(np.array([1e300, -2.5]), 256).tolist() == [int(1e300) * 256, -640]
