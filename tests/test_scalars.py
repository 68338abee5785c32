"""Scalar functions on the vectors of the rules."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from fairway.functions import scalars as X


def one(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_clean_text(spark):
    assert one(spark, ["  a　b ，c。\n", None, "", " \t "], X.clean_text) == ["a b ,c.", "", "", ""]


def test_phone(spark):
    assert one(spark, ["tel 0138001380001", "12345678901", "", None, "联系13800138000"], X.extract_phone) == ["13800138000", None, None, None, "13800138000"]


def test_tonnage(spark):
    texts = ["2万吨", "1.5万吨", "3千吨", "5000吨", "1,200吨", "约3.2千吨", "3万", "无", None, ""]
    assert one(spark, texts, X.normalize_tonnage) == [20000.0, 1.5, 3000.0, 5000.0, 1.0, 3.2, 3.0, None, None, None]
    assert one(spark, texts, lambda c: X.normalize_tonnage(c, "fixed")) == [20000.0, 15000.0, 3000.0, 5000.0, 1200.0, 3200.0, 30000.0, None, None, None]


def test_dates(spark):
    assert [str(d) for d in one(spark, ["2026-01-02", "2026-13-01", "x", None], X.safe_date)] == ["2026-01-02", "None", "None", "None"]


def test_haversine(spark):
    df = spark.createDataFrame([(32.0617, 118.7778, 30.5928, 114.3055), (29.5630, 106.5516, 31.2304, 121.4737)], "a double, b double, c double, d double")
    km = X.haversine_km(*map(F.col, "abcd"))
    got = df.select(F.round(km, 2), F.round(X.waterway_km(km), 2)).collect()
    assert [tuple(r) for r in got] == [(455.07, 682.6), (1442.01, 2163.01)]


def test_json_rescue(spark):
    got = one(spark, ['```json\n{"k": 1}\n```', "say {\"k\": 2} ok", "none", None], lambda c: X.json_rescue(c, "k int")["k"])
    assert got == [1, 2, None, None]


def test_override(spark):
    df = spark.createDataFrame([(1, 5), (0, 5), (None, 5)], "a int, b int")
    assert [r[0] for r in df.select(X.override(F.col("a"), F.col("b"))).collect()] == [1, 5, 5]


def test_means(spark):
    df = spark.createDataFrame([(85, 80, None)], "a int, b int, c int")
    assert df.select(X.mean_truncated(F.col("a"), F.col("b"), F.col("c")), X.pair_mean(F.col("a"), F.col("b"))).first() == (55, 82)


@pytest.mark.parametrize("seed", [1, 2])
def test_ratio_and_its_bound(spark, seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 12)))
    pairs = [("tide", "diet"), ("diet", "tide"), ("ab" * 150, "ba" * 150), *[(word(), word()) for _ in range(5000)]]
    df = spark.createDataFrame(pairs, "a string, b string")
    for a, b, r, bound in df.select("a", "b", X.similarity_ratio("a", "b"), X.ratio_bound(F.col("a"), F.col("b"))).collect():
        assert r == (SequenceMatcher(None, a, b).ratio() if a and b else 0.0)
        assert r <= bound + 1e-12
