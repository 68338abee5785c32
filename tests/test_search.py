"""Keyword search by trigrams equals ILIKE; pages by cursor."""

import random

import pytest
from pyspark.sql import functions as F

from fairway.operators import relational as R, search


@pytest.fixture(scope="module")
def names(spark):
    rnd = random.Random(3)
    part = ["red", "green", "Rod", "gear", "武汉", "港口", "a%b", "x_y", "GEAR", "ÄÖ", "1", "", "back\\slash"]
    rows = [(i, " ".join(rnd.choice(part) for _ in range(rnd.randint(0, 4))), rnd.choice([None, "Brand#12", "red"])) for i in range(400)]
    return spark.createDataFrame(rows, "id long, name string, brand string").cache()


@pytest.mark.parametrize("word", ["red", "RED", "r_d%g", "gear", "%ear%red", "武汉港", "武汉 港口", "a%b", "1", "ra", "nothing", "ear r", "äö", "", None, "%", "___", "r\\_d"])
def test_equals_ilike(spark, tmp_path, names, word):
    posted = search.write_postings(names, ["name", "brand"], f"{tmp_path}/p")
    got = search.search(names, posted, ["name", "brand"], word)
    want = names.where(R.keyword(["name", "brand"], word))
    assert got.columns == names.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_grams():
    assert search.literal_grams("r_d%gear") == ["ear", "gea"] and search.literal_grams("ab%cd") == []
    assert search.literal_grams("a\\%bC") == ["%bc", "a%b"] and search.literal_grams("RED") == ["red"]


def test_few_rows_meet_the_pattern(spark, tmp_path, names):
    posted = search.write_postings(names, ["name"], f"{tmp_path}/p")
    found = search.candidate_ids(posted, "green gear").count()
    assert 0 < found < 60
    plan = posted.where((F.col("bucket") == 3) & (F.col("gram") == "red"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(gram,red)" in plan


def test_names_and_aliases(spark, tmp_path, names):
    nodes = names.select("id", "name")
    aliases = names.select((F.col("id") * 3).alias("id"), (F.col("id") % 50).alias("node_id"), F.col("name").alias("alias_name"))
    a, b = search.write_postings(nodes, ["name"], f"{tmp_path}/n"), search.write_postings(aliases, ["alias_name"], f"{tmp_path}/a")
    for word in ("gear", "武汉 港", "1"):
        got, want = search.by_name_or_alias_indexed(nodes, aliases, a, b, word), R.by_name_or_alias(nodes, aliases, word)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("order", [[("brand", False), ("id", False)], [("brand", True), ("name", False), ("id", True)], [("id", True)]])
def test_cursors_give_each_row_once(names, order):
    seen, cursor = [], None
    while True:
        page = R.page_after(names, order, cursor, 37)
        rows = page.collect()
        if not rows:
            break
        seen += [r.id for r in rows]
        cursor = R.cursor_of(page, order)
    want = [r.id for r in names.orderBy(*[F.desc(c) if d else F.asc(c) for c, d in order]).collect()]
    assert seen == want and R.cursor_of(names.limit(0), order) is None


def test_deep_pages_stay_a_top_n(names):
    page = R.page_after(names.coalesce(2), [("brand", True), ("id", True)], {"brand": "red", "id": 100}, 20)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Offset" not in plan
