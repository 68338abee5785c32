"""Order within keys of any size: slices against plain windows."""

import datetime
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fairway.operators import changes, codes, governance, ordered, relational, routes

DAY = datetime.datetime(2024, 1, 1)


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def reports(spark):
    """Two thirds of all rows are of vessel 1; times repeat, some are null."""
    rnd = random.Random(4)
    made = [(i, rnd.choice([1, 1, 1, 1, 2, 3, None]), rnd.choice([None, "a", "b"]), None if rnd.random() < 0.02 else DAY + datetime.timedelta(minutes=rnd.randrange(1500))) for i in range(4000)]
    return spark.createDataFrame(made, "id long, vessel long, state string, ts timestamp").repartition(5).cache()


@pytest.mark.parametrize("slice_rows", [None, 300, 7])
def test_row_before(reports, slice_rows):
    w = Window.partitionBy("vessel").orderBy("ts", "id")
    plain = reports.withColumn("__prior", F.lag(F.struct("state")).over(w))
    assert rows(ordered.with_prior(reports, ["vessel"], ["ts", "id"], ["state"], slice_rows)) == rows(plain)


@pytest.mark.parametrize("slice_rows", [None, 300, 7])
def test_running_sums(reports, slice_rows):
    w = Window.partitionBy("vessel").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    plain = reports.withColumn("n", F.sum("id").over(w))
    assert rows(ordered.running_sum(reports, ["vessel"], ["ts", "id"], F.col("id"), "n", slice_rows)) == rows(plain)


def test_slices_follow_the_data(reports):
    cut, parts = ordered.sliced(reports, "ts", 500)
    sizes = [r["count"] for r in cut.groupBy("__slice").count().collect()]
    assert parts == 8 and max(sizes) < 750 and sum(sizes) == 4000
    assert ordered.sliced(reports, "state", 500)[1] == 1  # texts make one slice
    assert ordered.sliced(reports.withColumn("ts", F.lit(DAY)), "ts", 500)[0].count() == 4000


def test_a_hot_key_is_many_tasks(spark):
    """One vessel with all of 1e6 reports: no window holds more than about a slice of them."""
    events = spark.range(1_000_000).select(F.col("id"), F.lit(1).alias("k"), (F.col("id") * 37 % 1_000_003).alias("ts"), (F.col("id") % 3).alias("v"))
    cut, parts = ordered.sliced(events, "ts", 125_000)
    most = cut.groupBy("k", "__slice").count().agg(F.max("count")).first()[0]
    assert parts == 8 and most < 200_000
    got = governance.change_log(events, "k", "v", "ts", "id", slice_rows=125_000)
    w = Window.partitionBy("k").orderBy("ts", "id")
    plain = events.withColumn("o", F.lag("v").over(w)).where("o IS NOT NULL AND o <> v")
    digest = lambda df, *c: df.agg(F.count("*"), F.sum(F.hash(*c).cast("long"))).first()
    assert digest(got, "k", "old_value", "new_value", "changed_at") == digest(plain, "k", "o", "v", "ts")


def test_change_log_of_nulls(reports):
    plain = governance.change_log(reports, "vessel", "state")
    assert rows(plain) == rows(governance.change_log(reports, "vessel", "state", slice_rows=50)) and plain.count() > 100


def test_long_routes(spark):
    nodes = spark.range(50).select("id", (F.col("id") % 7 + 30.0).alias("latitude"), (F.col("id") % 11 + 110.0).alias("longitude"))
    path = spark.range(600).select(F.when(F.col("id") < 500, 1).otherwise(2).alias("route_id"), F.col("id").alias("sequence"), (F.col("id") * 13 % 50).alias("node_id"))
    a, b = (sorted((r.route_id, r.sequence, round(r.leg_km, 6), round(r.distance_from_start, 6)) for r in routes.distances(path, nodes, n).collect()) for n in (None, 40))
    assert a == b and len(a) == 600


@pytest.mark.parametrize("size, run", [(1_000_000, 65_536), (9, 4)])
def test_numbers_are_dense(spark, monkeypatch, size, run):
    monkeypatch.setattr(ordered, "SLICE_ROWS", size)
    monkeypatch.setattr(ordered, "RUN", run)
    made = [("x", None)] * 70 + [(None, 1)] * 5 + [(str(i), i) for i in range(60)]
    df = spark.createDataFrame(made, "a string, b int")
    got = ordered.numbered(df, "n").collect()
    assert sorted(r.n for r in got) == list(range(1, 136)) and sorted(str((r.a, r.b)) for r in got) == sorted(map(str, made))
    assert ordered.numbered(df.where("false"), "n").count() == 0


def test_new_ids(spark):
    old = spark.createDataFrame([(3, "a"), (9, "b")], "id long, name string")
    new = spark.createDataFrame([(None, "c"), (None, "c"), (20, "d"), (None, "e")], "id long, name string")
    got = changes.with_new_ids(new, old).collect()
    assert sorted(r.id for r in got) == [20, 21, 22, 23] and sorted(r.name for r in got) == ["c", "c", "d", "e"]
    assert {r.id for r in got if r.name == "d"} == {20}


def test_many_ids(spark):
    new = spark.range(2_000_000).select(F.lit(None).cast("long").alias("id"), (F.col("id") % 900_000).alias("v"))
    got = changes.with_new_ids(new, new.limit(0)).agg(F.min("id"), F.max("id"), F.count_distinct("id")).first()
    assert tuple(got) == (1, 2_000_000, 2_000_000)


def test_numbers_of_few_values_are_many_tasks(spark):
    df = spark.range(6_000_000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("flag"))
    got = ordered.numbered(df, "n").groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("rows"), F.min("n").alias("least"), F.max("n").alias("most")).collect()
    assert sum(r.rows for r in got) == 6_000_000 and min(r.least for r in got) == 1 and max(r.most for r in got) == 6_000_000
    assert len(got) == 6 and max(r.rows for r in got) < 2_000_000  # all rows of a value were one task's


def test_codes_below_a_large_parent(spark, monkeypatch):
    monkeypatch.setattr(ordered, "SLICE_ROWS", 50)
    old = spark.createDataFrame([(1, "长江", 1, None, "01-01-007")], "id long, name string, level int, parent_id long, code string")
    new = spark.range(10, 310).select("id", F.lit("支流").alias("name"), F.lit(2).alias("level"), F.when(F.col("id") < 250, 1).cast("long").alias("parent_id"))
    got = {r.id: r.code for r in codes.allocate(new, old, ["id"]).collect()}
    assert [got[i] for i in (10, 11, 249)] == ["01-02-001", "01-02-002", "01-02-240"]
    assert [got[i] for i in (250, 309)] == ["01-01-008", "01-01-067"]


def test_a_batch_that_names_a_key_twice(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id long, name string, n int")
    new = spark.createDataFrame([(1, "c", 1), (1, "d", 0), (3, "e", 5), (3, "e", 5)], "id long, name string, n int")
    assert sorted(map(tuple, changes.upsert(old, new, ["id"]).collect())) == [(1, "d", 0), (2, "b", 0), (3, "e", 5)]
    assert sorted(map(tuple, changes.update_rows(old, new, ["id"]).collect())) == [(1, "d", 0), (2, "b", 0)]


@pytest.mark.parametrize("slice_rows", [None, 60])
def test_children_in_parts(spark, slice_rows):
    parents = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, name string")
    children = spark.range(500).select(F.when(F.col("id") < 470, 1).otherwise(2).alias("pid"), (F.col("id") * 7 % 500).alias("n"))
    got = relational.nested_parts(parents, children, "id", "pid", ["n"], size=40, slice_rows=slice_rows).orderBy("id", "part").collect()
    assert [(r.id, r.part, len(r.children)) for r in got] == [(1, k, 40) for k in range(11)] + [(1, 11, 30), (2, 0, 30), (3, 0, 0)]
    assert [c.n for r in got if r.id == 1 for c in r.children] == sorted(i * 7 % 500 for i in range(470))
