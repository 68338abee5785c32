"""Commits over several tables, and the database connector both ways."""

import threading

import pytest
from pyspark.sql import functions as F

from fairway.sources.store import Store, jdbc, jdbc_merge

ROLE = "id long, code string, name string"


def codes(store, name="sys_role"):
    return sorted(r.code if name == "sys_role" else r.username for r in store.read(name).collect())


def test_several_tables_or_none(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    role = lambda c: spark.createDataFrame([(None, c, c)], ROLE)
    user = lambda u: spark.createDataFrame([(None, u)], "id long, username string")
    with s.transaction() as t:
        t.append("sys_role", role("A"))
        assert t.read("sys_role").count() == 1 and s.read("sys_role").count() == 0
        t.append("sys_user", user("u"))
        t.append("sys_role", role("B"))
    assert codes(s) == ["A", "B"] and codes(s, "sys_user") == ["u"]
    with pytest.raises(ZeroDivisionError), s.transaction() as t:  # fails between two tables
        t.append("sys_role", role("C"))
        t.append("sys_user", user(str(1 // 0)))
    assert codes(s) == ["A", "B"] and codes(s, "sys_user") == ["u"]
    assert len(s._versions("sys_role")) == 2  # nothing is left of it
    with s.transaction() as t:
        t.delete("sys_role", t.read("sys_role").where("code = 'A'"))
        t.update("sys_user", t.read("sys_user").select("id", F.lit("v").alias("username")))
    assert codes(s) == ["B"] and codes(s, "sys_user") == ["v"]


def test_one_of_two_writers_wins(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.write("sys_role", spark.createDataFrame([(1, "A", "a")], ROLE))
    with pytest.raises(FileExistsError), s.transaction() as slow:
        slow.update("sys_role", slow.read("sys_role").select("id", F.lit("slow").alias("name")))
        slow.append("sys_user", spark.createDataFrame([(None, "u")], "id long, username string"))
        with s.transaction() as fast:
            fast.update("sys_role", fast.read("sys_role").select("id", F.lit("fast").alias("name")))
    assert s.read("sys_role").first().name == "fast" and s.read("sys_user").count() == 0
    with s.transaction() as one:  # writers of other tables don't disturb each other
        one.append("sys_role", spark.createDataFrame([(None, "B", "b")], ROLE))
        with s.transaction() as two:
            two.append("sys_user", spark.createDataFrame([(None, "w")], "id long, username string"))
    assert codes(s) == ["A", "B"] and codes(s, "sys_user") == ["w"]


def test_of_many_creators_one_makes_the_file(spark, tmp_path):
    s, made = Store(spark, str(tmp_path)), []
    threads = [threading.Thread(target=lambda k=k: made.append(s._create(f"{tmp_path}/_commits/000000000001", '{"by": %d}' % k))) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(made) == [False] * 7 + [True] and len(list((tmp_path / "_commits").glob("[!.]*"))) == 1


def test_marks(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    assert s.marked("stream") == -1
    with s.transaction() as t:
        t.mark("stream", 4)
    assert s.marked("stream") == 4
    with pytest.raises(FileExistsError), s.transaction() as slow:
        slow.mark("stream", 5)
        with s.transaction() as fast:
            fast.mark("stream", 5)
    s.write("sys_role", spark.createDataFrame([(1, "A", "a")], ROLE))
    s.write("sys_role", spark.createDataFrame([(2, "B", "b")], ROLE))
    s.vacuum("sys_role")
    assert s.marked("stream") == 5 and len(s._versions("sys_role")) == 1 and codes(s) == ["B"]


def test_database_round_trip(spark, tmp_path):
    """Derby comes with Spark: a table is made, read in ranges whose bounds are its own, merged by key, and read again."""
    url, options = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.range(100, 1100).select(F.col("id").alias("ID"), (F.col("id") * 2).alias("N"))
    jdbc_merge(rows.repartition(3), url, "NODES", ["ID"], **options)
    read = jdbc(spark, url, "NODES", "ID", parts=4, **options)
    assert read.rdd.getNumPartitions() == 4
    sizes = [len(p) for p in read.rdd.glom().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 260
    change = spark.createDataFrame([(100, -1), (100, -2), (5000, 7)], "ID long, N long")
    jdbc_merge(change, url, "NODES", ["ID"], **options)
    got = {r.ID: r.N for r in jdbc(spark, url, "NODES", **options).collect()}
    assert got == {i: 2 * i for i in range(101, 1100)} | {100: -1, 5000: 7}
    tables = jdbc(spark, url, "SYS.SYSTABLES", **options).where("TABLETYPE = 'T'")
    assert [r.TABLENAME for r in tables.collect()] == ["NODES"]  # no staging table stays
    with pytest.raises(Exception):
        jdbc_merge(spark.createDataFrame([(1, "x")], "ID long, NOTHERE string"), url, "NODES", ["ID"], **options)
    assert jdbc(spark, url, "NODES", **options).count() == 1001
    assert jdbc(spark, url, "NODES", "ID", low=0, high=600, parts=2, **options).rdd.getNumPartitions() == 2
