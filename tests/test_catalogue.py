"""Every query with SQL equals DuckDB on the smallest tables."""

import difflib
import os
import random

import duckdb
import pandas as pd
import pytest

from fairway.plans import catalogue, stored
from fairway.sources.store import new_folder

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLE_SQL = {**catalogue.QUERIES, **stored.QUERIES}, {**catalogue.ORACLE_SQL, **stored.ORACLE_SQL}
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


def plain(df: pd.DataFrame) -> list[tuple]:
    show = lambda v: "" if pd.isna(v) else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    if name == "q44_audit":  # an id column with nulls is a float on one side
        ours["auditor_id"], theirs["auditor_id"] = ours["auditor_id"].astype("Int64"), theirs["auditor_id"].astype("Int64")
    assert plain(ours) == plain(theirs)


def test_pruning_changes_nothing(spark):
    a, b = (plain(catalogue.QUERIES[q](spark, DATA).toPandas()) for q in ("q39_match_entities", "q41_match_unpruned"))
    assert a and a == b


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_similarity_in_sql():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcä港") for _ in range(rng.randint(1, 14)))
    pairs = sorted({(word(), word()) for _ in range(600)} | {("tide", "diet"), ("diet", "tide"), ("abcabc", "abcabc")})
    c = duckdb.connect()
    c.register("pairs", pd.DataFrame(pairs, columns=["a", "b"]))
    found = dict(((a, b), r) for a, b, r in c.sql(f"WITH RECURSIVE {catalogue._ratios('SELECT a, b FROM pairs')} SELECT * FROM ratio").fetchall())
    ratio = {p: difflib.SequenceMatcher(None, *p).ratio() for p in pairs}
    assert all(found[p] == r for p, r in ratio.items() if p in found)
    assert all(p in found for p, r in ratio.items() if r >= 0.5)


def test_new_folders_are_shared_and_new(spark):
    a, b = new_folder(spark, "x"), new_folder(spark, "x")
    assert a != b and a.startswith(spark.conf.get("spark.checkpoint.dir"))
