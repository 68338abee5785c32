"""The pipeline's stages on the smallest tables, and the registry."""

import os
import re
import threading

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from fairway.llm import exact_dedup, registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    first, columns = docs, docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 3:
            assert out.columns == columns and out.exceptAll(docs).count() == 0, name
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
            before, after = ({r.doc_id: r.text for r in x.collect()} for x in (docs, out))
            if k == 0:
                assert not [i for i in after if labels.get(i) == 0] and not [i for i in before if labels.get(i) == 1 and i not in after]
            if k == 1:
                low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
                best = {}
                for i, t in before.items():
                    best[low(t)] = max(i, best.get(low(t), -1))
                assert set(after) == set(best.values())
            docs = out
    kept = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in out.collect()} == kept
    assert len(kept) < first.count()
    assert corpus_pipeline.run(spark, DATA).count() == out.count()


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    show = lambda v: "" if pd.isna(v) else str(int(v)) if isinstance(v, float) else str(v)
    rows = lambda df: sorted([show(v) for v in r] for r in df[sorted(df.columns)].astype(object).values.tolist())
    assert rows(registry.QUERIES[name](spark, DATA).toPandas()) == rows(c.sql(registry.ORACLE_SQL[name]).df())


def test_one_query_for_each_operator():
    assert [int(re.match(r"op(\d+)_", q)[1]) for q in registry.QUERIES] == list(range(1, 14))


def test_a_run_leaves_the_tables_of_others(spark, monkeypatch):
    """Frames made before a run, or meanwhile by another thread, still read their tables after it."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    frames = [exact_dedup.exact_groups(docs)]

    def meanwhile(spark, docs, sf_dir):
        other = threading.Thread(target=lambda: frames.append(exact_dedup.exact_groups(docs)))
        other.start()
        other.join()
        return exact_dedup.exact_dedup(docs)

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("meanwhile", meanwhile), ("last", lambda spark, docs, sf_dir: docs)])
    assert corpus_pipeline.run(spark, DATA).count() > 0
    assert [f.count() for f in frames] == [docs.count()] * 2
