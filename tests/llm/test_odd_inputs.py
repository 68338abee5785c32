"""Very long texts, empty tables and clashing names, through every operator that reads texts."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from fairway.llm import bpe_codec, exact_dedup, importance, license_scan, media, packing, registry, simhash, token_counts, url_filter, warc
from fairway.llm.bpe import VOCABULARY
from fairway.llm.common import bounded
from fairway.llm.licenses import TEMPLATES

COLUMNS = "doc_id long, text string"


@pytest.fixture(scope="module")
def long(spark):
    """A text of 20 MB with a license in its middle, a near copy, one word of 3 MB, and a short text."""
    bounded(spark)
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9))) for _ in range(3000)]
    half = " ".join(rnd.choice(words) for _ in range(1_560_000))
    text = f"{half} {TEMPLATES['mit']} {half[:10_000]}{half}"
    rows = [(1, text), (2, text + " and more"), (3, "x" * 3_000_000), (4, "one two three"), (5, None)]
    assert len(text) > 20_000_000
    return rows, spark.createDataFrame(rows, COLUMNS).repartition(3).cache()


def test_very_long_texts(spark, long):
    rows, df = long
    texts = {i: t or "" for i, t in rows}
    counts = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.token_counts(df, VOCABULARY).collect()}
    assert {i: c[0] for i, c in counts.items()} == {i: len(t) for i, t in texts.items()}
    coded = {r.doc_id: r.n_tokens for r in bpe_codec.round_trip(df.where("doc_id <> 3"), VOCABULARY).collect()}
    assert coded == {i: c[1] for i, c in counts.items() if i != 3}
    pieces = packing.pack(df.where("doc_id <> 3"), VOCABULARY).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n - 1 for r in pieces} == coded
    assert {r.id for r in simhash.fingerprints(df).where("fp <> 0").collect()} >= {1, 2, 3, 4}
    assert {r.doc_id for r in simhash.near_dedup(df).collect()} == {1, 3, 4, 5}
    found = {(r.doc_id, r.template) for r in license_scan.license_matches(df).collect()}
    assert {(1, "mit"), (2, "mit")} <= found and not [x for x in found if x[0] > 2]
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    assert importance.resample(df, labels).count() == 5
    groups = {r.doc_id: r.text_sha256 for r in exact_dedup.exact_groups(df).collect()}
    assert groups == {i: hashlib.sha256(t.lower().encode()).hexdigest() for i, t in texts.items()}
    shown = {r.doc_id: r.payload_bytes for r in media.text_media(df.where("doc_id in (1, 4)")).collect()}
    assert shown == {1: -(-len(texts[1]) // 576) * 576, 4: 576}
    pages = df.where("doc_id <> 3").select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    read = {r.page_id: (r.payload_bytes, r.error) for r in warc.read_archives(warc.write_archives(pages), payloads=False).collect()}
    assert read == {i: (len(t), None) for i, t in texts.items() if i != 3}


def test_empty_tables(spark):
    none = spark.createDataFrame([], COLUMNS)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for out in (
        token_counts.token_counts(none, VOCABULARY),
        bpe_codec.encode(none, VOCABULARY),
        bpe_codec.decode(bpe_codec.encode(none, VOCABULARY), VOCABULARY),
        bpe_codec.round_trip(none, VOCABULARY),
        packing.pack(none, VOCABULARY),
        simhash.near_duplicates(none),
        license_scan.license_matches(none),
        importance.resample(none, labels),
        media.text_media(none),
        warc.read_archives(warc.write_archives(pages)),
        url_filter.judge(pages, url_filter.train(url_filter.seeded_labels(pages, registry.BAD_HOSTS)), registry.URL_RULES),
    ):
        assert out.count() == 0


@pytest.mark.parametrize("clash", [["id", "ids", "text_", "n_tokens", "n_bytes", "piece", "part", "rank", "length"], ["media", "key", "error", "template", "containment", "payload_bytes", "__text", "__weight"]])
def test_clashing_names(spark, clash):
    plain = spark.createDataFrame([(1, "one two three four five six"), (None, None), (3, "")], COLUMNS)
    df = plain.withColumns({c: F.lit("x") for c in clash})
    for run in (
        lambda d: token_counts.token_counts(d, VOCABULARY),
        lambda d: bpe_codec.round_trip(d, VOCABULARY),
        lambda d: packing.pack(d, VOCABULARY).drop("sequence_id", "offset"),
        simhash.simhash_components,
        simhash.near_duplicates,
        license_scan.license_matches,
        exact_dedup.exact_groups,
        media.text_media,
    ):
        assert sorted(map(str, run(df).collect())) == sorted(map(str, run(plain).collect()))
