"""Quality classifier by importance resampling.

Two generative models over hashed word and word-pair counts, one of good labelled texts and one of all texts: the log
importance weight of a text is the sum of the log-ratios of its n-grams. A word that follows itself is one n-gram of its
own, whatever the word. Gumbel top-k samples k texts without replacement in proportion to weight ** (1 / temperature).
Where k is not given it is the number of texts whose weight reaches the cut that separates the labelled texts best, a good
text lost counting as much as COST bad ones caught: weights and noise are on one scale, so near the cut the noise decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairway.llm.common import by_bytes, materialise, tidy
from fairway.llm.textstream import mix, shingles, tokens

#: Buckets of hashed n-grams; labelled rows of each class that fit the model and the cut, at most.
BUCKETS, LABELLED = 1 << 14, 20_000
#: The cost of a good text lost, in bad ones caught.
COST = 20
#: Steps of a key in one unit, and bins of one pass of the selection.
STEPS, BINS = 1_000_000, 4096


def _buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word, word pair and repeated word of the texts."""
    t = tokens(texts)
    pair, at = shingles(t, 2)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    w = np.flatnonzero(t.words)
    again = w[1:][(t.hashes[w[1:]] == t.hashes[w[:-1]]) & (t.owner[w[1:]] == t.owner[w[:-1]])]
    rows = np.concatenate([t.owner, t.owner[at], t.owner[again]])
    return rows, np.concatenate([mix(t.hashes) >> shift, pair >> shift, np.zeros(len(again), np.uint64)]).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of this partition's buckets, in all texts and in those with quality 1."""
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in by_bytes(batches, "text", 1 << 19):
        row, bucket = _buckets(batch.column(0))
        raw += np.bincount(bucket, minlength=BUCKETS)
        good = pc.fill_null(batch.column(1), -1).to_numpy(zero_copy_only=False) == 1
        target += np.bincount(bucket[good[row]], minlength=BUCKETS)
    if raw.any():
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(raw), pa.array(target)], names=["bucket", "raw", "target"])


def labelled_sample(labels: DataFrame, limit: int = LABELLED, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(id, quality) of at most `limit` labelled ids of each class, the first by hash; contradicting labels count as 0."""
    one = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__lid")).agg(F.min(label_col).cast("int").alias("__quality"))
    parts = [one.where(F.col("__quality") == q).orderBy(F.xxhash64("__lid"), "__lid").limit(limit) for q in (0, 1)]
    return materialise(parts[0].unionByName(parts[1]), "quality-labels")


def fit(df: DataFrame, sample: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """log(target / raw) of each bucket: raw counts over all of `df`, target counts over its labelled good texts."""
    texts = df.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text"))
    marked = texts.join(F.broadcast(sample), F.col("__id") == F.col("__lid"), "left").select("text", "__quality")  # 2 * LABELLED rows at most
    counts = marked.mapInArrow(tidy(_count), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()  # BUCKETS rows at most
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for r in counts:
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    if target.sum() == BUCKETS:  # nothing labelled as good: no text is preferred
        return np.zeros(BUCKETS)
    # the smaller table is smoothed by the larger one's shares, so that rare n-grams say little
    share = raw / raw.sum()
    prior = max(1.0, 0.01 * target.sum())
    return np.log((target - 1 + prior * share) / (target.sum() - BUCKETS + prior)) - np.log(share)


def _score(model, fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = model.value
        for batch in by_bytes(batches, "__text", 1 << 19):
            row, bucket = _buckets(batch.column("__text"))
            weight = np.bincount(row, ratio[bucket], batch.num_rows).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in fields), pa.array(np.round(weight, 6))], names=[*fields, "__weight"])

    return run


def weighted(df: DataFrame, ratio: np.ndarray, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` of `df` (all of them if None) and __weight: the sum of the log-ratios of each text's n-grams.

    Texts without n-grams, and null, weigh 0. A column of `df` named __weight gives way to the new one.
    """
    model = df.sparkSession.sparkContext.broadcast(ratio)
    named = [c for c in (df.columns if carry is None else carry) if c != "__weight"]
    fields = [f"c{i}" for i in range(len(named))]
    plain = df.select(*[df[c].alias(f) for c, f in zip(named, fields)], df[text_col].cast("string").alias("__text"))
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in plain.schema if f.name != "__text")
    return plain.mapInArrow(tidy(_score(model, fields)), f"{kinds}__weight double").toDF(*named, "__weight")


def gumbel_key(weight: Column, row_id: Column, seed: int, temperature: float = 1.0) -> Column:
    """The weight by the temperature plus Gumbel noise drawn from the id, in steps: the same in every run and on every executor."""
    unit = (F.pmod(F.xxhash64(F.lit(seed), row_id), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return F.round((weight / temperature - F.log(-F.log(unit))) * STEPS).cast("long")


def kth_largest(keys: DataFrame, k: int, column: str = "key") -> int | None:
    """The k-th largest of a long column: BINS counts a pass narrow its range, whatever the number of rows."""
    low, high = keys.agg(F.min(column), F.max(column)).first()
    if low is None or k <= 0:
        return None
    while low < high:
        width = max(1, -(-(high - low + 1) // BINS))
        counts = keys.where(F.col(column).between(low, high)).groupBy(((F.col(column) - low) / width).cast("long").alias("bin")).count().collect()
        for r in sorted(counts, key=lambda r: -r["bin"]):
            if k <= r["count"]:
                low, high = low + r["bin"] * width, min(high, low + (r["bin"] + 1) * width - 1)
                break
            k -= r["count"]
        else:
            return low  # fewer than k rows: all belong
    return low


def best_cut(weights: list[tuple[float, int]]) -> float:
    """The weight that separates labelled good (1) from bad texts best, in the middle of its gap: most bad ones below it, and at COST times good ones.

    Without both classes nothing is cut.
    """
    w = np.array([x for x, _ in weights])
    good = np.array([q for _, q in weights]) == 1
    if not good.any() or good.all():
        return -np.inf
    order = np.argsort(w, kind="stable")
    w, good = w[order], good[order]
    lost = np.r_[0, np.cumsum(good)] / good.sum()  # good texts below each cut
    caught = np.r_[0, np.cumsum(~good)] / (~good).sum()
    edges = np.r_[-np.inf, (w[1:] + w[:-1]) / 2, np.inf]
    real = np.r_[True, w[1:] > w[:-1], True]
    value = np.where(real, caught - COST * lost, -np.inf)
    return float(edges[int(np.argmax(value))])


def resample(df: DataFrame, labels: DataFrame, k: int | None = None, temperature: float = 1.0, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, share: float | None = None) -> DataFrame:
    """The columns `carry` of `df` (all of them if None), __weight, and __kept: whether the sample of k rows has the row.

    With `share`, a stated budget, also __sampled: whether the sample of that share of all rows (rounded up) has it. By
    the same noise, the smaller of two samples is part of the larger.

    Reads the texts twice: to fit the models, and to weigh the rows, which are written with their weights. Rows that tie
    with the k-th key are all kept, repeated rows among them; rows without an id share one noise value. Where k is not
    given and labels of both kinds are missing, all rows are kept. An empty table keeps none. Columns of `df` named
    __weight, __kept or __sampled give way to the new ones.
    """
    sample = labelled_sample(labels, id_col=id_col)
    ratio = fit(df, sample, id_col, text_col)
    named = [c for c in (df.columns if carry is None else carry) if c not in ("__weight", "__kept", "__sampled")]
    slim = df.select(F.struct(*[df[c] for c in named]).alias("row"), df[id_col].alias("id"), df[text_col].alias("text"))
    key = gumbel_key(F.col("__weight"), F.col("id"), seed, temperature)
    scored = materialise(weighted(slim, ratio, "text", ["row", "id"]).withColumn("key", key), "quality-weights")
    if k is None:
        known = scored.join(F.broadcast(sample), F.col("id") == F.col("__lid")).groupBy("__lid").agg(F.first("__weight").alias("w"), F.first("__quality").alias("q"))
        cut = best_cut([(r["w"], r["q"]) for r in known.collect()])  # 2 * LABELLED rows at most
        k = scored.where(F.col("__weight") >= F.lit(cut)).count()
    least = kth_largest(scored, k)
    above = lambda x: F.lit(False) if x is None else F.col("key") >= F.lit(x)
    drawn = [] if share is None else [above(kth_largest(scored, math.ceil(share * scored.count()))).alias("__sampled")]
    return scored.select("row.*", "__weight", above(least).alias("__kept"), *drawn)
