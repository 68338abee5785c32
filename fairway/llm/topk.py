"""Exact top-k search by inner product: exhaustive term-at-a-time accumulation.

Rows are dealt to shards. A shard keeps a posting list per term (component): which of its rows have a weight there, and
the weight. Blocks of queries stream past it, each a sparse set of (term, weight); term by term the postings, times the
queries' weights, are added into dense score arrays (rows by queries), so every row of the shard gets its full score. A
partition selection keeps the k best of the shard, and Spark merges the shards' winners per query.

Every query meets every row, but rows and queries travel as they are and only k winners a query and shard come back.
Memory: the postings of a shard (ENTRIES at most, one row at least), one score array, one batch of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from fairway.llm.common import bounded, materialise, tidy

#: Components in a shard on average, at most; rows in one, at least, while there are fewer shards than cores.
ENTRIES, ROWS = 1 << 22, 512
#: Rows and queries of one score array.
BLOCK, QUERIES = 2048, 64


def whole_weights(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles: int64, or Python integers where they don't fit in 31 bits."""
    if not len(values) or np.abs(values).max() < 2**31 / scale - 1:
        return np.floor(values * scale).astype(np.int64)
    exact = (x.as_integer_ratio() for x in values.tolist())
    return np.array([n * scale // d for n, d in exact], object)


class Shard:
    """Posting lists of some rows, in ascending order of their ids, so that of equal scores the first position wins."""

    def __init__(self, rids: np.ndarray, ids: np.ndarray, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray):
        order = np.lexsort((rids, ids))
        self.rids, self.ids = rids[order], ids[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        full = weights != 0
        rows, terms, weights = place[rows[full]], terms[full], weights[full]
        self.most = int(np.abs(weights).max()) if len(weights) else 0
        by_block = np.lexsort((rows, terms, rows // BLOCK))
        rows, terms, weights = rows[by_block], terms[by_block], weights[by_block]
        keys = np.stack([rows // BLOCK, terms]) if len(rows) else np.zeros((2, 0), np.int64)
        edges = np.r_[0, np.flatnonzero((np.diff(keys[0]) != 0) | (np.diff(keys[1]) != 0)) + 1, len(rows)] if len(rows) else np.zeros(1, np.int64)
        #: Per block of rows: (term, positions in the block, weights).
        self.postings: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(-(-len(ids) // BLOCK))]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            self.postings[int(keys[0, a])].append((int(keys[1, a]), rows[a:b] % BLOCK, weights[a:b]))

    def scores(self, block: int, dense: np.ndarray, kind: type) -> np.ndarray:
        """Scores (rows of the block by queries) of queries given as a table (terms by queries)."""
        n = min(BLOCK, len(self.ids) - block * BLOCK)
        out = np.zeros((n, dense.shape[1]), kind)
        held = np.empty_like(out)
        for term, at, weights in self.postings[block]:
            if term >= len(dense):
                break  # terms ascend, and no query has this one
            if len(at) == n:  # all rows of the block: no scatter needed
                out += np.multiply.outer(weights.astype(kind), dense[term], out=held)
            else:
                out[at] += np.multiply.outer(weights.astype(kind), dense[term], out=held[: len(at)])
        return out

    def best(self, qrids: np.ndarray, dense: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, position, score) of the k best rows of each query but its own, ties to the smaller position."""
        most = int(np.abs(dense).max()) if dense.size else 0
        top, n = self.most * most * max(1, len(dense)), len(self.ids)
        kind = np.int32 if top < 2**31 else np.int64 if (top + 1) * (n + 1) < 2**61 else object
        dense = dense.astype(kind)
        found: list[tuple[np.ndarray, np.ndarray]] = []  # keys (score and position in one number), per block
        for block in range(len(self.postings)):
            base = block * BLOCK
            key = self.scores(block, dense, kind).astype(object if kind is object else np.int64)
            key *= n
            key += (n - 1 - base - np.arange(len(key)))[:, None]
            own = np.flatnonzero(np.isin(qrids, self.rids[base : base + BLOCK]))
            for q in own.tolist():
                key[np.flatnonzero(self.rids[base : base + BLOCK] == qrids[q]), q] = -(2**62) if kind is not object else -(2**4000)
            take = min(k, len(key))
            if kind is object:
                chosen = -np.sort(-key, axis=0)[:take]
            else:
                chosen = np.partition(key, len(key) - take, axis=0)[len(key) - take :]
            found.append(chosen)
        keys = np.concatenate(found)
        keys = -np.sort(-keys, axis=0)[:k]
        rank, query = np.nonzero(keys > (-(2**4000) if kind is object else -(2**62)))
        value = keys[rank, query]
        return query, (n - 1 - value % n).astype(np.int64), value // n


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, term and value of every component of a batch."""
    lists = batch.column("vector")
    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    return np.repeat(np.arange(batch.num_rows), sizes), np.arange(len(values)) - np.repeat(starts, sizes), values


def _search(k: int, scale: int):
    fits = lambda x: max(-(2**63), min(2**63 - 1, int(x)))

    def answers(shard: Shard, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        qrids, qids = batch.column("rid").to_numpy(), batch.column("vec_id").to_numpy()
        row, term, value = _flat(batch)
        weight = whole_weights(value, scale)
        for a in range(0, batch.num_rows, QUERIES):
            some = (row >= a) & (row < a + QUERIES)
            n = min(QUERIES, batch.num_rows - a)
            dense = np.zeros((int(term[some].max()) + 1 if some.any() else 0, n), weight.dtype)
            dense[term[some], row[some] - a] = weight[some]
            query, at, score = shard.best(qrids[a : a + n], dense, k)
            exact = score.astype(np.int64) if score.dtype != object else np.array([fits(x) for x in score], np.int64)
            # what 64 bits don't hold still ranks right, by its decimals
            wide = pa.array([None if fits(x) == x else str(x) for x in score] if score.dtype == object else [None] * len(score), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (qrids[a : a + n][query], qids[a : a + n][query], shard.ids[at], exact)] + [wide], names=["rid", "query_id", "vec_id", "score", "wide"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        shard, number = None, None
        for batch in batches:
            keys = batch.column("shard").to_numpy() * 2 + batch.column("asks").to_numpy()
            cuts = np.r_[0, np.flatnonzero(np.diff(keys)) + 1, len(keys)] if len(keys) else np.zeros(1, np.int64)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                part, of, asks = batch.slice(a, b - a), int(keys[a]) // 2, int(keys[a]) % 2
                if of != number:
                    held, shard, number = [], None, of
                if not asks:
                    held.append(part)
                    continue
                if shard is None and held:
                    rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    row, term, value = _flat(rows)
                    shard, held = Shard(rows.column("rid").to_numpy(), rows.column("vec_id").to_numpy(), row, term, whole_weights(value, scale)), []
                if shard is not None:
                    yield from answers(shard, part)

    return run


def top_k(df: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", shards: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the largest inner product with each query, exactly.

    Components count as floor(scale * x). Queries are the rows whose id is divisible by `every`; each meets every row but
    itself, ties go to the smaller id. Vectors that are null or hold a null, NaN or infinite component, and rows without
    an id, take no part. Components that a vector does not have count as zero, so vectors of any lengths meet. Rows that
    repeat an id are rows of their own, as queries and as candidates. A score beyond 64 bits ranks by its exact value and
    is shown as the nearest 64-bit number. Other columns are ignored.
    """
    spark = bounded(df.sparkSession)
    vector = F.col(vector_col).cast("array<double>")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector")).where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    rows = materialise(rows.withColumn("rid", F.monotonically_increasing_id()), "topk-vectors")
    n, entries = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()
    if shards is None:
        shards = max(-(-entries // ENTRIES), min(spark.sparkContext.defaultParallelism, -(-n // ROWS)), 1)
    dealt = rows.withColumns({"shard": F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int"), "asks": F.lit(0)})
    asking = rows.where(F.col("vec_id") % every == 0).withColumns({"shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1))), "asks": F.lit(1)})
    met = dealt.unionByName(asking).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "asks")
    found = met.mapInArrow(tidy(_search(k, scale)), "rid long, query_id long, vec_id long, score long, wide string")
    # scores within 64 bits rank as numbers, others among themselves by sign, number of digits and digits
    digits = F.length(F.regexp_replace("wide", "^-", ""))
    negative = F.col("wide").startswith("-")
    magnitude = F.when(negative, -digits).otherwise(digits)
    order = [F.desc("score"), F.desc_nulls_last(magnitude), F.when(negative, F.col("wide")).asc_nulls_last(), F.when(~negative, F.col("wide")).desc_nulls_last(), F.asc("vec_id")]
    rank = F.row_number().over(Window.partitionBy("rid").orderBy(*order))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
