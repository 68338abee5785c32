"""Shared helpers: tables in the cluster's shared folder, checked broadcasts, grouped streams."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast; rows are a few dozen bytes, so some tens of MB at most.
BROADCAST_ROWS = 500_000

#: Rows and bytes of an Arrow batch at most.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20

#: Rows of a bucket of in_place(), and buckets at most.
BUCKET_ROWS, BUCKETS = 1 << 18, 50_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bounded(spark: SparkSession) -> SparkSession:
    """The session with small Arrow batches (texts may be long, and a batch is in memory on both sides), and with joins that take a bucketing by some of their keys. Sets the caller's configuration."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session without it gets a folder of this machine."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("fairway.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("fairway.checkpoint.dir", d)
    return d.rstrip("/")


#: Where tables() notes what is written to the shared folder; other threads and frames made outside have no part in it.
_NOTED: ContextVar[list[str] | None] = ContextVar("noted", default=None)


@contextmanager
def tables() -> Iterator[list[str]]:
    """The paths of the tables that the block's own code writes to the shared folder, oldest first."""
    paths: list[str] = []
    outer = _NOTED.get()
    token = _NOTED.set(paths)
    try:
        yield paths
    finally:
        _NOTED.reset(token)
        if outer is not None:
            outer.extend(paths)


def _note(path: str) -> None:
    if (noted := _NOTED.get()) is not None:
        noted.append(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` as a table in the shared folder and reads it back: its lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _note(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["written_to"] = path
    return out


def in_place(df: DataFrame, name: str, rows: int) -> DataFrame:
    """Writes `df` (of so many rows) with the columns sender and rid: the partition that a row is in, and its number.

    The table is bucketed by sender, each sender's rows in one bucket, so that a join on (sender, rid) or (sender, h) moves
    the other side to the rows and leaves these where they are. The table is in the catalogue for a moment, in the schema
    that the session's fairway.schema names, else the current one.
    """
    spark = df.sparkSession
    buckets = min(BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS)))
    name = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    schema = spark.conf.get("fairway.schema", None)
    table = f"{schema}.{name}" if schema else name
    numbered = df.withColumns({"sender": F.spark_partition_id(), "rid": F.monotonically_increasing_id()})
    path = f"{shared_dir(spark)}/{name}"
    numbered.write.bucketBy(buckets, "sender").option("path", path).saveAsTable(table)
    _note(path)
    out = spark.table(table)
    out.schema  # resolved before its name goes; the files stay
    spark.sql(f"DROP TABLE {table}")
    return out


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def forget(df: DataFrame) -> None:
    """Removes the table behind a materialise()d frame that nothing will read again."""
    _remove(df.sparkSession, df.__dict__["written_to"])


def sweep(spark: SparkSession, paths: list[str], keep: DataFrame) -> None:
    """Removes the noted tables() except that of the materialise()d frame that stays."""
    for path in [p for p in paths if p != keep.__dict__["written_to"]]:
        _remove(spark, path)
        paths.remove(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the written table `df` has at most `rows` rows; beyond that the join shuffles."""
    return F.broadcast(df) if df.count() <= rows else df


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, UPPER, LOWER)


_LIBC = ctypes.CDLL(None)

def give_back() -> None:
    """Returns freed memory of this worker, Arrow's and the allocator's, to the system: idle workers stay alive."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):  # glibc has it
        _LIBC.malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """A mapInArrow function that gives memory back when its task ends."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def rows_as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """Texts of an Arrow string column as UTF-8; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that `column` has about `most` bytes in each (one row at least)."""
    cut = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(size.to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start, cut = stop, cut + 1
            if cut % 8 == 0:
                give_back()


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches sorted by the integer column `key`."""
    held: list[pa.RecordBatch] = []  # of the last group so far
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        cut = int(np.argmax(keys == keys[-1]))  # start of its last group
        if held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def group_bounds(ids: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the length at the end."""
    return np.r_[0, np.flatnonzero(ids[1:] != ids[:-1]) + 1, len(ids)]
