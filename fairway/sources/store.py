"""Tables as versioned Parquet snapshots: append, seed, update, delete and upsert, over several tables at once, without a table format.

An append adds a folder to a table; other changes write its next version. What a reader sees is named by the newest file in
_commits, which lists the folders of every table: it is created in one step and only if its number is free, so a change to
several tables is seen as a whole or not at all, and of two writers that change the same table from the same state one
fails. A change may carry marks, numbers that rise with it, so that a repeated batch of a stream is known. JDBC tables are
read and written through Spark's own source.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairway.operators import changes, governance
from fairway.schemas import conform, schema

#: Commits that stay beside the newest when old ones are removed, for readers that have just listed them.
KEPT_COMMITS = 20


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder that is not there yet, below spark.checkpoint.dir, which all executors share; only a local session without it gets one of this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-store-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Transaction:
    """Changes to several tables that take effect together when its block ends; its reads see its own changes."""

    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark
        self.number, self.base = store._state()
        self.tables: dict[str, list[str]] = {}
        self.marks: dict[str, int] = {}
        self.written: list[str] = []

    def read(self, name: str) -> DataFrame:
        return self.store._open(name, self.tables.get(name, self.base["tables"].get(name, [])))

    def _put(self, name: str, kind: str, df: DataFrame) -> DataFrame:
        folder = self.store._write_folder(name, kind, df)
        self.written.append(f"{self.store.root}/{folder}")
        before = [] if kind == "v" else self.tables.get(name, self.base["tables"].get(name, []))
        self.tables[name] = [*before, folder]
        return self.read(name)

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """The next version of a table."""
        return self._put(name, "v", df)

    def append(self, name: str, rows: DataFrame) -> DataFrame:
        """Adds rows, with new ids where they have none; what is there is not rewritten."""
        new = conform(rows, name)
        return self._put(name, "a", changes.with_new_ids(new, self.read(name)) if "id" in schema(name).names else new)

    def record_audit(self, before: DataFrame, after: DataFrame, key: str, target_type: str, action: str, submitter: Column, now: Column) -> DataFrame:
        """Appends an audit record for each row that a change touched."""
        return self.append("audit_record", governance.snapshots(before, after, key, target_type, action, submitter, now))

    def seed(self, name: str, rows: DataFrame, key: str = "code") -> DataFrame:
        """Adds the rows whose key is not there yet; seeding twice changes nothing."""
        return self.append(name, changes.absent(conform(rows, name), self.read(name), [key]))

    def update(self, name: str, changed: DataFrame, key: str = "id") -> DataFrame:
        return self.write(name, changes.update_rows(self.read(name), changed, [key]))

    def delete(self, name: str, keys: DataFrame, key: str = "id") -> DataFrame:
        return self.write(name, changes.delete_rows(self.read(name), keys, [key]))

    def upsert(self, name: str, rows: DataFrame, keys: list[str]) -> DataFrame:
        return self.write(name, changes.upsert(self.read(name), conform(rows, name), keys))

    def mark(self, name: str, number: int) -> None:
        """Notes how far something has come, for marked()."""
        self.marks[name] = number


class Store:
    """Domain tables below a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _list(self, path: str) -> list:
        fs, where = self._fs(path)
        return [s.getPath() for s in fs.listStatus(where)] if fs.exists(where) else []

    def _versions(self, name: str) -> list[tuple[int, str]]:
        """(number, path) of the folders of a table, committed or not."""
        return sorted((int(p.getName()[2:]), p.toString()) for p in self._list(f"{self.root}/{name}") if p.getName()[:2] in ("v=", "a="))

    def _state(self) -> tuple[int, dict]:
        """The newest commit: its number, and the folders of every table and the marks."""
        numbers = [int(p.getName()) for p in self._list(f"{self.root}/_commits") if p.getName().isdigit()]
        if not numbers:
            return 0, {"tables": {}, "marks": {}}
        text = self.spark.sparkContext.wholeTextFiles(f"{self.root}/_commits/{max(numbers):012d}", 1).values().first()
        return max(numbers), json.loads(text)

    def _create(self, path: str, text: str) -> bool:
        """Makes a file with all of its content in one step; False if there is one of this name."""
        draft = f"{path.rsplit('/', 1)[0]}/_draft-{uuid.uuid4().hex}"
        fs, where = self._fs(draft)
        out = fs.create(where, False)
        out.write(bytearray(text.encode()))
        out.close()
        _, final = self._fs(path)
        if fs.getScheme() == "file":  # a local rename would replace the other file
            try:
                os.link(where.toUri().getPath(), final.toUri().getPath())
                return True
            except FileExistsError:
                return False
            finally:
                fs.delete(where, False)
        done = not fs.exists(final) and fs.rename(where, final)
        if not done:
            fs.delete(where, False)
        return bool(done)

    def _open(self, name: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema(name))
        return self.spark.read.schema(schema(name)).parquet(*[f"{self.root}/{f}" for f in folders])

    def _write_folder(self, name: str, kind: str, df: DataFrame) -> str:
        """Writes the next folder of a table, which nobody reads before a commit names it."""
        number = max([n for n, _ in self._versions(name)], default=0) + 1
        for other in "va":
            fs, taken = self._fs(f"{self.root}/{name}/{other}={number}")
            if fs.exists(taken):
                raise FileExistsError(f"{name} was changed meanwhile")
        conform(df, name).write.mode("error").parquet(f"{self.root}/{name}/{kind}={number}")
        return f"{name}/{kind}={number}"

    def _publish(self, t: Transaction) -> None:
        """Makes the next commit. Commits made meanwhile are taken along, unless they changed a table or mark of this one."""
        number, state = t.number, t.base
        while True:
            new = {"tables": {**state["tables"], **t.tables}, "marks": {**state["marks"], **t.marks}}
            if self._create(f"{self.root}/_commits/{number + 1:012d}", json.dumps(new)):
                return
            number, state = self._state()
            for kind, mine in (("tables", t.tables), ("marks", t.marks)):
                for name in mine:
                    if state[kind].get(name) != t.base[kind].get(name):
                        raise FileExistsError(f"{name} was changed meanwhile")

    @contextmanager
    def transaction(self) -> Iterator[Transaction]:
        """A block of changes to any tables: all are seen when it ends, none if it raises or another writer was faster."""
        t = Transaction(self)
        try:
            yield t
            if t.tables or t.marks:
                self._publish(t)
        except BaseException:
            for path in t.written:
                fs, where = self._fs(path)
                fs.delete(where, True)
            raise

    def marked(self, name: str, default: int = -1) -> int:
        """The number that the newest commit has for a mark."""
        return self._state()[1]["marks"].get(name, default)

    def read(self, name: str) -> DataFrame:
        return self._open(name, self._state()[1]["tables"].get(name, []))

    def vacuum(self, name: str) -> None:
        """Removes the folders of a table that read() no longer needs, and old commits; nobody may be reading or writing an older version."""
        number, state = self._state()
        needed = {f.rsplit("/", 1)[1] for f in state["tables"].get(name, [])}
        for path in self._list(f"{self.root}/{name}"):
            if path.getName() not in needed:
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        for path in self._list(f"{self.root}/_commits"):
            if path.getName().isdigit() and int(path.getName()) < number - KEPT_COMMITS:
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, False)


def _alone(name: str):
    """A change of Transaction as a commit of its own."""

    def run(self, *args, **options) -> DataFrame:
        with self.transaction() as t:
            return getattr(t, name)(*args, **options)

    run.__name__, run.__doc__ = name, getattr(Transaction, name).__doc__
    return run


for _name in ("write", "append", "record_audit", "seed", "update", "delete", "upsert"):
    setattr(Store, _name, _alone(_name))


def jdbc(spark: SparkSession, url: str, name: str, partition: str | None = None, low: int | None = None, high: int | None = None, parts: int = 1, **options: str) -> DataFrame:
    """A database table by URL, read in `parts` ranges of a numeric column where one is given; its bounds are asked of the table unless they are given."""
    reader = lambda: spark.read.format("jdbc").option("url", url).options(**options)
    if partition and parts > 1 and (low is None or high is None):
        least, most = reader().option("query", f"SELECT MIN({partition}) AS lo, MAX({partition}) AS hi FROM {name}").load().first()
        low, high = low if low is not None else least, high if high is not None else most
    out = reader().option("dbtable", name)
    if partition and parts > 1 and low is not None and high is not None:
        out = out.options(partitionColumn=partition, lowerBound=low, upperBound=high, numPartitions=parts)
    return out.load()


def jdbc_merge(df: DataFrame, url: str, name: str, keys: list[str], **options: str) -> None:
    """Rows into a database table by key: those of keys that it has replace the old ones, others are added.

    Tasks write to a table of their own, in parallel; then one database transaction moves the rows over, so nobody sees
    half of them, and a task that is run again does no harm. Of rows that repeat a key changes.one_per_key() counts. Without
    the table, it is made.
    """
    spark = df.sparkSession
    jvm = spark._jvm
    properties = jvm.java.util.Properties()
    for k, v in options.items():
        properties.setProperty(k, v)
    if driver := options.get("driver"):
        jvm.java.lang.Class.forName(driver)
    staging = f"{name}_{uuid.uuid4().hex[:12]}"
    columns = ", ".join(df.columns)
    same = " AND ".join(f"s.{k} = {name}.{k}" for k in keys)
    try:
        df.limit(0).write.format("jdbc").option("url", url).option("dbtable", name).options(**options).mode("append").save()
        changes.one_per_key(df, keys).write.format("jdbc").option("url", url).option("dbtable", staging).options(**options).mode("error").save()
        db = jvm.java.sql.DriverManager.getConnection(url, properties)
        try:
            db.setAutoCommit(False)
            statement = db.createStatement()
            statement.executeUpdate(f"DELETE FROM {name} WHERE EXISTS (SELECT 1 FROM {staging} s WHERE {same})")
            statement.executeUpdate(f"INSERT INTO {name} ({columns}) SELECT DISTINCT {columns} FROM {staging}")
            db.commit()
        except BaseException:
            db.rollback()
            raise
        finally:
            db.close()
    finally:
        db = jvm.java.sql.DriverManager.getConnection(url, properties)
        try:
            if db.getMetaData().getTables(None, None, staging.upper(), None).next() or db.getMetaData().getTables(None, None, staging, None).next():
                db.createStatement().executeUpdate(f"DROP TABLE {staging}")
        finally:
            db.close()


def submit_text(messages: DataFrame, now) -> DataFrame:
    """Raw texts (raw_text, source_type, collector_id) as messages with status PENDING."""
    return conform(messages.withColumn("status", F.lit("PENDING")).withColumn("created_at", now).withColumn("updated_at", now), "cargo_raw_message")
