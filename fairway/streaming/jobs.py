"""Continuous versions: intake and parsing, latest state, daily windows, stale sweep."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from fairway.operators.governance import latest
from fairway.schemas import conform
from fairway.sources.store import Store


def read_stream(spark: SparkSession, path: str, schema: str | StructType, per_trigger: int = 1000) -> DataFrame:
    """Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def parse_stream(messages: DataFrame, parse: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, time: str | None = None, late: str = "7 days") -> StreamingQuery:
    """Parses each message once, also one that is sent again in a later batch; a batch that is repeated after a failure overwrites its own folder.

    The ids seen are the stream's state; with an event time they are kept until `late` behind, else for ever.
    """
    once = messages.dropDuplicates(["id"]) if time is None else messages.withWatermark(time, late).dropDuplicatesWithinWatermark(["id"])

    def save(batch: DataFrame, number: int) -> None:
        parse(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return once.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_stream(events: DataFrame, store: Store, table: str, key: str, checkpoint: str, time: str = "updated_at", compact: int = 50) -> StreamingQuery:
    """Keeps the newest row of each key in a table; older rows that come late change nothing.

    A batch appends its rows that are newer than the table's; read through latest_rows(). Every `compact` batches, the
    table is written anew with one row a key.
    """

    def save(batch: DataFrame, number: int) -> None:
        new, old = conform(latest(batch, key, time, "id"), table), store.read(table)
        if number % compact == compact - 1:
            store.write(table, latest(old.unionByName(new), key, time, "id"))
        else:
            store.append(table, new)

    return events.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_rows(store: Store, table: str, key: str, time: str = "updated_at") -> DataFrame:
    """The newest row of each key of a table that latest_stream() keeps."""
    return latest(store.read(table), key, time, "id")


def daily_windows(events: DataFrame, node: str, time: str = "ts", late: str = "2 days", value: str = "tonnage") -> DataFrame:
    """Count and sum by node and day; days close when events are `late` behind."""
    days = events.withWatermark(time, late).groupBy(F.window(time, "1 day"), node)
    return days.agg(F.count("*").alias("cargo_count"), F.sum(value).alias("total_tonnage")).select(F.to_date("window.start").alias("stat_date"), F.col(node).alias("node_id"), "cargo_count", "total_tonnage")


def _newest_days(days: DataFrame) -> DataFrame:
    """Of each day the rows of the last batch that wrote it."""
    last = days.groupBy("stat_date").agg(F.max("upto").alias("upto"))
    return days.join(last, ["stat_date", "upto"], "left_semi").select(days.columns)


def apply_changes(store: Store, changes: DataFrame, number: int, name: str = "heatmap", gone: tuple[str, ...] = ("CANCELLED",), compact: int = 50) -> None:
    """Takes one batch of opportunity versions (id, node_id, tonnage, loading_date, status, updated_at) into the daily heatmap.

    Of each opportunity the newest version counts, in any order of arrival, unless its status is one of `gone`: what the
    version before added to its day and node is subtracted, what the new one has is added, and only the days touched
    are written anew. Versions, days and the batch's number are one commit, so a batch that comes again changes nothing.
    Every `compact` batches both tables are written with what still counts alone.
    """
    if store.marked(name) >= number:
        return
    fields = ["id", "node_id", "tonnage", "loading_date", "status", "updated_at"]
    kept = changes.persist()
    try:
        with store.transaction() as t:
            newest = latest(conform(kept, "opportunity_version").select(fields), "id", "updated_at", "status")
            known = t.read("opportunity_version").join(newest.select("id"), "id", "left_semi")
            known = latest(known, "id", "updated_at", "upto").select(*[F.col(c).alias(f"old_{c}") if c != "id" else F.col(c) for c in fields])
            both = newest.join(known, "id", "left").where("old_updated_at IS NULL OR updated_at > old_updated_at").persist()
            part = lambda prefix, sign: both.select(F.col(f"{prefix}loading_date").alias("stat_date"), F.col(f"{prefix}node_id").alias("node_id"), F.col(f"{prefix}status").alias("status"), F.lit(sign).cast("long").alias("cargo_count"), (F.coalesce(F.col(f"{prefix}tonnage"), F.lit(0)) * sign).alias("total_tonnage"))
            deltas = part("", 1).unionByName(part("old_", -1)).where(F.col("stat_date").isNotNull() & F.col("node_id").isNotNull() & F.coalesce(~F.col("status").isin(*gone), F.lit(True))).drop("status")
            deltas = deltas.groupBy("stat_date", "node_id").agg(F.sum("cargo_count").alias("cargo_count"), F.sum("total_tonnage").alias("total_tonnage"))
            days = _newest_days(t.read("heatmap_day"))
            touched = days.join(deltas.select("stat_date").distinct(), "stat_date", "left_semi").drop("upto").unionByName(deltas)
            touched = touched.groupBy("stat_date", "node_id").agg(F.sum("cargo_count").alias("cargo_count"), F.sum("total_tonnage").alias("total_tonnage")).withColumn("upto", F.lit(number))
            versions = both.select(*fields, F.lit(number).alias("upto"))
            if number % compact == compact - 1:
                rest = days.join(touched.select("stat_date").distinct(), "stat_date", "left_anti")
                t.write("heatmap_day", rest.unionByName(touched).where("cargo_count <> 0"))
                t.write("opportunity_version", latest(t.read("opportunity_version").unionByName(conform(versions, "opportunity_version")), "id", "updated_at", "upto"))
            else:
                t.append("heatmap_day", touched)
                t.append("opportunity_version", versions)
            t.mark(name, number)
            both.unpersist()
    finally:
        kept.unpersist()


def heatmap_stream(changes: DataFrame, store: Store, checkpoint: str, name: str = "heatmap", compact: int = 50) -> StreamingQuery:
    """Keeps the daily heatmap up to date with opportunities that change, move to another day or node, or are cancelled; heatmap_now() reads it."""
    return changes.writeStream.foreachBatch(lambda batch, number: apply_changes(store, batch, number, name, compact=compact)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def heatmap_now(store: Store) -> DataFrame:
    """(stat_date, node_id, cargo_count, total_tonnage) of the opportunities that count now."""
    return _newest_days(store.read("heatmap_day")).where("cargo_count <> 0").select("stat_date", "node_id", "cargo_count", "total_tonnage")


def next_state(state: str | None, event: str) -> str | None:
    """The state of a message after an event; the same where the event doesn't fit it."""
    if event == "SUBMIT":
        return state or "PENDING"
    if event == "REPARSE" and state and state != "PARSING":
        return "PENDING"
    return {("PENDING", "START"): "PARSING", ("PARSING", "DONE"): "PARSED", ("PARSING", "FAIL"): "PARSE_FAILED"}.get((state, event), state)


def replay(events: list[tuple[int, str]], until: int, limit: int, state: str | None = None, since: int = 0) -> Iterator[tuple[str, int]]:
    """(status, at) of the states that a message passes through by `until`, given its events (at, event) in any order, repeats included.

    A message that is PARSING for `limit` goes back to PENDING at that moment; an event of the same moment finds it so.
    """
    ticks = sorted({(at, 1, event) for at, event in events if at <= until}) + [(until, 0, "")]
    for at, _, event in ticks:
        if state == "PARSING" and since + limit <= at:
            state, since = "PENDING", since + limit
            yield state, since
        if event and (new := next_state(state, event)) != state:
            state, since = new, at
            yield state, since


class MessageStates(StatefulProcessor):
    """The states of each message, in event time: events wait until the watermark has passed them, so their order of arrival doesn't matter."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "status string, since bigint")
        self.waiting = handle.getListState("waiting", "at bigint, event string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        held = {tuple(r) for r in self.waiting.get()}
        new = {(int(pd.Timestamp(at).timestamp() * 1000), event) for f in rows for at, event in zip(f["at"], f["event"])}
        new = {e for e in new if e[0] > mark} - held
        if new:
            self.waiting.put(sorted(held | new))
            for at in {at for at, _ in new}:
                self.handle.registerTimer(at)
        yield pd.DataFrame({"id": pd.Series(dtype="int64"), "status": pd.Series(dtype="str"), "at": pd.Series(dtype="datetime64[ms]")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        held = [tuple(r) for r in self.waiting.get()]
        status, since = tuple(self.state.get()) if self.state.exists() else (None, 0)
        passed = list(replay(held, mark, self.limit, status, since))
        left = [e for e in held if e[0] > mark]
        if len(left) < len(held):
            self.waiting.put(left) if left else self.waiting.clear()
        if passed:
            self.state.update(passed[-1])
            if passed[-1][0] == "PARSING":
                self.handle.registerTimer(passed[-1][1] + self.limit)
        yield pd.DataFrame({"id": pd.Series([key[0]] * len(passed), dtype="int64"), "status": pd.Series([s for s, _ in passed], dtype="str"), "at": pd.to_datetime([at for _, at in passed], unit="ms")})

    def close(self) -> None:
        pass


def message_states(events: DataFrame, late: str = "10 minutes", hours: float = 1) -> DataFrame:
    """(id, status, at) whenever a message's state changes: PENDING, PARSING, PARSED, PARSE_FAILED, by a stream of (id, event, at).

    Events are SUBMIT, START, DONE, FAIL and REPARSE; one that doesn't fit the state changes nothing, as does one that is
    sent again. A message that is PARSING for so many hours is PENDING again. Events take effect once `late` has passed
    and in the order of `at` (of one moment by name); what comes later than that is left out. A message with no events
    to come costs its state alone. Chooses RocksDB for the session's streams, which this kind of state needs.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    marked = events.withWatermark("at", late).groupBy("id")
    return marked.transformWithStateInPandas(MessageStates(int(hours * 3_600_000)), "id bigint, status string, at timestamp", "append", "eventTime")


def stale_alerts(events: DataFrame, hours: int = 1, time: str = "updated_at") -> DataFrame:
    """(id, status) PENDING for messages that stay PARSING for longer than so many hours of event time.

    Needs a watermark on the time column. One small state per message: the time of its newest event and whether it is in
    work; older events that come late change nothing. A message that moved on is forgotten after the same time.
    """
    limit = int(datetime.timedelta(hours=hours).total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            busy = state.get[1]
            state.remove()
            if busy:
                yield pd.DataFrame({"id": [key[0]], "status": ["PENDING"]})
            return
        last = max((row for f in frames for row in zip(f[time], f["status"])), key=lambda row: (row[0], row[1] != "PARSING"))
        at = int(pd.Timestamp(last[0]).timestamp() * 1000)
        if state.exists and at < state.get[0]:
            at, busy = state.get
        else:
            busy = last[1] == "PARSING"
        state.update((at, busy))
        state.setTimeoutTimestamp(max(at + limit, state.getCurrentWatermarkMs() + 1))

    return events.groupBy("id").applyInPandasWithState(step, "id bigint, status string", "at bigint, busy boolean", "append", GroupStateTimeout.EventTimeTimeout)
