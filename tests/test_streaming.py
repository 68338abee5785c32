"""Streams over the same input give what the batch gives."""

import datetime
import random
from decimal import Decimal

from pyspark.sql import functions as F

from fairway.operators import governance
from fairway.sources.store import Store
from fairway.streaming import jobs

SCHEMA = "id long, vessel_id long, vessel_status string, updated_at timestamp"


def events(spark, path):
    t = datetime.datetime(2024, 1, 1)
    rows = [(i, i % 5, f"s{i % 3}", t + datetime.timedelta(hours=(i * 7) % 100)) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    df.where("id < 30").coalesce(1).write.parquet(f"{path}/in", mode="append")
    df.where("id >= 30").coalesce(1).write.parquet(f"{path}/in", mode="append")
    return df


def test_latest_equals_batch(spark, tmp_path):
    df = events(spark, tmp_path)
    store = Store(spark, f"{tmp_path}/store")
    stream = jobs.read_stream(spark, f"{tmp_path}/in", SCHEMA, 1).withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))
    jobs.latest_stream(stream, store, "vessel_dynamic", "vessel_id", f"{tmp_path}/cp").awaitTermination()
    want = governance.latest(df, "vessel_id", "updated_at")
    assert sorted(map(tuple, jobs.latest_rows(store, "vessel_dynamic", "vessel_id").select("vessel_id", "id").collect())) == sorted(map(tuple, want.select("vessel_id", "id").collect()))


def test_parse_stream_takes_each_message_once(spark, tmp_path):
    events(spark, tmp_path)
    stream = jobs.read_stream(spark, f"{tmp_path}/in", SCHEMA, 1)
    jobs.parse_stream(stream, lambda b: b.select("id"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    jobs.parse_stream(stream, lambda b: b.select("id"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 60
    spark.read.parquet(f"{tmp_path}/in").where("id < 5").coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")  # sent again
    jobs.parse_stream(stream, lambda b: b.select("id"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 60
    timed = stream.withColumn("updated_at", F.col("updated_at"))
    jobs.parse_stream(timed, lambda b: b.select("id"), f"{tmp_path}/out2", f"{tmp_path}/cp2", "updated_at").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out2").count() == 60


def test_daily_windows_equal_batch(spark, tmp_path):
    df = events(spark, tmp_path)
    stream = jobs.read_stream(spark, f"{tmp_path}/in", SCHEMA, 10).withColumn("tonnage", F.col("id"))
    q = jobs.daily_windows(stream, "vessel_id", "updated_at").writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = df.groupBy(F.to_date("updated_at").alias("d"), "vessel_id").agg(F.count("*"), F.sum("id"))
    assert sorted(map(tuple, spark.table("daily").collect())) == sorted(map(tuple, want.collect()))


def test_stale_alerts(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [(1, "PARSING", t), (2, "PARSING", t), (2, "PARSED", t + datetime.timedelta(minutes=5)), (4, "PARSED", t + datetime.timedelta(minutes=2))]
    schema = "id long, status string, updated_at timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = jobs.read_stream(spark, f"{tmp_path}/in", schema, 1).withWatermark("updated_at", "1 minute")
    q = jobs.stale_alerts(stream).writeStream.format("memory").queryName("stale").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    spark.createDataFrame([(4, "PARSING", t + datetime.timedelta(minutes=4, seconds=30) - datetime.timedelta(minutes=3))], schema).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")  # late
    q.processAllAvailable()
    spark.createDataFrame([(3, "PARSED", t + datetime.timedelta(hours=3))], schema).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("stale").collect()] == [(1, "PENDING")]


CHANGE = "id long, node_id long, tonnage decimal(12,2), loading_date date, status string, updated_at timestamp_ntz"


def changed(seed, n):
    rnd = random.Random(seed)
    t = datetime.datetime(2024, 1, 1)
    day = lambda: datetime.date(2024, 2, rnd.randint(1, 9))
    return [(rnd.randint(1, 40), rnd.choice([1, 1, 1, 2, 3, None]), rnd.choice([None, Decimal(rnd.randint(1, 900)) / 4]), rnd.choice([day(), day(), None]), rnd.choice(["ACTIVE", "PENDING", "CANCELLED"]), t + datetime.timedelta(seconds=rnd.randrange(10**6))) for _ in range(n)]


def recomputed(rows):
    newest, out = {}, {}
    for r in rows:
        if r[0] not in newest or r[5] > newest[r[0]][5]:
            newest[r[0]] = r
    for _, node, tons, date, status, _ in newest.values():
        if node is not None and date is not None and status != "CANCELLED":
            n, total = out.get((date, node), (0, Decimal(0)))
            out[date, node] = (n + 1, total + (tons or 0))
    return {k: (n, t) for k, (n, t) in out.items()}


def shown(store):
    return {(r.stat_date, r.node_id): (r.cargo_count, r.total_tonnage) for r in jobs.heatmap_now(store).collect()}


def test_heatmap_follows_changes(spark, tmp_path):
    """After every batch the heatmap equals one made of all versions; a batch that comes again, and old versions, change nothing."""
    store, seen = Store(spark, str(tmp_path)), []
    for number in range(6):
        rows = changed(number, 25)
        if number == 4:
            rows = rows[:1]
        seen += rows
        batch = spark.createDataFrame(rows, CHANGE)
        before = store._state()[1]["tables"].get("heatmap_day", [])
        jobs.apply_changes(store, batch, number, compact=4)
        assert shown(store) == recomputed(seen)
        jobs.apply_changes(store, batch, number, compact=4)
        assert shown(store) == recomputed(seen)
        if number == 4:  # one opportunity moves: at most its old and its new day are written
            folder = set(store._state()[1]["tables"]["heatmap_day"]) - set(before)
            assert spark.read.parquet(f"{tmp_path}/{folder.pop()}").select("stat_date").distinct().count() <= 2


def test_heatmap_stream(spark, tmp_path):
    rows = changed(9, 60)
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], CHANGE).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
    store = Store(spark, f"{tmp_path}/store")
    jobs.heatmap_stream(jobs.read_stream(spark, f"{tmp_path}/in", CHANGE, 1), store, f"{tmp_path}/cp").awaitTermination()
    assert shown(store) == recomputed(rows) and store.marked("heatmap") == 2


EVENT = "id long, event string, at timestamp"


def test_message_states_equal_a_replay(spark, tmp_path):
    """Events late, repeated and out of order, a restart from the checkpoint between; then everything again in one go, sorted."""
    rnd, t = random.Random(11), datetime.datetime(2024, 1, 1)
    made = []
    for i in range(1, 25):
        at = t + datetime.timedelta(minutes=rnd.randrange(30))
        made.append((i, "SUBMIT", at))
        for _ in range(rnd.randint(0, 7)):
            at += datetime.timedelta(minutes=rnd.choice([1, 5, 20, 70, 130]))
            made.append((i, rnd.choice(["START", "START", "DONE", "FAIL", "REPARSE", "ODD"]), at))
    made += [(30, "SUBMIT", t), (30, "START", t + datetime.timedelta(minutes=1)), (30, "REPARSE", t + datetime.timedelta(minutes=2))]  # stays in work: reset by its timer
    rnd.shuffle(made)
    made += made[:20]  # sent again
    flush = (99, "SUBMIT", t + datetime.timedelta(days=4))
    path = f"{tmp_path}/in"
    spark.createDataFrame(made[:60], EVENT).coalesce(1).write.parquet(path, mode="append")

    def run():
        stream = jobs.message_states(jobs.read_stream(spark, path, EVENT, 1), late="2 days")
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").start()
        q.processAllAvailable()
        q.stop()

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        run()
        spark.createDataFrame(made[60:], EVENT).coalesce(1).write.parquet(path, mode="append")
        spark.createDataFrame([flush], EVENT).coalesce(1).write.parquet(path, mode="append")
        run()
        spark.createDataFrame([(2, "REPARSE", t)], EVENT).coalesce(1).write.parquet(path, mode="append")  # too late
        run()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = {}
    for r in spark.read.parquet(f"{tmp_path}/out").orderBy("id", "at").collect():
        got.setdefault(r.id, []).append((r.status, r.at))
    ms = lambda x: int((x - t).total_seconds() * 1000)
    want = {}
    for i in {r[0] for r in made}:
        events = [(ms(at), e) for j, e, at in made if j == i]
        want[i] = [(s, t + datetime.timedelta(milliseconds=a)) for s, a in jobs.replay(events, ms(flush[2]) - 2 * 86_400_000, 3_600_000)]
    assert {i: sorted(x, key=lambda y: y[1]) for i, x in got.items()} == {i: sorted(x, key=lambda y: y[1]) for i, x in want.items() if x}
    assert [s for s, _ in want[30]] == ["PENDING", "PARSING", "PENDING"]


def test_states():
    path = [("SUBMIT", "PENDING"), ("DONE", "PENDING"), ("START", "PARSING"), ("REPARSE", "PARSING"), ("FAIL", "PARSE_FAILED"), ("START", "PARSE_FAILED"), ("REPARSE", "PENDING"), ("START", "PARSING"), ("DONE", "PARSED"), ("SUBMIT", "PARSED"), ("REPARSE", "PENDING")]
    state = None
    for event, want in path:
        state = jobs.next_state(state, event)
        assert state == want
    assert jobs.next_state(None, "START") is None and jobs.next_state(None, "REPARSE") is None
