"""Filters, changes, codes, governance, statistics, routes and parsing on literal frames."""

import datetime
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fairway.functions import scalars
from fairway.operators import changes, codes, governance, parsing, relational as R, routes, stats
from fairway.schemas import conform, schema, tables, violations
from fairway.plans.stages import run_stages
from fairway.sources.store import Store, jdbc, submit_text

D = datetime.date


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_filters(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b")], "id long, s string")
    assert df.where(R.equal_filters("falsy", id=0, s="")).count() == 2
    assert df.where(R.equal_filters("none", id=0, s=None)).count() == 1
    assert df.where(R.keyword(["s"], None)).count() == 2
    with pytest.raises(ValueError):
        R.page(df, [F.col("id")], 0)
    with pytest.raises(ValueError):
        R.page(df, [F.col("id")], 1, 101)


def test_total_does_not_depend_on_the_page(spark):
    df = spark.range(55)
    totals = {r.total for p in (1, 3, 6) for r in R.page_with_total(df, [F.col("id")], p, 10).collect()}
    assert totals == {55}


def test_parent_code(spark):
    df = spark.createDataFrame([(1, "A"), (2, "B")], "id long, parent_code string")
    parents = spark.createDataFrame([("A",)], "code string")
    assert rows(R.under_parent_code(df, parents, "A"), "id") == [(1,)]
    assert R.under_parent_code(df, parents, "Z").count() == 2
    assert R.under_parent_code(df, parents, None).count() == 2


def test_changes(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id long, s string, n int")
    new = spark.createDataFrame([(2, "z", None), (3, "c", 3)], "id long, s string, n int")
    once = changes.upsert(old, new, ["id"])
    assert rows(once) == [(1, "a", 1), (2, "z", None), (3, "c", 3)]
    assert rows(changes.upsert(once, new, ["id"])) == rows(once)
    assert rows(changes.update_rows(old, new, ["id"])) == [(1, "a", 1), (2, "z", 2)]
    assert rows(changes.delete_rows(old, new, ["id"])) == [(1, "a", 1)]
    fresh = changes.with_new_ids(spark.createDataFrame([(None, x, 0) for x in "pqr"], old.schema), old)
    assert sorted(r.id for r in fresh.collect()) == [3, 4, 5]


@pytest.mark.parametrize(
    "name, level, parent_id, parent_code, sibling, expected",
    [
        ("长江", 1, None, None, None, "01-01-001"),
        ("赣江", 2, 1, "01-01-001", None, "01-02-001"),
        ("湘江", 2, 1, "01-01-001", "01-02-001", "01-02-002"),
        ("京杭运河", 3, None, None, None, "08-03-001"),
        ("北运河", 1, None, None, None, "08-01-001"),
        ("闽江", 1, None, None, "ZJ", "01-01-001"),
        ("淮河", 1, None, None, "08-03-001", "02-01-002"),
        ("某渠", 2, 9, "CJ", "01-02-999", "01-02-1000"),
    ],
)
def test_single_codes(spark, name, level, parent_id, parent_code, sibling, expected):
    df = spark.createDataFrame([(name, level, parent_id, parent_code, sibling)], "n string, l int, p long, pc string, s string")
    assert df.select(codes.single_code(*map(F.col, ["n", "l", "p", "pc", "s"]))).first()[0] == expected


def test_allocated_codes_are_unique(spark):
    old = spark.createDataFrame([(1, None, "01-01-001"), (2, 1, "01-02-999")], "id long, parent_id long, code string")
    new = spark.createDataFrame([(i, f"江{i}", 2, 1 if i % 2 else None) for i in range(10, 20)], "id long, name string, level int, parent_id long")
    out = codes.allocate(new, old, ["id"])
    assert codes.repeated_codes(out.select("code").unionByName(old.select("code"))).count() == 0
    assert {r.code for r in out.where("parent_id = 1").collect()} == {f"01-02-{n}" for n in range(1000, 1005)}


def test_audit(spark):
    records = spark.createDataFrame([(i, 7, "PENDING" if i < 6 else "APPROVED", None, None) for i in range(1, 7)], "id long, submitter_id long, audit_result string, auditor_id long, audit_remark string")
    d = [(1, "APPROVE", 8, ["ADMIN"], 1), (1, "REJECT", 9, ["ADMIN"], 2), (2, "APPROVE", 7, ["ADMIN"], 1), (3, "APPROVE", 7, ["SUPER_ADMIN"], 1), (4, "REJECT", 7, ["ADMIN"], 1), (5, "REJECT", 8, ["VIEWER"], 1), (6, "APPROVE", 8, ["ADMIN"], 1)]
    decisions = spark.createDataFrame([(a, b, c, e, "r", datetime.datetime(2024, 1, f)) for a, b, c, e, f in d], "record_id long, decision string, auditor_id long, roles array<string>, remark string, decided_at timestamp")
    got = {r.id: (r.audit_result, r.reject_reason) for r in governance.decide(records, decisions).collect()}
    assert got == {1: ("APPROVED", None), 2: ("PENDING", "own submission"), 3: ("APPROVED", None), 4: ("REJECTED", None), 5: ("PENDING", "no permission"), 6: ("APPROVED", "not pending")}
    empty = spark.createDataFrame([(1, "APPROVE", 8, None, "r", datetime.datetime(2024, 1, 1)), (2, "APPROVE", 8, [None], "r", datetime.datetime(2024, 1, 1)), (3, "APPROVE", 8, [], "r", datetime.datetime(2024, 1, 1)), (4, "APPROVE", 8, [None, "ADMIN"], "r", datetime.datetime(2024, 1, 1))], decisions.schema)
    got = {r.id: (r.audit_result, r.reject_reason) for r in governance.decide(records.where("id < 5"), empty).collect()}
    assert got == {1: ("PENDING", "no permission"), 2: ("PENDING", "no permission"), 3: ("PENDING", "no permission"), 4: ("APPROVED", None)}
    strict = governance.decide(records, decisions, ("APPROVE", "REJECT"))
    assert strict.where("id = 4").first().reject_reason == "own submission"


def decisions_of(spark, key, rows_):
    made = [(a, b, c, e, f"r{c}", datetime.datetime(2024, 1, f)) for a, b, c, e, f in rows_]
    return spark.createDataFrame(made, f"{key} long, decision string, auditor_id long, roles array<string>, remark string, decided_at timestamp")


def test_refused_decisions_stand_in_nobodys_way(spark):
    records = spark.createDataFrame([(i, 7, "PENDING" if i < 5 else "REJECTED", "NODE", 10 + i) for i in range(1, 6)], "id long, submitter_id long, audit_result string, target_type string, target_id long")
    d = [
        (1, "APPROVE", 9, ["OPERATOR"], 1), (1, "APPROVE", 7, ["ADMIN"], 2), (1, "APPROVE", 8, ["ADMIN"], 3), (1, "REJECT", 8, ["ADMIN"], 4), (1, "REJECT", 9, ["OPERATOR"], 5),
        (2, "MAYBE", 8, ["ADMIN"], 1), (2, None, 8, ["ADMIN"], 2),
        (3, "REJECT", 8, ["ADMIN"], 2), (3, "APPROVE", 8, ["SUPER_ADMIN"], 1),
        (4, "APPROVE", 7, ["ADMIN"], 1), (4, "APPROVE", 9, None, 2),
        (5, "APPROVE", 8, ["ADMIN"], 1), (99, "APPROVE", 8, ["ADMIN"], 1),
    ]
    decisions = decisions_of(spark, "record_id", d)
    got = {r.id: (r.audit_result, r.auditor_id, r.audit_remark, r.reject_reason) for r in governance.decide(records, decisions).collect()}
    assert got == {1: ("APPROVED", 8, "r8", None), 2: ("PENDING", None, None, "unknown decision"), 3: ("APPROVED", 8, "r8", None), 4: ("PENDING", None, None, "own submission"), 5: ("REJECTED", None, None, "not pending")}
    why = sorted((r.record_id, r.decided_at.day, r.reject_reason) for r in governance.refused(records, decisions).collect())
    assert why == [(1, 1, "no permission"), (1, 2, "own submission"), (1, 4, "not pending"), (1, 5, "not pending"), (2, 1, "unknown decision"), (2, 2, "unknown decision"), (3, 2, "not pending"), (4, 1, "own submission"), (4, 2, "no permission"), (5, 1, "not pending"), (99, 1, "no record")]
    nodes = spark.createDataFrame([(11, "P"), (13, "Q"), (14, "R")], "id long, name string")
    have = spark.createDataFrame([(13, "SYSTEM")], "node_id long, alias_type string")
    after, aliases = governance.approve_nodes(records, decisions, nodes, have)
    assert rows(aliases, "node_id", "alias_name") == [(11, "P")] and after.where("audit_result = 'APPROVED'").count() == 2


def test_direct_decisions_count_by_permission_first(spark):
    things = spark.createDataFrame([(i, 7, 0) for i in range(1, 5)], "id long, submitter_id long, audit_status int")
    d = [(1, "APPROVE", 8, ["ADMIN"], 1), (1, "REJECT", 9, ["OPERATOR"], 2), (2, "REJECT", 8, ["ADMIN"], 1), (2, "APPROVE", 7, ["ADMIN"], 2), (3, "APPROVE", 8, ["ADMIN"], 1), (3, "MAYBE", 8, ["ADMIN"], 2), (4, None, 8, ["ADMIN"], 1)]
    after, records = governance.decide_directly(things, decisions_of(spark, "id", d), "NODE")
    assert rows(after, "id", "audit_status") == [(1, 1), (2, 2), (3, 1), (4, 0)]
    assert rows(records, "target_id", "action", "submitter_id") == [(1, "APPROVE", 8), (2, "REJECT", 8), (3, "APPROVE", 8)]


def test_one_confirmation_a_result(spark):
    results = spark.createDataFrame([(i, 5, "PENDING_CONFIRM" if i < 4 else "CONFIRMED") for i in range(1, 5)], "id long, origin_node_id long, parse_status string")
    day = lambda n: datetime.datetime(2024, 1, n)
    asked = spark.createDataFrame([(1, 8, 20, day(2)), (1, 9, 0, day(1)), (1, 9, 0, day(1)), (2, 8, 21, day(3)), (2, 8, None, day(4)), (4, 8, 22, day(1)), (77, 8, 1, day(1))], "id long, operator_id long, origin_node_id long, confirmed_at timestamp_ntz")
    made, after = parsing.confirm(results, asked, ["origin_node_id"])
    assert rows(made, "parse_result_id", "origin_node_id") == [(1, 5), (2, 21)]
    assert rows(after, "id", "parse_status") == [(1, "CONFIRMED"), (2, "CONFIRMED"), (3, "PENDING_CONFIRM"), (4, "CONFIRMED")]
    audit = parsing.confirmation_records(made.withColumn("id", F.col("parse_result_id") + 100), results, asked)
    assert rows(audit, "target_id", "action", "submitter_id", "after_data") == [(101, "CONFIRM", 9, '{"from_parse_result_id":1}'), (102, "CONFIRM", 8, '{"from_parse_result_id":2}')]
    twice = spark.createDataFrame([(1,), (1,)], "id long")
    assert rows(parsing.confirm(results, twice, ["origin_node_id"])[0], "parse_result_id") == [(1,)]


def test_direct_decisions(spark):
    things = spark.createDataFrame([(i, 7, 0) for i in range(1, 7)], "id long, submitter_id long, audit_status int")
    d = [(1, "APPROVE", 8, ["ADMIN"], 1), (1, "REJECT", 9, ["ADMIN"], 2), (2, "APPROVE", 7, ["ADMIN"], 1), (3, "REJECT", 7, ["ADMIN"], 1), (4, "APPROVE", 7, ["SUPER_ADMIN"], 1), (5, "APPROVE", 8, None, 1), (9, "APPROVE", 8, ["ADMIN"], 1)]
    decisions = spark.createDataFrame([(a, b, c, e, "r", datetime.datetime(2024, 1, f)) for a, b, c, e, f in d], "id long, decision string, auditor_id long, roles array<string>, remark string, decided_at timestamp")
    for kind, expected in (("NODE", [2, 0, 0, 1, 0, 0]), ("VESSEL", [2, 0, 2, 1, 0, 0]), ("VESSEL_TYPE", [2, 1, 2, 1, 0, 0])):
        after, records = governance.decide_directly(things, decisions, kind)
        assert [r.audit_status for r in after.orderBy("id").collect()] == expected
        assert rows(records, "target_id", "action") == [(i + 1, "APPROVE" if s == 1 else "REJECT") for i, s in enumerate(expected) if s]
    a = spark.createDataFrame([(1, "NODE", 5, "PENDING"), (2, "NODE", 5, "APPROVED"), (3, "VESSEL", 5, "PENDING")], "id long, target_type string, target_id long, audit_result string")
    assert rows(governance.pending_for(a, "NODE", 5), "id") == [(1,)] and governance.pending_for(a, "NODE", 6).count() == 0


def test_reparse_and_state_after_parsing(spark):
    m = spark.createDataFrame([(1, "PENDING"), (2, "PARSING"), (3, "PENDING")], "id long, status string")
    r = spark.createDataFrame([(1, "PENDING_CONFIRM"), (2, "PARSE_FAILED"), (2, "PARSE_FAILED")], "id long, parse_status string")
    assert rows(parsing.after_parse(m, r), "id", "status") == [(1, "PARSED"), (2, "PARSE_FAILED"), (3, "PENDING")]
    alias = governance.system_aliases(spark.createDataFrame([(5, "P")], "id long, name string"))
    assert rows(alias, "node_id", "alias_name", "priority") == [(5, "P", 100)]


def test_functions_in_sql(spark):
    scalars.register(spark)
    r = spark.sql("SELECT similarity_ratio('abcd', 'bcde') AS r, haversine_km(30, 110, 30, 111) AS km, waterway_km(2) AS w, tonnage_of('1.5万吨x') AS t, phone_of('call 13800138000!') AS p, phone_of('none') AS q").first()
    km = spark.range(1).select(scalars.haversine_km(F.lit(30.0), F.lit(110.0), F.lit(30.0), F.lit(111.0))).first()[0]
    assert (r.r, r.w, r.p, r.q) == (0.75, 3.0, "13800138000", None) and abs(r.km - km) < 1e-9
    assert r.t == spark.range(1).select(scalars.normalize_tonnage(F.lit("1.5万吨x"))).first()[0]


def test_stages(spark):
    df = spark.range(5)
    out = run_stages(df, [("even", lambda x: x.where("id % 2 = 0")), ("one", lambda x: x.limit(1))])
    assert out.success and out.result.count() == 1 and out.stages["even"].count() == 3
    bad = run_stages(df, [("even", lambda x: x.where("id % 2 = 0")), ("odd", lambda x: x.select("nothing"))])
    assert not bad.success and bad.failed == "odd" and list(bad.stages) == ["even"] and bad.result is None


def test_parse_blended(spark):
    """The older pipeline from message to result, against its steps by hand."""
    nodes = spark.createDataFrame([(1, "武汉港", 1), (2, "上海港", 1), (3, "武汉旧港", 0)], "id long, name string, status int")
    aliases = spark.createDataFrame([(1, 1, "汉口", 3, 1), (2, 2, "申港", 9, 0)], "id long, node_id long, alias_name string, priority int, status int")
    goods = spark.createDataFrame([(7, "动力煤", 1)], "id long, name string, status int")
    named = spark.createDataFrame([(1, 7, "煤炭", 0, 1)], "id long, commodity_id long, alias_name string, priority int, status int")
    m = spark.createDataFrame([(1, "汉口", "上海", "动力煤", 5000.0, 90, 80, 71, 60), (2, "申港", None, "", 0.0, 50, None, 40, None), (3, None, "汉口", "煤炭", None, None, 100, 100, 100)], "id long, origin_text string, dest_text string, commodity_text string, tonnage double, origin_extracted int, dest_extracted int, commodity_extracted int, tonnage_extracted int")
    got = {r.id: r for r in parsing.parse_blended(m, nodes, aliases, goods, named, lambda x: x).collect()}
    show = lambda r: (r.origin_id, r.dest_id, r.commodity_id, r.origin_confidence, r.dest_confidence, r.commodity_confidence, r.tonnage_confidence, r.overall_confidence, r.tonnage_text)
    # 上海 is contained in 上海港: 85, and (80 + 85) / 2 = 82
    assert show(got[1]) == (1, 2, 7, 95, 82, 85, 60, 80, "5000.0")
    # 申港 is an inactive alias; it shares 港 with both names: 2 / 5 is below one half
    assert show(got[2]) == (None, None, None, 50, 0, 40, 0, 22, None)
    assert show(got[3]) == (None, 1, 7, 0, 100, 100, 100, 75, None)
    assert [c["matched"] for c in got[1].origin_candidates] == ["汉口"]


def test_latest_and_log(spark):
    e = spark.createDataFrame([(1, 1, "a", 1), (2, 1, "a", 2), (3, 1, "b", 3), (4, 2, None, 1), (5, 2, "x", 1)], "id long, k long, v string, ts long")
    assert rows(governance.latest(e, "k"), "k", "id") == [(1, 3), (2, 5)]
    assert rows(governance.change_log(e, "k", "v"), "k", "new_value") == [(1, "b"), (2, "x")]


def test_status_changes(spark):
    m = spark.createDataFrame([(1, "PARSING", datetime.datetime(2024, 1, 1)), (2, "PARSING", datetime.datetime(2024, 1, 2)), (3, "PARSED", datetime.datetime(2024, 1, 1))], "id long, status string, updated_at timestamp_ntz")
    assert rows(governance.stale_reset(m, datetime.datetime(2024, 1, 2, 0, 30)), "id", "status") == [(1, "PENDING"), (2, "PARSING"), (3, "PARSED")]
    asked = spark.createDataFrame([(2,), (3,)], "id long")
    assert rows(governance.request_reparse(m, asked), "id", "status") == [(1, "PARSING"), (2, "PARSING"), (3, "PENDING")]
    n = spark.createDataFrame([(1, 1), (2, 1)], "id long, status int")
    assert rows(governance.set_status(n, asked, False)) == [(1, 1), (2, 0)]
    snap = governance.snapshots(n, governance.set_status(n, asked, False), "id", "NODE", "UPDATE", F.lit(1), F.current_timestamp())
    assert [(r.target_id, r.before_data) for r in snap.collect()] == [(2, '{"id":2,"status":1}')]


def test_stats(spark):
    cargo = spark.createDataFrame([(1, D(2024, 1, 1), 2), (1, D(2024, 1, 1), 3), (2, D(2024, 1, 8), 5)], "node long, loading_date date, tonnage int").withColumn("tonnage", F.col("tonnage").cast("decimal(12,2)"))
    h = stats.cargo_heatmap(cargo, "node", "CARGO_ORIGIN")
    assert h.agg(F.sum("cargo_count")).first()[0] == cargo.count()
    assert rows(stats.trend(h, D(2024, 1, 8), 7)) == [(D(2024, 1, 1), 2), (D(2024, 1, 8), 1)]
    assert rows(stats.trend(h, D(2024, 1, 8), 6)) == [(D(2024, 1, 8), 1)]
    assert [tuple(r) for r in stats.top_nodes(h, 1).collect()] == [(1, 2)]
    assert stats.cargo_heatmap(cargo, "node", "CARGO_ORIGIN", mode="snapshot", target_date=D(2024, 2, 1)).select("stat_date").distinct().count() == 1
    merged = stats.merge(stats.all_types(h), stats.all_types(h.where("node_id = 2")))
    assert rows(stats.merge(merged, stats.all_types(h.where("node_id = 2")))) == rows(merged)
    assert merged.count() == 2
    with pytest.raises(ValueError):
        stats.trend(h, D(2024, 1, 8), 91)


def test_routes(spark):
    nodes = spark.createDataFrame([(1, 30.0, 110.0), (2, 30.0, 111.0), (3, 30.0, 112.0)], "id long, latitude double, longitude double")
    path = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3)], "route_id long, sequence int, node_id long")
    d = {r.sequence: r.distance_from_start for r in routes.distances(path, nodes).collect()}
    assert d[1] == 0 and abs(d[3] - 2 * d[2]) < 1e-6
    out = routes.with_paths(spark.createDataFrame([(1,), (2,)], "id long"), routes.distances(path, nodes)).orderBy("id").collect()
    assert [x.node_id for x in out[0].path] == [1, 2, 3] and out[1].path == []
    assert rows(routes.replace_path(path, path.where("sequence = 1").withColumn("node_id", F.lit(9).cast("long"))), "node_id") == [(9,)]


def test_parsing(spark):
    ports = spark.createDataFrame([(1, "武汉港", ["武汉"]), (2, "上海港", ["上海"])], "id long, name string, aliases array<string>")
    goods = spark.createDataFrame([(7, "动力煤", [])], "id long, name string, aliases array<string>")
    m = spark.createDataFrame([(1, "武汉到上海，5000吨动力煤，联系13800138000"), (2, " "), (3, "你好")], "id long, raw_text string")
    got = {r.id: r for r in parsing.parse_messages(m, ports, goods).collect()}
    one = got[1]
    assert (one.origin_id, one.dest_id, one.commodity_id, one.tonnage, one.contact_phone, one.overall_confidence) == (1, 2, 7, 5000.0, "13800138000", 96)
    assert (got[2].parse_status, got[3].parse_status, got[3].overall_confidence) == ("PARSE_FAILED", "PENDING_CONFIRM", 0)
    results = spark.createDataFrame([(1, 5, "PENDING_CONFIRM"), (2, 5, "CONFIRMED")], "id long, origin_node_id long, parse_status string")
    made, after = parsing.confirm(results, spark.createDataFrame([(1, 0), (2, 9)], "id long, origin_node_id long"), ["origin_node_id"])
    assert rows(made, "parse_result_id", "origin_node_id") == [(1, 5)]
    assert rows(after, "id", "parse_status") == [(1, "CONFIRMED"), (2, "CONFIRMED")]
    entries = spark.createDataFrame([(1, 1, None), (2, 1, 99)], "k long, origin_node_id long, dest_node_id long")
    good, bad = parsing.manual_opportunities(entries, ports)
    assert rows(good, "k") == [(1,)] and rows(bad, "k") == [(2,)]


def test_a_text_that_all_messages_share(spark, monkeypatch):
    monkeypatch.setattr(parsing, "PART_ROWS", 500, raising=False)
    ports = spark.createDataFrame([(1, "南京", []), (2, "宜昌", ["夷陵"])], "id long, name string, aliases array<string>")
    goods = spark.createDataFrame([(7, "煤炭", [])], "id long, name string, aliases array<string>")
    m = spark.range(6_000).select("id", F.when(F.col("id") % 10 == 9, "随便").otherwise(F.concat(F.when(F.col("id") % 2 == 0, "南京").otherwise("夷陵"), F.lit("到宜昌，3千吨煤炭"))).alias("raw_text"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as in a stream
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = parsing.parse_messages(m, ports, goods).select("id", "origin_id", "dest_id", "commodity_id", "overall_confidence", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(r.id for r in got) == list(range(6_000))
    for r in got:
        want = (None, None, None, 0) if r.id % 10 == 9 else (1, 2, 7, 100) if r.id % 2 == 0 else (2, 2, 7, 98)
        assert (r.origin_id, r.dest_id, r.commodity_id, r.overall_confidence) == want
    assert max(Counter(r.task for r in got).values()) < 4_000  # of 4 tasks; one had all 5,400 of the text


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    seed = spark.createDataFrame([("ADMIN", "a"), ("VIEWER", "v")], "code string, name string")
    s.seed("sys_role", seed)
    assert rows(s.seed("sys_role", seed), "id", "code") in ([(1, "ADMIN"), (2, "VIEWER")], [(1, "VIEWER"), (2, "ADMIN")])
    one = s.read("sys_role").where("code = 'ADMIN'")
    s.update("sys_role", one.select("id", F.lit("boss").alias("name")))
    s.delete("sys_role", s.read("sys_role").where("code = 'VIEWER'"))
    assert rows(s.read("sys_role"), "code", "name") == [("ADMIN", "boss")]
    new = submit_text(spark.createDataFrame([("x", "chat", 1)], "raw_text string, source_type string, collector_id long"), F.current_timestamp())
    assert rows(s.append("cargo_raw_message", new), "id", "status") == [(1, "PENDING")]
    assert rows(s.append("cargo_raw_message", new), "id", "status") == [(1, "PENDING"), (2, "PENDING")]
    before = s.read("sys_role")
    after = s.update("sys_role", before.select("id", F.lit("chief").alias("name")))
    audit = s.record_audit(before, after, "id", "ROLE", "UPDATE", F.lit(3), F.current_timestamp())
    assert rows(audit, "target_type", "action", "audit_result", "submitter_id") == [("ROLE", "UPDATE", "PENDING", 3)]
    s.vacuum("sys_role")
    assert rows(s.read("sys_role"), "name") == [("chief",)] and len(s._versions("sys_role")) == 1


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path, monkeypatch):
    one, two = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    seen = two._versions("sys_role")
    one.write("sys_role", spark.createDataFrame([(1, "A", "a")], "id long, code string, name string"))
    monkeypatch.setattr(two, "_versions", lambda name: seen)
    with pytest.raises(FileExistsError):
        two.write("sys_role", spark.createDataFrame([(2, "B", "b")], "id long, code string, name string"))
    assert rows(one.read("sys_role"), "code") == [("A",)]


def test_jdbc_options(spark):
    """A URL that no driver knows fails in the driver's lookup, with all options accepted."""
    with pytest.raises(Exception, match="(?i)driver"):
        jdbc(spark, "jdbc:nothing://h/db", "t", "id", 0, 10, 2, user="u")


def test_schemas(spark):
    assert len(tables()) == 26
    for t in tables():
        assert conform(spark.createDataFrame([], schema(t)), t).schema.fieldNames() == schema(t).fieldNames()
    bad = spark.createDataFrame([(1, "x", "ODD"), (1, None, "PENDING")], "id long, target_type string, audit_result string")
    assert rows(violations(conform(bad, "audit_record"), "audit_record")) == [("audit_result in set", 1)]
    assert rows(violations(conform(spark.createDataFrame([("A",), ("A",), (None,)], "code string"), "sys_role"), "sys_role")) == [("key not null", 1), ("key unique", 1)]
