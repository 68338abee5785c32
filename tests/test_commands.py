"""Commands over several tables: all of their effects, or none."""

import datetime

import pytest
from pyspark.sql import functions as F

from fairway.plans import commands
from fairway.sources.store import Store


@pytest.fixture()
def now(spark):
    return F.lit(datetime.datetime(2024, 3, 1)).cast("timestamp_ntz")


def test_confirmations(spark, tmp_path, now):
    s = Store(spark, str(tmp_path))
    results = [(1, 11, 5, "PENDING_CONFIRM"), (2, 12, 6, "PENDING_CONFIRM"), (3, 13, 7, "CONFIRMED")]
    s.write("cargo_ai_parse_result", spark.createDataFrame(results, "id long, raw_message_id long, origin_node_id long, parse_status string"))
    day = lambda n: datetime.datetime(2024, 1, n)
    asked = spark.createDataFrame([(1, 8, 20, day(2)), (1, 9, None, day(1)), (3, 8, 1, day(1))], "id long, operator_id long, origin_node_id long, confirmed_at timestamp_ntz")
    made = commands.confirm_results(s, asked, now)
    assert [(r.parse_result_id, r.raw_message_id, r.origin_node_id, r.status) for r in made.collect()] == [(1, 11, 5, "ACTIVE")]
    state = lambda: {r.id: r.parse_status for r in s.read("cargo_ai_parse_result").collect()}
    assert state() == {1: "CONFIRMED", 2: "PENDING_CONFIRM", 3: "CONFIRMED"}
    audit = [(r.action, r.target_id, r.submitter_id) for r in s.read("audit_record").collect()]
    assert audit == [("CONFIRM", made.first().id, 9)]
    assert commands.confirm_results(s, asked, now).count() == 0  # again: nothing is pending
    assert s.read("cargo_opportunity").count() == 1 and s.read("audit_record").count() == 1


def test_a_failure_leaves_no_trace(spark, tmp_path, now, monkeypatch):
    s = Store(spark, str(tmp_path))
    s.write("cargo_ai_parse_result", spark.createDataFrame([(1, 5, "PENDING_CONFIRM")], "id long, origin_node_id long, parse_status string"))
    monkeypatch.setattr(commands.parsing, "confirmation_records", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        commands.confirm_results(s, spark.createDataFrame([(1,)], "id long"), now)
    assert s.read("cargo_opportunity").count() == 0 and s.read("cargo_ai_parse_result").first().parse_status == "PENDING_CONFIRM"


def test_decisions(spark, tmp_path, now):
    s = Store(spark, str(tmp_path))
    s.write("transport_node", spark.createDataFrame([(5, "P", 7, 0), (6, "Q", 7, 0)], "id long, name string, submitter_id long, audit_status int"))
    s.write("audit_record", spark.createDataFrame([(1, "NODE", 5, "PENDING", 7), (2, "NODE", 6, "PENDING", 7)], "id long, target_type string, target_id long, audit_result string, submitter_id long"))
    at = datetime.datetime(2024, 1, 1)
    d = [(1, "APPROVE", 9, ["OPERATOR"], "x", at), (1, "APPROVE", 8, ["ADMIN"], "ok", at + datetime.timedelta(1)), (2, "REJECT", 8, ["ADMIN"], "no", at)]
    decisions = spark.createDataFrame(d, "record_id long, decision string, auditor_id long, roles array<string>, remark string, decided_at timestamp")
    refused = commands.decide_records(s, decisions, now).collect()
    assert [(r.record_id, r.auditor_id, r.reject_reason) for r in refused] == [(1, 9, "no permission")]
    assert {r.id: (r.audit_result, r.auditor_id) for r in s.read("audit_record").collect()} == {1: ("APPROVED", 8), 2: ("REJECTED", 8)}
    assert [(r.node_id, r.alias_name, r.alias_type) for r in s.read("node_alias").collect()] == [(5, "P", "SYSTEM")]
    direct = commands.decide_entities(s, "transport_node", decisions.withColumnRenamed("record_id", "id").withColumn("id", F.col("id") + 4), "NODE")
    assert sorted((r.target_id, r.action) for r in direct.collect()) == [(5, "APPROVE"), (6, "REJECT")]
    assert {r.id: r.audit_status for r in s.read("transport_node").collect()} == {5: 1, 6: 2} and s.read("audit_record").count() == 4


def test_renamed_vessels(spark, tmp_path, now):
    s = Store(spark, str(tmp_path))
    s.write("vessel", spark.createDataFrame([(1, "a", "m1"), (2, "b", None)], "id long, vessel_name string, mmsi string"))
    commands.rename_vessels(s, spark.createDataFrame([(1, "c", None), (2, "b", "m2")], "id long, vessel_name string, mmsi string"), now)
    assert sorted((r.id, r.vessel_name, r.mmsi) for r in s.read("vessel").collect()) == [(1, "c", "m1"), (2, "b", "m2")]
    assert [(r.vessel_id, r.old_name, r.new_name) for r in s.read("vessel_name_history").collect()] == [(1, "a", "c")]
    assert [(r.vessel_id, r.old_mmsi, r.new_mmsi) for r in s.read("vessel_ais_history").collect()] == [(2, None, "m2")]
