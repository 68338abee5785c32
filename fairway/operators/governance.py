"""Audit decisions, roles, snapshots, sweeps, latest state and change logs."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairway.operators.ordered import with_prior

ADMINS = ("SUPER_ADMIN", "ADMIN")


def may(roles: Column, *allowed: str) -> Column:
    """Whether an array of role codes has SUPER_ADMIN or one of the allowed; null roles and null codes may nothing."""
    return F.coalesce(F.exists(roles, lambda r: F.coalesce(r.isin("SUPER_ADMIN", *allowed), F.lit(False))), F.lit(False))


def role_codes(users: DataFrame, links: DataFrame, roles: DataFrame) -> DataFrame:
    """Users with the sorted array of their role codes, empty where they have none."""
    codes = links.join(roles, links.role_id == roles.id).groupBy("user_id").agg(F.array_sort(F.collect_set("code")).alias("roles"))
    return users.join(codes, users.id == codes.user_id, "left").drop("user_id").withColumn("roles", F.coalesce("roles", F.array().cast("array<string>")))


DECISIONS = ("APPROVE", "REJECT")


def _allowed(records: DataFrame, decisions: DataFrame, self_check: tuple[str, ...]) -> DataFrame:
    """Decisions with `__refusal`, the reason that alone would refuse them; null if they may count."""
    r = records.select(F.col("id").alias("record_id"), F.col("submitter_id").alias("__submitter"), F.col("audit_result").alias("__result"), F.lit(True).alias("__known"))
    own = F.col("auditor_id").eqNullSafe(F.col("__submitter")) & F.col("decision").isin(*self_check) & ~may(F.col("roles"))
    reason = (
        F.when(F.col("__known").isNull(), "no record")
        .when(~F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False)), "unknown decision")
        .when(~F.col("__result").eqNullSafe("PENDING"), "not pending")
        .when(~may(F.col("roles"), *ADMINS), "no permission")
        .when(own, "own submission")
    )
    return decisions.join(r, "record_id", "left").withColumn("__refusal", reason)


def _turn() -> Column:
    """The order in which decisions on a record are taken: by time, then auditor; what else is in a row breaks ties."""
    return F.struct("decided_at", "auditor_id", "decision", "remark")


def _first_that_counts(judged: DataFrame) -> DataFrame:
    """(record_id, __w): of each record the first decision that may count, by a partial minimum, so that a hot record is reduced before the shuffle."""
    return judged.where("__refusal IS NULL").groupBy("record_id").agg(F.min(_turn()).alias("__w"))


def decide(records: DataFrame, decisions: DataFrame, self_check: tuple[str, ...] = ("APPROVE",)) -> DataFrame:
    """Records after decisions (record_id, decision APPROVE or REJECT, auditor_id, roles, remark, decided_at).

    Only pending records change, only by admins, and none but SUPER_ADMIN decides on their own submission for the
    decisions in `self_check`. Of the decisions that are allowed, the first on a record by time, then auditor, counts;
    refused ones before it stand in nobody's way, and those after it find the record no longer pending. `reject_reason`
    is null where a decision counted or none came, else the reason of the first refused one; refused() has every one.
    Deciders without roles, null among them, have no permission; an unknown auditor counts as the submitter of a record
    without one.
    """
    judged = _allowed(records, decisions, self_check)
    won = judged.groupBy("record_id").agg(F.min(F.when(F.col("__refusal").isNull(), _turn())).alias("__w"), F.min(F.struct("decided_at", "auditor_id", "decision", "remark", F.col("__refusal").alias("why"))).alias("__f"))
    out = records.join(won.withColumnRenamed("record_id", "id"), "id", "left")
    takes = F.col("__w").isNotNull()
    new = F.when(takes, F.when(F.col("__w.decision") == "APPROVE", "APPROVED").otherwise("REJECTED")).otherwise(F.col("audit_result"))
    kept = [c for c in records.columns if c not in ("audit_result", "auditor_id", "audit_remark")]
    return out.select(*kept, new.alias("audit_result"), F.col("__w.auditor_id").alias("auditor_id"), F.col("__w.remark").alias("audit_remark"), F.when(~takes, F.col("__f.why")).alias("reject_reason"))


def refused(records: DataFrame, decisions: DataFrame, self_check: tuple[str, ...] = ("APPROVE",)) -> DataFrame:
    """The decisions that decide() refuses, each with its `reject_reason`: no record, unknown decision, not pending (before or by then), no permission, own submission."""
    judged = _allowed(records, decisions, self_check)
    won = _first_that_counts(judged)
    late = _turn() > F.col("__w")
    reason = F.when(F.col("__refusal").isin("no record", "unknown decision"), F.col("__refusal")).when(late, "not pending").otherwise(F.col("__refusal"))
    out = judged.join(won, "record_id", "left").withColumn("reject_reason", reason).where("reject_reason IS NOT NULL")
    return out.select(*decisions.columns, "reject_reason")


def approve_nodes(records: DataFrame, decisions: DataFrame, nodes: DataFrame, node_aliases: DataFrame, self_check: tuple[str, ...] = ("APPROVE",)) -> tuple[DataFrame, DataFrame]:
    """(records, aliases) after decisions, and the step that follows approval: nodes approved just now get a system alias, if they have none."""
    after = decide(records, decisions, self_check)
    was = records.where("audit_result = 'PENDING' AND target_type = 'NODE'").select("id")
    approved = after.where("audit_result = 'APPROVED'").join(was, "id", "left_semi").select(F.col("target_id").alias("id")).distinct()
    named = nodes.select("id", "name").join(approved, "id", "left_semi")
    have = node_aliases.where("alias_type = 'SYSTEM'").select("node_id")
    return after, system_aliases(named).join(have, "node_id", "left_anti")


#: Decisions that none but SUPER_ADMIN may take on their own submission, where entities are approved directly.
SELF_CHECKS = {"NODE": ("APPROVE", "REJECT"), "VESSEL": ("APPROVE",), "VESSEL_TYPE": ()}


def decide_directly(rows: DataFrame, decisions: DataFrame, target_type: str) -> tuple[DataFrame, DataFrame]:
    """(rows, audit records) after direct decisions on entities (id, decision, auditor_id, roles, remark, decided_at).

    audit_status becomes 1 for APPROVE and 2 for REJECT, whatever it was; of the allowed decisions on an entity the last
    one by time, then auditor, counts, whatever refused ones follow. Only admins decide, and none but SUPER_ADMIN on their
    own submission for the decisions of SELF_CHECKS. Rows without submitter_id have none. Each decision that counts gives
    one record; others change nothing.
    """
    submitter = F.col("submitter_id") if "submitter_id" in rows.columns else F.lit(None).cast("long")
    asked = decisions.select("id", "decision", "auditor_id", "roles", "remark", "decided_at")
    asked = asked.join(rows.select("id", submitter.alias("__submitter")), "id")
    own = F.coalesce((F.col("auditor_id") == F.col("__submitter")) & F.col("decision").isin(*SELF_CHECKS[target_type]), F.lit(False)) & ~may(F.col("roles"))
    allowed = asked.where(F.col("decision").isin(*DECISIONS) & may(F.col("roles"), *ADMINS) & ~own)
    won = allowed.groupBy("id").agg(F.max(_turn()).alias("__w"))
    status = F.when(F.col("__w.decision") == "APPROVE", 1).otherwise(2)
    joined = rows.join(won, "id", "left")
    after = joined.withColumn("audit_status", F.when(F.col("__w").isNotNull(), status).otherwise(F.col("audit_status"))).select(rows.columns)
    data = F.to_json(F.struct(status.alias("audit_status"), F.col("__w.remark").alias("remark")))
    records = won.select(F.lit(target_type).alias("target_type"), F.col("id").alias("target_id"), F.col("__w.decision").alias("action"), F.lit(None).cast("string").alias("before_data"), data.alias("after_data"), F.lit("APPROVED").alias("audit_result"), F.col("__w.auditor_id").alias("submitter_id"), F.col("__w.decided_at").alias("created_at"))
    return after, records


def pending_for(records: DataFrame, target_type: str, target_id: int) -> DataFrame:
    """The pending record of a target: no row, or one, of several the newest by id."""
    mine = (F.col("target_type") == target_type) & (F.col("target_id") == target_id) & (F.col("audit_result") == "PENDING")
    return records.where(mine).orderBy(F.desc("id")).limit(1)


def system_aliases(approved: DataFrame) -> DataFrame:
    """Optional step after approval of nodes (id, name): each name becomes an alias of the system, priority 100."""
    return approved.select(F.col("id").alias("node_id"), F.col("name").alias("alias_name"), F.lit("SYSTEM").alias("alias_type"), F.lit(100).alias("priority"), F.lit(1).alias("status"))


def stale_reset(rows: DataFrame, as_of: datetime.datetime, hours: int = 1, busy: str = "PARSING", back: str = "PENDING", status: str = "status", updated: str = "updated_at") -> DataFrame:
    """Rows that are busy for longer than so many hours go back to waiting."""
    stale = (F.col(status) == busy) & (F.col(updated) < F.lit(as_of - datetime.timedelta(hours=hours)).cast("timestamp_ntz"))
    return rows.withColumn(status, F.when(stale, back).otherwise(F.col(status)))


def request_reparse(messages: DataFrame, wanted: DataFrame) -> DataFrame:
    """Messages asked for (id) wait again, but for those that are being parsed."""
    asked = wanted.select("id", F.lit(True).alias("__asked")).distinct()
    out = messages.join(asked, "id", "left")
    return out.withColumn("status", F.when(F.col("__asked") & (F.col("status") != "PARSING"), "PENDING").otherwise(F.col("status"))).drop("__asked")


def latest(events: DataFrame, key: str, time: str = "ts", tie: str = "id") -> DataFrame:
    """The newest row of each key: a partial maximum of (time, tie, row), so that a hot key is reduced before the shuffle."""
    fields = [c for c in events.columns if c not in (key, time, tie)]
    top = events.groupBy(key).agg(F.max(F.struct(time, tie, *fields)).alias("__top"))
    return top.select(key, "__top.*").select(events.columns)


def change_log(events: DataFrame, key: str, value: str, time: str = "ts", tie: str = "id", slice_rows: int | None = None) -> DataFrame:
    """(key, old_value, new_value, changed_at) wherever the value differs from the one before; a key of any size, in slices of time."""
    prior = with_prior(events.select(key, value, time, tie), [key], [time, tie], [value], slice_rows)
    old = F.col("__prior").getField(value)
    return prior.where(F.col("__prior").isNotNull() & ~old.eqNullSafe(F.col(value))).select(key, old.alias("old_value"), F.col(value).alias("new_value"), F.col(time).alias("changed_at"))


def snapshots(before: DataFrame, after: DataFrame, key: str, target_type: str, action: str, submitter: Column, now: Column) -> DataFrame:
    """Audit rows with the JSON of rows before and after a change, of those that changed."""
    b = before.select(key, F.to_json(F.struct(*before.columns)).alias("before_data"))
    a = after.select(key, F.to_json(F.struct(*after.columns)).alias("after_data"))
    both = b.join(a, key, "full_outer").where(~F.col("before_data").eqNullSafe(F.col("after_data")))
    return both.select(F.lit(target_type).alias("target_type"), F.col(key).alias("target_id"), F.lit(action).alias("action"), "before_data", "after_data", F.lit("PENDING").alias("audit_result"), submitter.alias("submitter_id"), now.alias("created_at"))


def set_status(rows: DataFrame, ids: DataFrame, enabled: bool) -> DataFrame:
    """Enables or disables the rows with these ids."""
    marked = ids.select("id", F.lit(True).alias("__hit")).distinct()
    return rows.join(marked, "id", "left").withColumn("status", F.when(F.col("__hit"), F.lit(int(enabled))).otherwise(F.col("status"))).drop("__hit")
