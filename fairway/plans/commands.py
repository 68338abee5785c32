"""Commands that change several tables of a store in one commit: confirmations, audit decisions, vessel updates.

Each reads what it needs within its transaction, so a change made meanwhile by another writer makes it fail as a whole, and
the caller runs it again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairway.operators import governance, parsing
from fairway.sources.store import Store

#: What a parse result hands on to the opportunity made of it.
HANDED_ON = ["raw_message_id", "origin_node_id", "dest_node_id", "commodity_id", "tonnage", "loading_date", "freight_price"]


def confirm_results(store: Store, confirmations: DataFrame, now: Column) -> DataFrame:
    """Confirmations (id, overriding fields, operator_id, confirmed_at) of parse results: opportunities, confirmed results and audit records. Returns the new opportunities.

    See parsing.confirm(): of several confirmations of a result the first counts, and one that is confirmed already is left alone.
    """
    with store.transaction() as t:
        before = t.read("cargo_ai_parse_result")
        made, after = parsing.confirm(before, confirmations, HANDED_ON)
        known = t.read("cargo_opportunity").select("id")
        all_ = t.append("cargo_opportunity", made.withColumn("created_at", now).withColumn("updated_at", now))
        new = all_.join(known, "id", "left_anti")
        t.append("audit_record", parsing.confirmation_records(new, before, confirmations))
        t.write("cargo_ai_parse_result", after)
    return new


def decide_records(store: Store, decisions: DataFrame, now: Column, self_check: tuple[str, ...] = ("APPROVE",)) -> DataFrame:
    """Decisions on audit records, and what follows: nodes approved now get their system alias. Returns the refused decisions, each with its reason."""
    with store.transaction() as t:
        before = t.read("audit_record")
        after, aliases = governance.approve_nodes(before, decisions, t.read("transport_node"), t.read("node_alias"), self_check)
        t.append("node_alias", aliases.withColumn("created_at", now))
        t.write("audit_record", after)
    return governance.refused(before, decisions, self_check)


def decide_entities(store: Store, name: str, decisions: DataFrame, target_type: str) -> DataFrame:
    """Direct decisions on the rows of a table (nodes, vessels, vessel types), with a record of each that counted. Returns these records."""
    with store.transaction() as t:
        after, records = governance.decide_directly(t.read(name), decisions, target_type)
        known = t.read("audit_record").select("id")
        all_ = t.append("audit_record", records)
        t.write(name, after)
    return all_.join(known, "id", "left_anti")


def rename_vessels(store: Store, renamed: DataFrame, now: Column) -> DataFrame:
    """New names and numbers (id, vessel_name, mmsi; null leaves the old one) of vessels, with the history of what differs. Returns the vessels."""
    with store.transaction() as t:
        before = t.read("vessel")
        after = t.update("vessel", renamed)
        both = before.select("id", F.col("vessel_name").alias("n0"), F.col("mmsi").alias("m0")).join(after.select("id", F.col("vessel_name").alias("n1"), F.col("mmsi").alias("m1")), "id")
        for table, old, new, names in (("vessel_name_history", "n0", "n1", ("old_name", "new_name")), ("vessel_ais_history", "m0", "m1", ("old_mmsi", "new_mmsi"))):
            moved = both.where(~F.col(old).eqNullSafe(F.col(new))).select(F.col("id").alias("vessel_id"), F.col(old).alias(names[0]), F.col(new).alias(names[1]), now.alias("changed_at"))
            t.append(table, moved)
    return after
