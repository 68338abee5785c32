"""Schemas of the domain tables, their status sets and row validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_CREATED = "created_at timestamp_ntz, updated_at timestamp_ntz"
_CANDIDATES = "array<struct<id:bigint,name:string,score:int>>"

_DDL = {
    "waterway": f"id bigint, code string, name string, level int, parent_id bigint, sort_order int, status int, {_CREATED}",
    "region": f"id bigint, code string, name string, center_lon decimal(11,8), center_lat decimal(10,8), main_rivers array<string>, boundary array<array<double>>, sort_order int, status int, {_CREATED}",
    "admin_region": f"id bigint, code string, name string, level int, parent_code string, sort_order int, status int, {_CREATED}",
    "node_type": f"id bigint, code string, name string, transport_mode string, sort_order int, status int, {_CREATED}",
    "transport_node": f"id bigint, code string, name string, node_type_id bigint, waterway_id bigint, region_id bigint, admin_region_id bigint, longitude decimal(11,8), latitude decimal(10,8), status int, audit_status int, submitter_id bigint, {_CREATED}",
    "node_alias": "id bigint, node_id bigint, alias_name string, alias_type string, priority int, status int, created_at timestamp_ntz",
    "region_address_relation": "id bigint, region_id bigint, transport_node_id bigint, is_primary int",
    "commodity_category": f"id bigint, code string, name string, sort_order int, status int, {_CREATED}",
    "commodity_type": f"id bigint, category_id bigint, code string, name string, sort_order int, status int, {_CREATED}",
    "commodity_standard": f"id bigint, type_id bigint, code string, name string, density decimal(8,4), status int, audit_status int, {_CREATED}",
    "commodity_alias": "id bigint, commodity_id bigint, alias_name string, priority int, status int, created_at timestamp_ntz",
    "cargo_raw_message": f"id bigint, raw_text string, source_type string, collector_id bigint, status string, {_CREATED}",
    "cargo_ai_parse_result": f"id bigint, raw_message_id bigint, origin_text string, dest_text string, commodity_text string, tonnage decimal(12,2), loading_date date, freight_price decimal(12,2), origin_node_id bigint, dest_node_id bigint, commodity_id bigint, origin_confidence int, dest_confidence int, commodity_confidence int, overall_confidence int, origin_candidates {_CANDIDATES}, dest_candidates {_CANDIDATES}, commodity_candidates {_CANDIDATES}, parse_status string, {_CREATED}",
    "cargo_opportunity": f"id bigint, raw_message_id bigint, parse_result_id bigint, origin_node_id bigint, dest_node_id bigint, commodity_id bigint, tonnage decimal(12,2), loading_date date, freight_price decimal(12,2), status string, input_type string, {_CREATED}",
    "vessel_type_dict": f"id bigint, code string, name string, audit_status int, sort_order int, status int, {_CREATED}",
    "vessel": f"id bigint, vessel_name string, mmsi string, vessel_type_id bigint, deadweight decimal(12,2), length decimal(8,2), draft decimal(8,3), audit_status int, submitter_id bigint, is_deleted int, {_CREATED}",
    "vessel_name_history": "id bigint, vessel_id bigint, old_name string, new_name string, changed_at timestamp_ntz",
    "vessel_ais_history": "id bigint, vessel_id bigint, old_mmsi string, new_mmsi string, changed_at timestamp_ntz",
    "vessel_dynamic": "id bigint, vessel_id bigint, current_node_id bigint, dest_node_id bigint, vessel_status string, speed decimal(5,2), heading decimal(5,2), updated_at timestamp_ntz",
    "shipping_route": f"id bigint, code string, name string, origin_region_id bigint, dest_region_id bigint, total_distance decimal(10,2), status int, {_CREATED}",
    "shipping_route_path": "id bigint, route_id bigint, node_id bigint, sequence int, distance_from_start decimal(10,2), node_role string",
    "heatmap_stat_daily": "stat_date date, node_id bigint, stat_type string, cargo_count bigint, total_tonnage decimal(16,2), vessel_count bigint, total_deadweight decimal(16,2)",
    "audit_record": "id bigint, target_type string, target_id bigint, action string, before_data string, after_data string, audit_result string, submitter_id bigint, auditor_id bigint, audit_remark string, created_at timestamp_ntz",
    "sys_user": f"id bigint, username string, status int, {_CREATED}",
    "sys_role": "id bigint, code string, name string",
    "sys_user_role": "user_id bigint, role_id bigint",
}

#: Tables that streams keep for themselves: versions of opportunities, and days of the heatmap, each with the batch that wrote it.
_KEPT = {
    "opportunity_version": "id bigint, node_id bigint, tonnage decimal(12,2), loading_date date, status string, updated_at timestamp_ntz, upto bigint",
    "heatmap_day": "stat_date date, node_id bigint, cargo_count bigint, total_tonnage decimal(16,2), upto bigint",
}

#: Allowed values of status columns; where the sources of the data differ, the union of both sets.
STATUSES = {
    ("cargo_raw_message", "status"): {"PENDING", "PARSING", "PARSED", "PARSE_FAILED", "INVALID"},
    ("cargo_ai_parse_result", "parse_status"): {"PENDING_CONFIRM", "CONFIRMED", "REJECTED"},
    ("cargo_opportunity", "status"): {"ACTIVE", "PENDING", "PENDING_CONFIRM", "CONFIRMED", "CANCELLED"},
    ("heatmap_stat_daily", "stat_type"): {"CARGO_ORIGIN", "CARGO_DEST", "VESSEL"},
    ("audit_record", "audit_result"): {"PENDING", "APPROVED", "REJECTED"},
}

#: Columns whose values must be unique, and not null.
UNIQUE = {"waterway": ["code"], "node_alias": ["alias_name"], "vessel_dynamic": ["vessel_id"], "heatmap_stat_daily": ["stat_date", "node_id", "stat_type"], "sys_user": ["username"], "sys_role": ["code"]}


def schema(name: str) -> StructType:
    return StructType.fromDDL(_DDL[name] if name in _DDL else _KEPT[name])


def tables() -> list[str]:
    return list(_DDL)


def conform(df: DataFrame, name: str) -> DataFrame:
    """`df` with the columns and types of the table; missing columns are null, others are dropped."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name)])


def violations(df: DataFrame, name: str) -> DataFrame:
    """(rule, n) of broken constraints of the table: values outside a status set, null or repeated unique keys."""
    found = [df.where(F.col(c).isNotNull() & ~F.col(c).isin(*values)).select(F.lit(f"{c} in set").alias("rule")) for (t, c), values in STATUSES.items() if t == name]
    if keys := UNIQUE.get(name):
        missing: Column = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
        found += [df.where(missing).select(F.lit("key not null").alias("rule")), df.groupBy(*keys).count().where("count > 1").select(F.lit("key unique").alias("rule"))]
    if not found:
        return df.sparkSession.createDataFrame([], "rule string, n bigint")
    return reduce(DataFrame.unionByName, found).groupBy("rule").agg(F.count("*").alias("n"))
