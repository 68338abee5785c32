"""The star-schema tables in their domain roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairway.sources.tables import table


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as transport nodes; those in debt are inactive. Coordinates are a function of the key."""
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("name"),
        F.col("s_nationkey").cast("long").alias("waterway_id"),
        F.when(F.col("s_acctbal") >= 0, 1).otherwise(0).alias("status"),
        (F.pmod(F.col("s_suppkey") * 37, F.lit(200)).cast("double") / 10.0 + 100.0).alias("longitude"),
        (F.pmod(F.col("s_suppkey") * 53, F.lit(150)).cast("double") / 10.0 + 22.0).alias("latitude"),
    )


def node_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two aliases of each node: a short form and the name with its nation's."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    short = s.select((F.col("s_suppkey") * 2).alias("id"), F.col("s_suppkey").alias("node_id"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("alias_name"), F.pmod("s_suppkey", F.lit(10)).cast("int").alias("priority"), F.when(F.pmod("s_suppkey", F.lit(7)) == 0, 0).otherwise(1).alias("status"))
    long = s.join(n, s.s_nationkey == n.n_nationkey).select((F.col("s_suppkey") * 2 + 1).alias("id"), F.col("s_suppkey").alias("node_id"), F.concat_ws("-", "n_name", F.col("s_suppkey").cast("string")).alias("alias_name"), F.lit(5).alias("priority"), F.lit(1).alias("status"))
    return short.unionByName(long)


def opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as cargo opportunities: supplier to the customer's nation, quantity as tonnage."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("order_id"), F.col("l_suppkey").alias("origin_node_id"), F.col("l_partkey").alias("commodity_id"), F.col("l_quantity").cast("decimal(12,2)").alias("tonnage"), F.to_date("l_shipdate").alias("loading_date"), F.col("l_returnflag").alias("status"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as opportunities at row grain."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("decimal(12,2)").alias("freight_price"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("input_type"))


def vessel_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as reports of vessels."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("vessel_id"), F.col("event_type").alias("vessel_status"), F.col("value").alias("speed"), "ts", "props")


def audit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as audit records; target type, submitter and result follow from the event."""
    types = ["NODE", "VESSEL", "VESSEL_TYPE", "COMMODITY", "ROUTE"]
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.element_at(F.array(*map(F.lit, types)), (F.pmod("event_id", F.lit(5)) + 1).cast("int")).alias("target_type"),
        F.col("user_id").alias("submitter_id"),
        F.when(F.col("event_type").isin("view", "click"), "PENDING").when(F.col("event_type") == "error", "REJECTED").otherwise("APPROVED").alias("audit_result"),
        F.col("ts").alias("created_at"),
    )
