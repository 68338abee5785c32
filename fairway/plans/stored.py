"""Queries whose result is what streams and commits leave in a store, each with the DuckDB equivalent of a batch over all rows.

A store is a new folder below spark.checkpoint.dir. The result is read from it, so nothing is removed there.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairway.operators import match, parsing
from fairway.plans import catalogue, commands
from fairway.sources import adapters as A
from fairway.sources.store import Store, new_folder
from fairway.sources.tables import table
from fairway.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str):
    """Registers a query under `name`, with its SQL."""

    def put(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return put


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The files of a table as they arrive; a pattern, because Spark takes a plain path of a stream for a folder, and a small table is one file."""
    return jobs.read_stream(spark, f"{sf_dir}/[{name[0]}]{name[1:]}.parquet", table(spark, sf_dir, name).schema)


@query("q82_latest_stream", """SELECT user_id AS vessel_id, arg_max(event_id, (ts, event_id)) AS id, arg_max(event_type, (ts, event_id)) AS vessel_status, max(ts) AS updated_at FROM events GROUP BY 1""")
def latest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest report of each vessel, kept by a stream of reports."""
    root = new_folder(spark, "latest")
    store = Store(spark, root)
    e = _stream(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("vessel_id"), F.col("event_type").alias("vessel_status"), F.col("ts").alias("updated_at"))
    jobs.latest_stream(e, store, "vessel_dynamic", "vessel_id", f"{root}/_stream").awaitTermination()
    return jobs.latest_rows(store, "vessel_dynamic", "vessel_id").select("vessel_id", "id", "vessel_status", "updated_at")


@query("q83_parse_stream", catalogue.ORACLE_SQL["q52_parse_messages"])
def parse_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages parsed as they arrive, those sent twice once: the results of the batch q52."""
    root = new_folder(spark, "parsed")
    nodes = match.dictionary(A.nodes(spark, sf_dir), A.node_aliases(spark, sf_dir), "node_id")
    goods = catalogue._goods(spark, sf_dir)
    orders = _stream(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer_id"))
    sent = orders.select("id", F.explode(F.array_repeat(catalogue.message(), 2)).alias("raw_text"))
    wanted = ["id", "origin_id", "dest_id", "commodity_id", "tonnage", "overall_confidence", "parse_status"]
    parse = lambda batch: parsing.parse_messages(batch, nodes, goods).select(*wanted)
    jobs.parse_stream(sent, parse, f"{root}/results", f"{root}/_stream").awaitTermination()
    kind = "id bigint, origin_id bigint, dest_id bigint, commodity_id bigint, tonnage double, overall_confidence int, parse_status string, batch int"
    return spark.read.schema(kind).parquet(f"{root}/results").select(*wanted)


@query("q84_heatmap_by_changes", """WITH v AS (SELECT o_orderkey % 3 AS v, o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, o_custkey % 100 AS node, CAST(o_totalprice AS DECIMAL(12,2)) AS tons FROM orders)
SELECT CAST(day + CAST(v AS INTEGER) AS VARCHAR) AS stat_date, node + v % 2 AS node_id, count(*) AS cargo_count, CAST(sum(tons) AS DOUBLE) AS total_tonnage FROM v WHERE NOT (v = 2 AND id % 2 = 0) GROUP BY 1, 2""")
def heatmap_by_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heatmap after up to three versions of each opportunity, in batches of which the first is the second version, one comes late and one comes twice."""
    store = Store(spark, new_folder(spark, "heatmap"))
    o = table(spark, sf_dir, "orders")

    def versions(v: int) -> DataFrame:
        status = F.when(F.pmod("o_orderkey", F.lit(2)) == 0, "CANCELLED").otherwise("ACTIVE") if v == 2 else F.lit("ACTIVE")
        rows = o.where(F.pmod("o_orderkey", F.lit(3)) >= v)
        at = F.lit(datetime.datetime(2024, 1, 1 + v)).cast("timestamp_ntz")
        return rows.select(F.col("o_orderkey").alias("id"), (F.pmod("o_custkey", F.lit(100)) + v % 2).alias("node_id"), F.col("o_totalprice").cast("decimal(12,2)").alias("tonnage"), F.date_add(F.to_date("o_orderdate"), v).alias("loading_date"), status.alias("status"), at.alias("updated_at"))

    for number, v in enumerate((1, 0, 2)):
        jobs.apply_changes(store, versions(v), number)
    jobs.apply_changes(store, versions(2), 2)
    return jobs.heatmap_now(store).select(F.col("stat_date").cast("string").alias("stat_date"), "node_id", "cargo_count", F.col("total_tonnage").cast("double").alias("total_tonnage"))


@query("q85_confirmed_in_store", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 OR o_orderstatus <> 'P' THEN 'CONFIRMED' ELSE 'PENDING_CONFIRM' END AS parse_status, CASE WHEN o_orderkey % 3 = 0 AND o_orderstatus = 'P' THEN CASE WHEN o_orderkey % 4 = 1 THEN 777 ELSE o_custkey END END AS origin_node_id,
CASE WHEN o_orderkey % 3 = 0 AND o_orderstatus = 'P' THEN CAST(o_totalprice AS DOUBLE) END AS tonnage, CASE WHEN o_orderkey % 3 = 0 AND o_orderstatus = 'P' THEN 'CONFIRM' END AS action, CASE WHEN o_orderkey % 3 = 0 AND o_orderstatus = 'P' THEN 5 END AS submitter_id FROM orders""")
def confirmed_in_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmations that write opportunities, results and audit records in one commit, given twice: results with what became of each."""
    store = Store(spark, new_folder(spark, "confirmed"))
    o = A.orders(spark, sf_dir)
    store.append("cargo_ai_parse_result", o.select("id", F.col("customer_id").alias("origin_node_id"), F.col("freight_price").alias("tonnage"), F.when(F.col("status") == "P", "PENDING_CONFIRM").otherwise("CONFIRMED").alias("parse_status")))
    at = F.lit(datetime.datetime(2024, 1, 1)).cast("timestamp_ntz")
    asked = o.where(F.pmod("id", F.lit(3)) == 0).select("id", F.when(F.pmod("id", F.lit(4)) == 1, 777).cast("long").alias("origin_node_id"), F.lit(5).cast("long").alias("operator_id"), at.alias("confirmed_at"))
    for _ in range(2):
        commands.confirm_results(store, asked, at)
    made = store.read("cargo_opportunity").select(F.col("id").alias("opportunity_id"), F.col("parse_result_id").alias("id"), "origin_node_id", F.col("tonnage").cast("double").alias("tonnage"))
    records = store.read("audit_record").select(F.col("target_id").alias("opportunity_id"), "action", "submitter_id")
    return store.read("cargo_ai_parse_result").select("id", "parse_status").join(made.join(records, "opportunity_id", "full_outer").drop("opportunity_id"), "id", "full_outer")


@query("q86_store_changes", """SELECT 'N' || s_suppkey AS code, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE upper(s_name) END AS name, CAST(CASE WHEN s_suppkey % 5 = 0 THEN 9 ELSE 1 END AS INTEGER) AS status, (SELECT count(*) FROM supplier) AS ids FROM supplier WHERE s_suppkey % 7 <> 0""")
def store_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes seeded twice by code, some changed, some deleted, and a change of two tables that fails half-way and leaves no trace; `ids` is the largest id."""
    store = Store(spark, new_folder(spark, "changes"))
    n = A.nodes(spark, sf_dir).select(F.concat(F.lit("N"), F.col("id").cast("string")).alias("code"), "name", F.lit(1).alias("status"), F.col("id").alias("n"))
    store.seed("transport_node", n.where(F.pmod("n", F.lit(2)) == 0))
    store.seed("transport_node", n.withColumn("name", F.upper("name")))
    ids = store.read("transport_node").agg(F.max("id").alias("ids"))
    try:
        with store.transaction() as t:
            t.delete("transport_node", n, "code")
            t.seed("waterway", n)
            raise InterruptedError
    except InterruptedError:
        pass
    with store.transaction() as t:
        t.update("transport_node", n.where(F.pmod("n", F.lit(5)) == 0).select("code", F.lit(9).alias("status")), "code")
        t.delete("transport_node", n.where(F.pmod("n", F.lit(7)) == 0), "code")
    return store.read("transport_node").select("code", "name", "status").crossJoin(F.broadcast(ids))  # one row
