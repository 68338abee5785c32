"""Seed rows of the dictionaries, and loaders that add those whose code is not there yet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairway.sources.store import Store

# The codes and names that the dictionaries start with.
ROLES = [("SUPER_ADMIN", "超级管理员"), ("ADMIN", "管理员"), ("OPERATOR", "运营人员"), ("COLLECTOR", "数据采集员")]
USERS = [("admin", "SUPER_ADMIN"), ("collector1", "COLLECTOR")]
WATERWAYS = [("CJ", "长江"), ("GC", "大运河"), ("HJ", "淮河"), ("HH", "黄河"), ("ZJ", "珠江"), ("HLJ", "黑龙江"), ("MB", "闽江"), ("XT", "湘江")]
REGIONS = [("SN", "苏南", "CJ"), ("SZ", "苏中", "CJ"), ("AH", "皖江", "CJ"), ("WH", "武汉", "CJ"), ("CQ", "重庆", "CJ"), ("JZ", "荆州", "CJ"), ("SH", "上海", "CJ"), ("HN", "湖南", "XT"), ("GZ", "广州", "ZJ"), ("WX", "无锡", "GC"), ("SZ2", "苏州", "GC"), ("HZ", "杭州", "GC"), ("NJ", "南京", "CJ")]
NODE_TYPES = [("PORT", "港口"), ("WHARF", "码头"), ("LOCK", "船闸"), ("TERMINAL", "货运站"), ("LOGISTICS", "物流园"), ("ANCHOR", "锚地"), ("SHIPYARD", "船厂"), ("BRIDGE", "桥梁控制点")]
PORTS = [
    ("NJ001", "南京港", 32.0617, 118.7778),
    ("WH001", "武汉港", 30.5928, 114.3055),
    ("CQ001", "重庆港", 29.5630, 106.5516),
    ("SH001", "上海港", 31.2304, 121.4737),
    ("AH001", "芜湖港", 31.3333, 118.3667),
    ("AH002", "安庆港", 30.5085, 116.9742),
    ("JZ001", "荆州港", 30.3340, 112.2399),
    ("YC001", "宜昌港", 30.6920, 111.2864),
    ("ZJ001", "镇江港", 32.1875, 119.4247),
    ("NT001", "南通港", 31.9829, 120.8942),
]
CATEGORIES = [("DRY_BULK", "干散货"), ("LIQUID", "液态货"), ("CONTAINER", "集装箱"), ("GENERAL", "件杂货"), ("SPECIAL", "特种货")]
VESSEL_TYPES = [("BULK", "散货船"), ("TANKER", "油轮"), ("CONTAINER", "集装箱船"), ("RO_RO", "滚装船"), ("BARGE", "驳船"), ("PUSHER", "推船"), ("PASSENGER", "客船"), ("CARGO", "货船"), ("CHEMICAL", "化学品船"), ("LPG", "液化气船"), ("SAND", "采砂船"), ("CRANE", "起重船"), ("OTHER", "其他")]


def _coded(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "code string, name string").withColumn("status", F.lit(1))


def load_all(store: Store) -> None:
    """Loads every dictionary; loading again changes nothing."""
    spark = store.spark
    for table, rows in (("sys_role", ROLES), ("node_type", NODE_TYPES), ("commodity_category", CATEGORIES), ("vessel_type_dict", VESSEL_TYPES)):
        store.seed(table, _coded(spark, rows))
    store.seed("waterway", _coded(spark, WATERWAYS).withColumn("level", F.lit(1)))
    rivers = store.read("waterway").select(F.col("code").alias("river"), F.array("name").alias("main_rivers"))
    regions = spark.createDataFrame(REGIONS, "code string, name string, river string")
    store.seed("region", regions.join(rivers, "river").withColumn("status", F.lit(1)))
    river = store.read("waterway").where("code = 'CJ'").select(F.col("id").alias("waterway_id"))
    kind = store.read("node_type").where("code = 'PORT'").select(F.col("id").alias("node_type_id"))
    ports = spark.createDataFrame(PORTS, "code string, name string, latitude double, longitude double")
    store.seed("transport_node", ports.crossJoin(river).crossJoin(kind).withColumn("status", F.lit(1)).withColumn("audit_status", F.lit(1)))  # one row each
    users = spark.createDataFrame(USERS, "username string, role string")
    store.seed("sys_user", users.select("username", F.lit(1).alias("status")), "username")
    links = users.join(store.read("sys_user").select("username", F.col("id").alias("user_id")), "username").join(store.read("sys_role").select(F.col("code").alias("role"), F.col("id").alias("role_id")), "role")
    old = store.read("sys_user_role")
    store.write("sys_user_role", old.unionByName(links.select("user_id", "role_id").join(old, ["user_id", "role_id"], "left_anti")))
