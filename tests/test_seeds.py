"""Seeding twice gives the same dictionaries."""

from pyspark.sql import functions as F

from fairway.functions.scalars import haversine_km
from fairway.sources import seeds
from fairway.sources.store import Store


def test_seeding_is_idempotent(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    counts = []
    for _ in range(2):
        seeds.load_all(store)
        counts.append({t: store.read(t).count() for t in ("sys_role", "sys_user", "sys_user_role", "waterway", "region", "node_type", "transport_node", "commodity_category", "vessel_type_dict")})
    assert counts[0] == counts[1] == {"sys_role": 4, "sys_user": 2, "sys_user_role": 2, "waterway": 8, "region": 13, "node_type": 8, "transport_node": 10, "commodity_category": 5, "vessel_type_dict": 13}
    nodes = store.read("transport_node")
    assert nodes.select("id").distinct().count() == 10
    a, b = (nodes.where(F.col("code") == c).select(F.col("latitude").cast("double").alias(f"la{c}"), F.col("longitude").cast("double").alias(f"lo{c}")) for c in ("NJ001", "WH001"))
    km = a.crossJoin(b).select(F.round(haversine_km(F.col("laNJ001"), F.col("loNJ001"), F.col("laWH001"), F.col("loWH001")), 2)).first()[0]
    assert km == 455.07
