"""Daily statistics: heatmaps, their merge into stored ones, trends, rankings, dashboard and report."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairway.operators.changes import upsert

KEY = ["stat_date", "node_id", "stat_type"]


def cargo_heatmap(cargo: DataFrame, node: str, stat_type: str, date: str = "loading_date", mode: str = "daily", target_date: datetime.date | None = None) -> DataFrame:
    """Cargo count and tonnage by node. daily: of each loading day; snapshot: of all time, under `target_date`."""
    if mode == "snapshot" and target_date is None:
        raise ValueError("snapshot needs a target_date")
    day = F.col(date) if mode == "daily" else F.lit(target_date)
    return cargo.groupBy(day.alias("stat_date"), F.col(node).alias("node_id")).agg(F.count("*").alias("cargo_count"), F.sum("tonnage").cast("decimal(16,2)").alias("total_tonnage")).withColumn("stat_type", F.lit(stat_type))


def vessel_heatmap(reports: DataFrame, node: str = "node_id", date: str = "stat_date", deadweight: str = "deadweight") -> DataFrame:
    """Vessels and their deadweight by node and day; a vessel counts once a day, with its largest deadweight."""
    once = reports.groupBy(F.col(date).alias("stat_date"), F.col(node).alias("node_id"), "vessel_id").agg(F.max(deadweight).alias("dwt"))
    return once.groupBy("stat_date", "node_id").agg(F.count("*").alias("vessel_count"), F.sum("dwt").cast("decimal(16,2)").alias("total_deadweight")).withColumn("stat_type", F.lit("VESSEL"))


def all_types(*stats: DataFrame) -> DataFrame:
    """One table of several kinds of statistics; figures that a kind lacks are 0."""
    out = stats[0]
    for s in stats[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    figures = {"cargo_count": "long", "total_tonnage": "decimal(16,2)", "vessel_count": "long", "total_deadweight": "decimal(16,2)"}
    return out.select(*KEY, *[(F.coalesce(F.col(c), F.lit(0)) if c in out.columns else F.lit(0)).cast(t).alias(c) for c, t in figures.items()])


def merge(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored statistics with the new ones in place; keys without a new row keep their old figures."""
    return upsert(stored, new, KEY)


def trend(stats: DataFrame, as_of: datetime.date, days: int = 7, value: str = "cargo_count", stat_type: str = "CARGO_ORIGIN") -> DataFrame:
    """(stat_date, value) of the days + 1 dates up to `as_of`; 1 to 90 days."""
    if not 1 <= days <= 90:
        raise ValueError("1 <= days <= 90")
    span = F.col("stat_date").between(F.lit(as_of - datetime.timedelta(days=days)), F.lit(as_of)) & (F.col("stat_type") == stat_type)
    return stats.where(span).groupBy("stat_date").agg(F.sum(value).alias("value")).orderBy("stat_date")


def top_nodes(stats: DataFrame, n: int = 10, value: str = "cargo_count") -> DataFrame:
    """The nodes of the largest sums, ties by id; 1 to 50."""
    if not 1 <= n <= 50:
        raise ValueError("1 <= n <= 50")
    return stats.groupBy("node_id").agg(F.sum(value).alias("value")).orderBy(F.desc("value"), "node_id").limit(n)


def heatmap_on(stats: DataFrame, nodes: DataFrame, start: datetime.date, end: datetime.date | None = None, stat_type: str = "CARGO_ORIGIN", region_id: int | None = None) -> DataFrame:
    """Statistics of a date or range, with node name and place; a region filters on the node's."""
    rows = stats.where(F.col("stat_date").between(F.lit(start), F.lit(end or start)) & (F.col("stat_type") == stat_type))
    wanted = nodes if region_id is None else nodes.where(F.col("region_id") == region_id)
    places = wanted.select(F.col("id").alias("node_id"), F.col("name").alias("node_name"), "longitude", "latitude")
    return rows.join(places, "node_id")


def dashboard(opportunities: DataFrame, vessels: DataFrame, stats: DataFrame, as_of: datetime.date, days: int = 7, active: str = "ACTIVE", pending: str = "PENDING", vessel_status: str | None = None) -> DataFrame:
    """One row: opportunities in all, active and pending; vessels (all, or of a status); cargo of the trailing days."""
    counts = opportunities.agg(F.count("*").alias("total_opportunities"), F.count(F.when(F.col("status") == active, 1)).alias("active_opportunities"), F.count(F.when(F.col("status") == pending, 1)).alias("pending_opportunities"))
    fleet = (vessels if vessel_status is None else vessels.where(F.col("vessel_status") == vessel_status)).agg(F.countDistinct("vessel_id").alias("active_vessels"))
    recent = trend(stats, as_of, days).agg(F.coalesce(F.sum("value"), F.lit(0)).cast("long").alias("recent_cargo"))
    return counts.crossJoin(fleet).crossJoin(recent)  # one row each


def report_lines(stats: DataFrame, as_of: datetime.date, days: int = 30, top: int = 5, last: int = 5) -> DataFrame:
    """(line_no, line) of a plain-text summary: the leading nodes, then the last days of the trend."""
    days_ = trend(stats, as_of, days)
    tail = days_.orderBy(F.desc("stat_date")).limit(last)
    leading = top_nodes(stats.where(F.col("stat_date").between(F.lit(as_of - datetime.timedelta(days=days)), F.lit(as_of))), top)
    one = leading.agg(F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("v"), "node_id"))).alias("x")).select(F.posexplode("x").alias("i", "r")).select((F.col("i") + 1).alias("line_no"), F.concat(F.lit("node "), F.col("r.node_id").cast("string"), F.lit(": "), (-F.col("r.v")).cast("string")).alias("line"))
    two = tail.agg(F.array_sort(F.collect_list(F.struct("stat_date", "value"))).alias("x")).select(F.posexplode("x").alias("i", "r")).select((F.col("i") + 1 + top).alias("line_no"), F.concat(F.col("r.stat_date").cast("string"), F.lit(": "), F.col("r.value").cast("string")).alias("line"))
    return one.unionByName(two)
