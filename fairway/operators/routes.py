"""Shipping routes: ordered paths, distance from the start, replaced paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairway.functions.scalars import haversine_km
from fairway.operators.changes import replace_children
from fairway.operators.ordered import running_sum, with_prior
from fairway.operators.relational import nested


def distances(path: DataFrame, nodes: DataFrame, slice_rows: int | None = None) -> DataFrame:
    """Path nodes (route_id, sequence, node_id) with the length of each leg and the distance from the start, in km; routes of any length, in slices of the sequence."""
    place = nodes.select(F.col("id").alias("node_id"), "latitude", "longitude")
    legs = with_prior(path.join(place, "node_id"), ["route_id"], ["sequence"], ["latitude", "longitude"], slice_rows)
    leg = F.coalesce(haversine_km(F.col("__prior.latitude"), F.col("__prior.longitude"), F.col("latitude"), F.col("longitude")), F.lit(0.0))
    legs = legs.withColumn("leg_km", leg).drop("__prior", "latitude", "longitude")
    return running_sum(legs, ["route_id"], ["sequence"], F.col("leg_km"), "distance_from_start", slice_rows)


def with_paths(routes: DataFrame, path: DataFrame) -> DataFrame:
    """Routes with their path nodes in order."""
    return nested(routes, path, "id", "route_id", ["sequence", "node_id", "distance_from_start"], "path")


def replace_path(path: DataFrame, new: DataFrame, routes: DataFrame | None = None) -> DataFrame:
    return replace_children(path, new, "route_id", routes)
