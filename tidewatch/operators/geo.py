"""Flows and hubs on the globe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import haversine_km, min_rtt_ms, path_km
from .joins import feasible


def pair_km(hubs: DataFrame) -> DataFrame:
    """Distances between the hubs of one region: an equality join on the region."""
    a = hubs.select(F.col("hub").alias("a_hub"), "region", F.col("lon").alias("a_lon"), F.col("lat").alias("a_lat"))
    b = hubs.select(F.col("hub").alias("b_hub"), "region", F.col("lon").alias("b_lon"), F.col("lat").alias("b_lat"))
    return a.join(b, "region").withColumn("km", haversine_km(F.col("a_lon"), F.col("a_lat"), F.col("b_lon"), F.col("b_lat")))


def region_paths(hubs: DataFrame) -> DataFrame:
    """The length of the path through a region's hubs in the order of their numbers."""
    points = F.transform(F.array_sort(F.collect_list(F.struct("hub", "lon", "lat"))), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    return hubs.groupBy("region").agg(path_km(points).alias("km"))


def with_endpoints(cards: DataFrame, hubs: DataFrame) -> DataFrame:
    """Usable flows between two hubs that follow from the flow's number: km, the least rtt, region of the far end."""
    flows = cards.where("NOT insufficient").select("flow_id", "median", F.col("flow_id").cast("int").alias("_k"))
    a = hubs.select(F.col("hub").alias("_a"), F.col("lon").alias("_alon"), F.col("lat").alias("_alat"))
    b = hubs.select(F.col("hub").alias("_b"), "region", F.col("lon").alias("_blon"), F.col("lat").alias("_blat"))
    both = flows.join(a, F.col("_k") % 25 == F.col("_a")).join(b, (F.col("_k") * 7 + 3) % 25 == F.col("_b"))
    km = haversine_km(F.col("_alon"), F.col("_alat"), F.col("_blon"), F.col("_blat"))
    return both.withColumn("km", km).withColumn("rtt_min", min_rtt_ms(F.col("km"))).select("flow_id", "median", "region", "km", "rtt_min")


def impossible_flows(flows: DataFrame) -> DataFrame:
    """Flows whose median is below what light needs."""
    return flows.where("median < rtt_min")


def infeasible(flows: DataFrame) -> DataFrame:
    return flows.groupBy("region").agg(F.count("*").alias("n"), F.min("km").alias("km_min"), F.max("km").alias("km_max"), F.count_if(F.col("median") < F.col("rtt_min")).alias("impossible"))


def feasible_places(cards: DataFrame, hubs: DataFrame) -> DataFrame:
    """For each usable flow the hubs of its own hub's region that its median allows."""
    flows = cards.where("NOT insufficient")
    own = hubs.select(F.col("hub").alias("_own"), "region", F.col("lon").alias("from_lon"), F.col("lat").alias("from_lat"))
    places = hubs.select(F.col("hub").alias("place"), "region", "lon", "lat")
    candidates = flows.select("flow_id").join(own, F.col("flow_id").cast("int") % 25 == F.col("_own")).join(places, "region")
    return feasible(candidates.select("flow_id", "place", "lon", "lat", "from_lon", "from_lat"), flows.select("flow_id", "median"))
