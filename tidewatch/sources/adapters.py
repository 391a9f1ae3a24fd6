"""The given tables in the shapes of the engine: measurement rows, nested bursts, dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.measurements import measure, tag_period
from ..functions.params import EVENT_PARAMS, ORDER_PARAMS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as measurements: a flow is a user, an error a burst without answer."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    bad = F.col("event_type") == "error"
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("flow_id"),
        (F.col("user_id") % 5).cast("int").alias("region"),
        F.concat(F.lit("net→"), (F.col("user_id") % 5).cast("string")).alias("route"),
        F.col("ts").alias("t"),
        F.when(~bad, F.col("value")).alias("rtt"),
        F.when(~bad, F.abs(F.col("value") - F.lag("value").over(by))).alias("jitter"),
        F.when(bad, 100.0).otherwise(0.0).alias("loss_pct"),
        bad.cast("int").alias("is_timeout"),
    )
    return tag_period(rows, EVENT_PARAMS.baseline_hours)


def order_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as bursts of pings, their lines."""
    lines = table(spark, sf_dir, "lineitem")
    late = F.col("l_discount") >= 0.10
    ping = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", F.when(late, 0.0).otherwise(F.col("l_quantity").cast("double")).alias("rtt"), late.alias("timeout"))
    bursts = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(ping)).alias("all"), F.count("*").cast("int").alias("packets_sent"), F.count_if(~late).cast("int").alias("packets_received"))
    bursts = bursts.withColumn("pings", F.transform("all", lambda p: F.struct(p["rtt"].alias("rtt"), p["timeout"].alias("timeout")))).drop("all")
    where = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    where = where.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("prb_id"), F.col("n_name").alias("destination_country"), F.col("r_name").alias("destination_region"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("dst_addr"), (F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("o_orderkey") % 86400)).alias("start_time"))
    return orders.join(bursts, "o_orderkey").join(where, "o_custkey").select("o_orderkey", "start_time", F.lit(1).cast("long").alias("msm_id"), "prb_id", "dst_addr", "destination_country", "destination_region", "packets_sent", "packets_received", "pings")


def order_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same bursts as JSON results of a measurement service (column value), among them lost pings and results of another type."""
    ping = lambda p: F.struct(F.when(~p["timeout"], p["rtt"]).alias("rtt"), F.when(p["timeout"], "*").alias("x"))
    result = F.struct(
        F.when(F.col("o_orderkey") % 50 == 0, "traceroute").otherwise("ping").alias("type"), "prb_id", "msm_id", "dst_addr",
        F.unix_seconds(F.col("start_time").cast("timestamp")).alias("timestamp"), F.col("packets_sent").alias("sent"), F.col("packets_received").alias("rcvd"),
        F.transform("pings", ping).alias("result"),
    )
    return order_bursts(spark, sf_dir).select(F.to_json(result).alias("value"))


def order_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(order_bursts(spark, sf_dir), ORDER_PARAMS)


def hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as points: (hub, name, lon, lat)."""
    k = F.col("n_nationkey").cast("int")
    return table(spark, sf_dir, "nation").select(k.alias("hub"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("int").alias("region"), (k * 37 % 360 - 180).cast("double").alias("lon"), (k * 17 % 180 - 90).cast("double").alias("lat"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as points: (probe, nation, lon, lat)."""
    k = F.col("s_suppkey").cast("int")
    return table(spark, sf_dir, "supplier").select(k.alias("probe"), F.col("s_nationkey").cast("int").alias("nation"), (k * 37 % 360 - 180).cast("double").alias("lon"), (k * 17 % 180 - 90).cast("double").alias("lat"))
