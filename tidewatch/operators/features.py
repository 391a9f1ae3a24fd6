"""Features of a measurement against its card and over the last measurements of its flow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import deviated, flag, jitter_ratio, moderate, robust_z
from ..functions.params import BASELINE_COLUMNS, TRAILING, Params


def attach_baseline(rows: DataFrame, cards: DataFrame) -> DataFrame:
    """Inner join with the usable cards; flows without one drop out."""
    return rows.join(cards.where("NOT insufficient").select("flow_id", *BASELINE_COLUMNS), "flow_id")


def relative_metrics(rows: DataFrame, p: Params) -> DataFrame:
    """Adds a measurement's relation to its card, in two steps: numbers, then the flags that read them."""
    times = F.try_divide("rtt", "median")
    numbers = {"latency_ratio": times, "increase_pct": F.try_divide(F.col("rtt") - F.col("median"), "median") * 100, "robust_z": robust_z(p), "jitter_ratio": jitter_ratio(p)}
    flags = {"moderate": flag(moderate(p)), "deviated": flag(deviated(p))}
    for step in (numbers, flags):
        rows = rows.select("*", *(c.alias(n) for n, c in step.items()))
    return rows


def _trailing(rows: DataFrame, p: Params, frame, null_as_zero: bool) -> DataFrame:
    """The table of trailing features, and the trend, over one frame."""
    large = F.col("increase_pct") > p.increase_fail
    sources = {"large_increase": flag(large) if null_as_zero else large.cast("int")}
    aggregates = {"sum": F.sum, "avg": F.avg, "min": F.min}
    named = (aggregates[how](sources.get(c, F.col(c))).over(frame).alias(name) for name, how, c in TRAILING)
    away = F.col("rtt") - F.avg("rtt").over(frame)
    return rows.select("*", *named, F.try_divide(away, "median").alias("trend"))


def window_features(rows: DataFrame, p: Params, null_as_zero: bool = False) -> DataFrame:
    """Aggregates over the last measurements by count, in one shuffle and one sort.

    null_as_zero: large increases of rows without rtt count as 0 instead of null.
    """
    return _trailing(rows, p, Window.partitionBy("flow_id").orderBy("t").rowsBetween(1 - p.window, 0), null_as_zero)


def chunked_window(rows: DataFrame, p: Params, bucket_s: int, null_as_zero: bool = False) -> DataFrame:
    """The same for flows too long for one task: pieces of a flow by time, each with its predecessors' last rows.

    A piece may be shorter than the frame, so the rows it lacks are looked up in
    as many pieces as needed: the number of rows of each piece is known from a
    small aggregate, and each row joins the pieces in whose halo it lies.
    """
    k = p.window - 1
    rows = rows.withColumn("_piece", F.floor(F.col("t").cast("timestamp").cast("long") / bucket_s))
    from_end = F.row_number().over(Window.partitionBy("flow_id", "_piece").orderBy(F.desc("t")))
    tail = rows.withColumn("_back", from_end).where(F.col("_back") <= k)
    counts = rows.groupBy("flow_id", "_piece").agg(F.count("*").alias("_n"))
    order = Window.partitionBy("flow_id").orderBy("_piece")
    # For each piece, the pieces after it within reach: fewer than k rows lie between.
    before = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.select("flow_id", "_piece", before.alias("_upto"), (before - F.col("_n")).alias("_start"))
    following = F.collect_list(F.struct("_piece", "_start")).over(order.rowsBetween(1, k))
    reach = placed.withColumn("_following", following).select("flow_id", "_piece", "_upto", F.explode("_following").alias("_next")).where(F.col("_next._start") - F.col("_upto") < k)
    reach = reach.select("flow_id", "_piece", F.col("_next._piece").alias("_to"), (F.col("_next._start") - F.col("_upto")).alias("_between"))
    halo = tail.join(reach, ["flow_id", "_piece"]).where(F.col("_between") + F.col("_back") <= k)
    halo = halo.drop("_piece", "_back", "_between").withColumnRenamed("_to", "_piece").withColumn("_own", F.lit(False))
    both = rows.withColumn("_own", F.lit(True)).unionByName(halo)
    frame = Window.partitionBy("flow_id", "_piece").orderBy("t").rowsBetween(-k, 0)
    return _trailing(both, p, frame, null_as_zero).where("_own").drop("_own", "_piece")


def features(measured: DataFrame, cards: DataFrame, p: Params, null_as_zero: bool = False) -> DataFrame:
    rows = relative_metrics(attach_baseline(measured.where("period = 'B'"), cards), p)
    return window_features(rows, p, null_as_zero).drop(*BASELINE_COLUMNS)
