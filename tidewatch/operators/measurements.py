"""Bursts to measurements, periods, and removal of repeated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import array_mean, loss_pct, mean_step, timeout_flag, valid_rtts
from ..functions.params import Params


def flow_id(*cols: str, sep: str = "|") -> Column:
    return F.concat_ws(sep, *cols)


def split_flow_id(col: str, sep: str = "|") -> Column:
    return F.split(F.col(col), f"\\{sep}")


def route(origin: str, region: str) -> Column:
    return F.concat(F.lit(origin + "→"), F.col(region))


def tag_by_age(df: DataFrame, ages: dict[str, int], into: str) -> DataFrame:
    """Adds the name of the last span that has begun; ages: hours after the first instant of the whole table, ascending."""
    began = F.array(*(F.col("_zero") + F.expr(f"INTERVAL {hours} HOURS") for hours in ages.values()))
    passed = F.size(F.filter(began, lambda b: b <= F.col("t")))
    zero = df.agg(F.min("t").alias("_zero"))
    return df.crossJoin(F.broadcast(zero)).select(*df.columns, F.element_at(F.array(*map(F.lit, ages)), passed).alias(into))


def tag_period(df: DataFrame, hours: int) -> DataFrame:
    """Adds period: A for the hours after the first instant of the whole table, then B."""
    return tag_by_age(df, {"A": 0, "B": hours}, "period")


def measurements(bursts: DataFrame, origin: str = "net") -> DataFrame:
    """One row for each burst: flow, time, rtt, jitter, loss, timeout."""
    answers, rtt, loss = F.col("_answers"), F.col("rtt"), F.col("loss_pct")
    place = {
        "flow_id": flow_id("prb_id", "dst_addr", "msm_id"),
        **{c: F.col(c) for c in ("prb_id", "dst_addr", "msm_id")},
        "route": route(origin, "destination_region"),
        **{c: F.col(c) for c in ("destination_country", "destination_region")},
        "t": F.col("start_time"),
    }
    measured = {"rtt": array_mean(answers), "jitter": mean_step(answers), "loss_pct": loss_pct(F.col("packets_sent"), F.col("packets_received"))}
    rows = bursts.select("*", valid_rtts(F.col("pings")).alias("_answers")).select(*(c.alias(n) for n, c in (place | measured).items()))
    return rows.select("*", timeout_flag(rtt, loss).alias("is_timeout"))


def measure(bursts: DataFrame, p: Params) -> DataFrame:
    """Measurements with their period (cut before removal of repeats), each row once."""
    return dedup_exact(tag_period(measurements(bursts), p.baseline_hours))


def dedup_exact(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def dedup_key(df: DataFrame, keys: list[str], arrival: list[str]) -> DataFrame:
    """For each key the row that came first in the (total) order of arrival."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*arrival))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")
