"""Rule labels, labels some measurements ahead, and the split by time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import class_of_line, epoch_s, epoch_us, first_line, rule_number, status_of, whole_share
from ..functions.params import FIXED_RULE, Params
from ..sources.tables import with_position


def _by_flow():
    return Window.partitionBy("flow_id").orderBy("t")


def current_labels(rows: DataFrame, p: Params) -> DataFrame:
    return rows.withColumn("rule", rule_number(p)).withColumn("status_now", status_of(F.col("rule"), p))


def future_labels(rows: DataFrame, p: Params) -> DataFrame:
    """status_future: the class of the horizon-th next row if it lies within the gate, in whole seconds."""
    ahead = F.lead(F.struct("t", "status_now"), p.horizon).over(_by_flow())
    rows = rows.select("*", ahead.alias("_ahead"))
    wait = epoch_s(F.col("_ahead.t")) - epoch_s(F.col("t"))
    at, after = p.gate
    come = F.when((wait >= at) & (wait <= after), F.col("_ahead.status_now"))
    return rows.select("*", wait.alias("delta_s"), F.col("_ahead.t").alias("t_future"), come.alias("status_future")).drop("_ahead")


def tag_block(rows: DataFrame, splits: tuple[float, ...], names: tuple[str, ...] = ("train", "validation", "test")) -> DataFrame:
    """Adds block: the part of the whole time range, cut at ``splits``, that a row lies in.  Cuts are whole microseconds after the first row."""
    us = epoch_us(F.col("t"))
    span = rows.agg(F.min(us).alias("_zero"), (F.max(us) - F.min(us)).alias("_length"))
    cuts = span.select(F.array(*(F.col("_zero") + whole_share(F.col("_length"), s) for s in splits)).alias("_cuts"))
    number = F.size(F.filter("_cuts", lambda c: c <= us))
    return rows.crossJoin(F.broadcast(cuts)).select(*rows.columns, F.get(F.array(*map(F.lit, names)), number).alias("block"))


def tag_block_by_rows(rows: DataFrame, order: list[str], splits: tuple[float, float]) -> DataFrame:
    """Adds position, the place in a total order, and block by position, without sorting all rows in one task."""
    out = with_position(rows, order)
    ends = out.agg(F.count("*").alias("_all")).select(*(whole_share(F.col("_all"), s).alias(f"_end{i}") for i, s in enumerate(splits)))
    block = F.when(F.col("position") <= F.col("_end0"), "train").when(F.col("position") <= F.col("_end1"), "validation").otherwise("test")
    return out.crossJoin(F.broadcast(ends)).select(*out.columns, block.alias("block"))


def split_ties(rows: DataFrame) -> DataFrame:
    """Pairs of neighbouring blocks that share an instant at their border."""
    ends = rows.groupBy("block").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    a, b = ends.alias("a"), ends.alias("b")
    return a.join(b, (F.col("a.last_t") == F.col("b.first_t")) & (F.col("a.block") != F.col("b.block"))).select(F.col("a.block").alias("earlier"), F.col("b.block").alias("later"), F.col("a.last_t").alias("t"))


def gap_flag(rows: DataFrame, k: int) -> DataFrame:
    """Adds in_gap: the last k rows of a flow in a block other than test, whose future another block holds."""
    back = F.row_number().over(Window.partitionBy("flow_id", "block").orderBy(F.desc("t")))
    return rows.withColumn("in_gap", (F.col("block") != "test") & (back <= k))


def usable_rows(rows: DataFrame, k: int) -> DataFrame:
    """Rows to learn from: with a future, not in the gap.  The gap is marked before rows without future go."""
    return gap_flag(rows, k).where("status_future IS NOT NULL AND NOT in_gap").drop("in_gap")


def future_block(rows: DataFrame, k: int) -> DataFrame:
    return rows.withColumn("future_block", F.lead("block", k).over(_by_flow()))


def verifiable(rows: DataFrame) -> DataFrame:
    return rows.withColumn("verifiable", F.col("status_future").isNotNull())


def with_predictions(rows: DataFrame) -> DataFrame:
    """Two predictions that need no model: nothing changes, and a fixed rule on the mean z."""
    return rows.select("*", F.col("status_now").alias("persistence_pred"), class_of_line(first_line(FIXED_RULE), FIXED_RULE).alias("rule_pred"))


def labelled(rows: DataFrame, p: Params) -> DataFrame:
    return tag_block(future_labels(current_labels(rows, p), p), p.splits)


def floor_effect(rows: DataFrame, p: Params) -> DataFrame:
    """How labels move when rule 3 asks for a large increase too."""
    from dataclasses import replace

    without = rule_number(replace(p, floor=None))
    both = rows.select(rule_number(p).alias("rule_with"), without.alias("rule_without"))
    return both.groupBy("rule_without", "rule_with").agg(F.count("*").alias("n"))
