"""Helpers that several operators share: joins with hot keys, numbers within keys and column handling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import release, shared_dir, stored

__all__ = ["ASCII_UPPER", "HOT_SHARE", "join_facts", "lower_ascii", "numbered", "release", "shared_dir", "stored", "table"]

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key that more than this share of all rows has is hot; so there are fewer than 1 / HOT_SHARE hot keys, whatever the number of rows.
HOT_SHARE = 0.001


def join_facts(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined with one fact row for each key (keys, n and more; n: how many of the rows have the key).

    The rows of a hot key stay where they are and its fact comes to them by
    broadcast: of facts with n above HOT_SHARE of all rows there are fewer than
    1 / HOT_SHARE.  All others meet in a merge join, where no key is hot.
    """
    facts = stored(facts)
    n_rows = facts.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > max(1_000.0, HOT_SHARE * n_rows)
    few, many = facts.where(hot), facts.where(~hot)
    common = rows.join(F.broadcast(few), keys)
    rest = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(many.hint("merge"), keys)
    return common.unionByName(rest)


def numbered(rows: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """rows with their number, from 1, within the keys (never null) in the given order, as a column ``name``.

    Rows are dealt into slices of the order over all keys; a row's number is its
    place in its slice after the key's rows in the slices before.  A key with
    many rows lies in many slices, and so do rows that are equal in keys and
    order, which a number of their own tells apart.  There is a row for each key
    and slice to add up, never more for one key than there are slices.
    """
    dealt = rows.withColumn("_own", F.monotonically_increasing_id())
    dealt = stored(dealt.repartitionByRange(*keys, *order, F.col("_own")).withColumn("_slice", F.spark_partition_id()))
    counts = dealt.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*keys, "_slice", F.coalesce(earlier, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(*order, "_own"))
    found = dealt.withColumn("_place", place).join(counts, [*keys, "_slice"])
    return found.select(*rows.columns, (F.col("_before") + F.col("_place")).alias(name))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())
