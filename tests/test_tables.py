"""Places in a total order, and stored tables."""

import os
import random

from pyspark.sql import functions as F

from tidewatch.operators import labels
from tidewatch.sources.tables import release, stored, with_position


def rows_of(spark, n, instants):
    rnd = random.Random(7)
    rows = [(rnd.randrange(instants), f"f{i}") for i in range(n)] + [(None, "none")]
    rnd.shuffle(rows)
    return rows, spark.createDataFrame(rows, "t long, flow_id string").repartition(5)


def test_positions_follow_the_whole_order(spark):
    for instants in (1, 3, 5_000):  # one instant for all: the second column alone cuts the slices
        rows, df = rows_of(spark, 3_000, instants)
        got = {(r.t, r.flow_id): r.position for r in with_position(df, ["t", "flow_id"]).collect()}
        want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        assert got == {r: i for i, r in enumerate(want, 1)}
    assert with_position(df.where("1 = 0"), ["t"]).collect() == []


def test_rows_of_one_instant_lie_in_many_slices(spark):
    aqe = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(40_000).select(F.lit(1).alias("t"), "id", F.lit("x").alias("_n"))
        slices = with_position(df, ["t", "id"]).where("position = id + 1").groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in slices) == 40_000 and max(r["count"] for r in slices) < 40_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", aqe)


def test_blocks_by_position(spark):
    _, df = rows_of(spark, 1_000, 4)
    out = labels.tag_block_by_rows(df, ["t", "flow_id"], (0.5, 0.7))
    assert out.columns == ["t", "flow_id", "position", "block"]
    ends = {r.block: (r.a, r.b) for r in out.groupBy("block").agg(F.min("position").alias("a"), F.max("position").alias("b")).collect()}
    assert ends == {"train": (1, 500), "validation": (501, 700), "test": (701, 1001)}


def test_blocks_end_at_whole_shares(spark):
    df = spark.range(90).select("id", F.timestamp_micros("id").cast("timestamp_ntz").alias("t"))  # 0.7 * 90 is 62.99999999999999 in doubles
    rows = labels.tag_block_by_rows(df, ["id"], (0.5, 0.7)).groupBy("block").count().collect()
    assert {r["block"]: r["count"] for r in rows} == {"train": 45, "validation": 18, "test": 27}
    times = labels.tag_block(df.unionByName(df.limit(1).select(F.lit(90).cast("long").alias("id"), F.timestamp_micros(F.lit(90)).cast("timestamp_ntz").alias("t"))), (0.5, 0.7))
    assert {r.block: r.first for r in times.groupBy("block").agg(F.min("id").alias("first")).collect()} == {"train": 0, "validation": 45, "test": 63}


def test_a_released_table_is_gone(spark):
    kept, gone = stored(spark.range(5)), stored(spark.range(5))
    release(gone)
    assert kept.count() == 5
    assert not os.path.exists(gone._stored_at.removeprefix("file://")) and os.path.exists(kept._stored_at.removeprefix("file://"))
