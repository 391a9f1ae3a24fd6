"""Operator 6: mixing sources to target weights by cube-method balanced sampling.

Each source gets a target by weight, stopped at CAP times its size, the excess
reshared by weight.  A document of a source is taken floor(r) times, r being
target over size, and once more with probability r - floor(r).  The last draw is
balanced: the flight phase moves the probabilities of three documents at a time
along the direction that changes neither their expected words nor their expected
number, until all but two of a group are 0 or 1.  A source is flown in groups of
bounded size, then what stays undecided is flown in groups of groups, so a hot
source needs no large task.  The landing problem, two documents for each source,
takes the rounding whose words are nearest.

Defined results: a null text has size 0 and is never taken; a null source is a
source of its own; equal rows are drawn one by one; a source without words has
target 0; other columns are not read.  Reruns agree: draws follow from hashes of
the rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import HOT_SHARE, stored, table

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (3, 1, 2)
#: All targets together, as a share of all words.
SHARE = 1.5
#: A target's bound, in sizes of its source.
CAP = 2
#: Documents of a first group, and groups whose rests are flown together.
GROUP, FAN = 256, 128

#: Equal rows that are told apart in one step.
EQUAL = 10_000

_UNIT = "doc_id long, source string, size long, row_hash long, nth long, source_size long, target double, copies long, bucket long, chance double"


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, row_hash): size counts the words, row_hash fixes the draws."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]++")).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), F.xxhash64("doc_id", "source", "text").alias("row_hash"))


def numbered(units: DataFrame) -> DataFrame:
    """The units with a number ``nth`` among equal ones, so that equal ones needn't share a bucket.

    Equal units are counted, then written out again by pieces of EQUAL: no task
    gathers them, whatever their number.
    """
    counted = units.groupBy(*units.columns).agg(F.count("*").alias("_n"))
    pieces = counted.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {EQUAL}"))))
    dealt = pieces.repartition("row_hash", "_piece")
    first = F.col("_piece") * EQUAL
    return dealt.select(*units.columns, F.explode(F.sequence(first, F.least(F.col("_n"), first + EQUAL) - 1)).alias("nth"))


def targets(units: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, n_rows, source_size, target): one row for each source.

    The windows run over the sources, not over documents.
    """
    by = units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*map(F.lit, weights)), number % len(weights)).cast("double")
    by = by.select("*", number.alias("number"), weight.alias("weight"))
    by = by.withColumn("full_at", cap * F.col("source_size") / F.col("weight"))
    order = Window.orderBy("full_at", "number")
    before = F.coalesce(F.sum(cap * F.col("source_size")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = share * F.sum("source_size").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    by = by.withColumn("level", (total - before) / rest)
    open_level = F.min(F.when(F.col("full_at") >= F.col("level"), F.struct("full_at", "number", "level")))
    by = by.withColumn("unit", open_level.over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))["level"])
    target = F.least(cap * F.col("source_size").cast("double"), F.coalesce(F.col("unit") * F.col("weight"), F.lit(float("inf"))))
    return by.select("source", "n_rows", "source_size", target.alias("target"))


def flight(size: np.ndarray, chance: np.ndarray, draws: np.random.Generator) -> np.ndarray:
    """Moves chances within [0, 1], keeping sum(chance) and sum(size * chance), until at most two lie between."""
    out = chance.copy()
    active: list[int] = []
    for i in range(len(out)):
        if not 0 < out[i] < 1:
            continue
        active.append(i)
        if len(active) < 3:
            continue
        a, b, c = (float(size[j]) for j in active)
        step = [b - c, c - a, a - b] if not a == b == c else [1.0, -1.0, 0.0]
        now = [float(out[j]) for j in active]
        up = min((1 - p) / s if s > 0 else p / -s for p, s in zip(now, step) if s)
        down = min(p / s if s > 0 else (1 - p) / -s for p, s in zip(now, step) if s)
        move = up if draws.random() * (up + down) < down else -down
        left = []
        for j, p, s in zip(active, now, step):
            p += move * s
            out[j] = 0.0 if p < 1e-9 else 1.0 if p > 1 - 1e-9 else p
            if 0 < out[j] < 1:
                left.append(j)
        active = left
    return out


def landing(size: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Rounds the few chances between 0 and 1 so that the words come nearest."""
    out = chance.copy()
    between = np.flatnonzero((out > 0) & (out < 1))
    wanted = float(np.dot(size[between], out[between]))
    best = min(range(2 ** len(between)), key=lambda m: (abs(sum(float(size[j]) for k, j in enumerate(between) if m >> k & 1) - wanted), m))
    for k, j in enumerate(between):
        out[j] = float(best >> k & 1)
    return out


def _flown(last: bool, level: int):
    def fly(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["row_hash", "nth", "doc_id", "size"], kind="stable", ignore_index=True)
        size, chance = group["size"].to_numpy(), group["chance"].to_numpy()
        seed = [level, int(group["bucket"].iloc[0]), int(np.bitwise_xor.reduce(group["row_hash"].to_numpy())) & (2**63 - 1)]
        chance = flight(size, chance, np.random.default_rng(seed))
        return group.assign(chance=landing(size, chance) if last else chance)

    return fly


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(doc_id, row_hash, size, source_size, target, copies, taken) for every document; taken counts words, repeats included."""
    units = stored(sizes(docs))
    goal = stored(targets(units, weights, share, cap)).withColumnRenamed("source", "goal_source")
    most = goal.agg(F.max("n_rows")).first()[0] or 0
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = numbered(units).join(goal, F.col("source").eqNullSafe(F.col("goal_source")))
    rows = rows.withColumn("copies", F.floor(ratio + 1e-12)).withColumn("chance", F.greatest(ratio - F.col("copies"), F.lit(0.0)))
    rows = rows.withColumn("chance", F.when((F.col("size") == 0) | (F.col("chance") < 1e-12), 0.0).otherwise(F.col("chance")))
    buckets = F.ceil(F.col("n_rows") / GROUP)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("row_hash", "nth"), buckets))
    names = [x.split()[0] for x in _UNIT.split(", ")]
    open_rows, done, groups, level = rows.select(*names), [], -(-most // GROUP), 0
    while True:
        flown = stored(open_rows.groupBy("source", "bucket").applyInPandas(_flown(groups <= 1, level), _UNIT))
        done.append(flown.where((F.col("chance") <= 0) | (F.col("chance") >= 1)))
        if groups <= 1:
            break
        open_rows = flown.where((F.col("chance") > 0) & (F.col("chance") < 1)).withColumn("bucket", F.floor(F.col("bucket") / FAN))
        groups, level = -(-groups // FAN), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    out = out.withColumn("copies", F.when(F.col("size") > 0, F.col("copies") + F.col("chance").cast("long")).otherwise(0))
    return out.select("doc_id", "row_hash", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeat_taken(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """The rows of docs (doc_id, text, source and more), each as often as the mix takes it.

    Rows without words are never taken.  Rows with equal id, source and text are
    told apart by nothing, so any of them stands for all their copies.
    """
    taken = stored(mix(docs, weights, share, cap).where("copies > 0").groupBy("row_hash").agg(F.sum("copies").alias("_copies")))
    total = taken.agg(F.sum("_copies")).first()[0] or 0
    # Rows that make up more than a thousandth of the mix: fewer than 1,000, so they may be broadcast.
    often = F.col("_copies") > max(EQUAL, HOT_SHARE * total)
    few = stored(taken.where(often))
    rows = docs.select(F.struct("*").alias("_row"), F.xxhash64("doc_id", "source", "text").alias("row_hash"))
    # Repeats go before the shuffle, which serves the join too; the keys of the others are never broadcast.
    others = rows.join(F.broadcast(few), "row_hash", "left_anti").dropDuplicates(["row_hash"]).join(taken.where(~often).hint("merge"), "row_hash")
    others = others.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_nth"))
    many = rows.join(F.broadcast(few), "row_hash").dropDuplicates(["row_hash"])
    many = many.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_copies - 1) div {EQUAL}"))).alias("_piece")).repartition("row_hash", "_piece")
    many = many.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(EQUAL).cast("long"), F.col("_copies") - F.col("_piece") * EQUAL))).alias("_nth"))
    return others.unionByName(many).select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")
