"""Joins in time and by position, parity of tables, membership and nearest points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import haversine_km, min_rtt_ms


def with_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Cross join with an aggregate of exactly one row."""
    return df.crossJoin(F.broadcast(one_row))


def missing_baseline(rows: DataFrame, cards: DataFrame) -> DataFrame:
    return rows.select("flow_id").distinct().join(cards, "flow_id", "left_anti")


def numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("row_no", F.row_number().over(Window.partitionBy("flow_id").orderBy("t")))


def range_window(rows: DataFrame, k: int, value: str) -> DataFrame:
    """Trailing-k aggregates of a value by a self-join on positions: an independent path to the window functions.

    Each row is dealt to the k positions that see it, so the join is on equality.
    """
    n = numbered(rows).select("flow_id", "row_no", "t", value)
    seen = n.select("flow_id", F.explode(F.sequence(F.col("row_no"), F.col("row_no") + k - 1)).alias("row_no"), F.col(value).alias("_seen"))
    return n.join(seen, ["flow_id", "row_no"]).groupBy("flow_id", "row_no", "t").agg(F.min("_seen").alias("min_k"), F.avg("_seen").alias("mean_k"), F.count("_seen").alias("n_k"))


def join_ahead(rows: DataFrame, k: int, value: str) -> DataFrame:
    """The value k positions later, by a join: an independent path to lead."""
    n = numbered(rows)
    later = n.select("flow_id", (F.col("row_no") - k).alias("row_no"), F.col(value).alias("ahead"), F.col("t").alias("t_ahead"))
    return n.select("flow_id", "row_no", "t", value).join(later, ["flow_id", "row_no"], "left")


def lookup_at(rows: DataFrame) -> DataFrame:
    """Verifiable rows with the class found at exactly (flow, t_future)."""
    at = rows.select("flow_id", F.col("t").alias("t_future"), F.col("status_now").alias("found"))
    return rows.where("status_future IS NOT NULL").select("flow_id", "t", "t_future", "status_future").join(at, ["flow_id", "t_future"], "left")


def count_between(rows: DataFrame) -> DataFrame:
    """For verifiable rows, how many rows of the flow lie in (t, t_future].

    The number of rows up to an instant is a running count over rows and asked
    instants together, so a flow's work grows with its rows, not with their pairs.
    """
    ask = rows.where("status_future IS NOT NULL").select("flow_id", "t", F.explode(F.array(F.struct(F.col("t").alias("at"), F.lit(-1).alias("sign")), F.struct(F.col("t_future").alias("at"), F.lit(1).alias("sign")))).alias("end"))
    asked = ask.select("flow_id", "t", "end.at", "end.sign", F.lit(0).alias("there"))
    have = rows.select("flow_id", F.lit(None).cast(dict(rows.dtypes)["t"]).alias("t"), F.col("t").alias("at"), F.lit(0).alias("sign"), F.lit(1).alias("there"))
    upto = Window.partitionBy("flow_id").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counted = asked.unionByName(have).withColumn("upto", F.sum("there").over(upto)).where("sign <> 0")
    return counted.groupBy("flow_id", "t").agg(F.sum(F.col("sign") * F.col("upto")).alias("n_between"))


def as_of(rows: DataFrame, instant: Column) -> DataFrame:
    return rows.where(F.col("t") <= instant)


def last_before(rows: DataFrame, instant: Column, time: str = "t", cols: tuple[str, ...] = ("t", "status_now")) -> DataFrame:
    """The latest row of each flow at an instant."""
    return rows.where(F.col(time) <= instant).groupBy("flow_id").agg(F.max_by(F.struct(*cols), F.struct(time, "t")).alias("_row")).select("flow_id", *(F.col(f"_row.{c}").alias(c) for c in cols))


def as_of_join(instants: DataFrame, rows: DataFrame, cols: tuple[str, ...] = ("status_now",)) -> DataFrame:
    """For every (flow, instant) of a table, the flow's latest row then: one shuffle, no range join."""
    asks = instants.select("flow_id", F.col("instant").alias("_at"), F.lit(1).alias("_ask"), F.lit(None).cast("timestamp_ntz").alias("t"), *(F.lit(None).cast(dict(rows.dtypes)[c]).alias(c) for c in cols))
    have = rows.select("flow_id", F.col("t").alias("_at"), F.lit(0).alias("_ask"), "t", *cols)
    seen = Window.partitionBy("flow_id").orderBy("_at", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    row = F.last(F.when(F.col("_ask") == 0, F.struct("t", *cols)), ignorenulls=True).over(seen)
    found = have.unionByName(asks).withColumn("_row", row).where("_ask = 1")
    return found.select("flow_id", F.col("_at").alias("instant"), *(F.col(f"_row.{c}").alias(c) for c in ("t", *cols)))


def restrict(rows: DataFrame, probes: DataFrame, destinations: DataFrame) -> DataFrame:
    """Rows of the wanted probes and destinations, with what those tables say of them."""
    return rows.join(probes, "probe").join(destinations, "destination")


def compare_tables(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], tol: float, rel: float = 0.0) -> DataFrame:
    """Keys that only one table has, that repeat, or whose values differ by more than tol and by more than their share rel."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count("*").alias(f"_n{name}"), *(F.first(v).alias(f"{v}_{name}") for v in values))

    both = side(a, "a").join(side(b, "b"), keys, "full_outer")
    apart = []
    for v in values:
        x, y = F.col(f"{v}_a"), F.col(f"{v}_b")
        room = F.greatest(F.lit(tol), rel * F.greatest(F.abs(x), F.abs(y))) if rel else F.lit(tol)
        far = F.abs(x - y) > room if dict(a.dtypes)[v] in ("double", "float", "int", "bigint") else ~x.eqNullSafe(y)
        apart.append(F.when(x.isNull() != y.isNull(), True).otherwise(F.coalesce(far, F.lit(False))))
    why = F.when(F.col("_na").isNull(), "only_b").when(F.col("_nb").isNull(), "only_a").when((F.col("_na") > 1) | (F.col("_nb") > 1), "repeated").when(reduce(lambda p, q: p | q, apart), "differs")
    return both.withColumn("why", why).where("why IS NOT NULL").select(*keys, "why")


def present_in_all(df: DataFrame, key: str, group: str, n: int) -> DataFrame:
    """Keys that stand in all n groups (relational division)."""
    return df.groupBy(key).agg(F.count_distinct(group).alias("groups")).where(F.col("groups") == n).select(key)


def feasible(candidates: DataFrame, flows: DataFrame) -> DataFrame:
    """Candidate places of a flow that light can reach within its median; if none, the nearest one.

    candidates: (flow_id, place, lon, lat, from_lon, from_lat); flows: (flow_id, median).
    """
    km = haversine_km(F.col("from_lon"), F.col("from_lat"), F.col("lon"), F.col("lat"))
    both = candidates.join(flows, "flow_id").withColumn("rtt_min", min_rtt_ms(km)).withColumn("ok", F.col("rtt_min") <= F.col("median"))
    place = F.row_number().over(Window.partitionBy("flow_id").orderBy("rtt_min", "place"))
    any_ok = F.max("ok").over(Window.partitionBy("flow_id"))
    return both.select("*", place.alias("_place"), any_ok.alias("_any")).where("ok OR (NOT _any AND _place = 1)").drop("_place", "_any")


def nearest(points: DataFrame, hubs: DataFrame, most_hubs: int = 10_000) -> DataFrame:
    """The nearest hub of each point by great circle; hubs are a dimension of checked, bounded size."""
    if hubs.limit(most_hubs + 1).count() > most_hubs:
        raise ValueError(f"more than {most_hubs} hubs; give a dimension of bounded size")
    h = hubs.select("hub", F.col("lon").alias("_lon"), F.col("lat").alias("_lat"))
    km = haversine_km(F.col("lon"), F.col("lat"), F.col("_lon"), F.col("_lat"))
    both = points.crossJoin(F.broadcast(h)).withColumn("km", km)
    best = both.groupBy(*points.columns).agg(F.min(F.struct("km", "hub")).alias("_best"))
    return best.select(*points.columns, F.col("_best.hub").alias("hub"), F.col("_best.km").alias("km"))


def new_rows(batch: DataFrame, seen: DataFrame) -> DataFrame:
    return batch.join(seen.select("flow_id", "t"), ["flow_id", "t"], "left_anti")


def common_ids(first: DataFrame, *more: DataFrame) -> DataFrame:
    return reduce(DataFrame.intersect, more, first)


def id_drift(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one of two tables holds."""
    only_a = a.select(key).distinct().join(b.select(key), key, "left_anti").withColumn("side", F.lit("a"))
    only_b = b.select(key).distinct().join(a.select(key), key, "left_anti").withColumn("side", F.lit("b"))
    return only_a.unionByName(only_b)


def overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that both tables hold; disjoint tables give none."""
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), keys, "left_semi")


def different_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows, with repeats, that only one table holds; equal tables give none."""
    cols = a.columns
    return a.exceptAll(b.select(*cols)).withColumn("side", F.lit("a")).unionByName(b.select(*cols).exceptAll(a).withColumn("side", F.lit("b")))


def candidates(places: DataFrame, wanted: DataFrame, known: DataFrame, key: str, group: str) -> DataFrame:
    """Keys of places in a wanted group that are not known yet."""
    return places.join(wanted.select(group), group, "left_semi").join(known.select(key), key, "left_anti").select(key)
