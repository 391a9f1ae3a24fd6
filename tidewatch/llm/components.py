"""Connected components of a graph by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, release, stored

#: A node with fewer edges than this is never a hub.
HUB = 100_000


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of the edges (a, b) reaches, for nodes other than that one.

    A step joins each node's edges with its least neighbour.  A node that has
    more than HUB edges and HOT_SHARE of all is a hub: its edges stay where they
    are and its least neighbour, one row, comes to them, so no task gathers its
    neighbourhood.  The edges never reach the driver, which sees the fewer than
    1 / HOT_SHARE hubs only.  Null ends and loops are left out; without edges the
    result is empty.
    """
    ends = edges.where("a <> b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
    now = stored(ends.distinct())
    seen = _digest(now)
    while seen[0]:
        both = now.select(F.col("high").alias("u"), F.col("low").alias("v")).unionByName(now.select(F.col("low").alias("u"), F.col("high").alias("v")))
        hubs = _hubs(both, 2 * seen[0])
        large = _with_least(both, hubs).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        # A node's edges in large are at most those to lower nodes that it has now, so it holds no other hubs.
        large = stored(large) if hubs else large
        small = _with_least(large, hubs).select(F.explode(F.array(F.struct(F.col("v").alias("high"), F.col("m").alias("low")), F.struct(F.col("u").alias("high"), F.col("m").alias("low")))).alias("e"))
        old, now = now, stored(small.select("e.low", "e.high").where("low < high").distinct())
        for done in [old, large] if hubs else [old]:
            release(done)
        before, seen = seen, _digest(now)
        if seen == before:
            break
    return now.select(F.col("high").alias("node"), F.col("low").alias("component"))


def _hubs(both: DataFrame, n_edges: int) -> list[int]:
    """The hubs among the nodes u, of which there are fewer than 1 / HOT_SHARE."""
    limit = max(HUB, HOT_SHARE * n_edges)
    if n_edges <= limit:
        return []
    return [r.u for r in both.groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("u").collect()]


def _with_least(edges: DataFrame, hubs: list[int]) -> DataFrame:
    """edges (u, v) with m, the least v of their u."""

    def least(rows: DataFrame) -> DataFrame:
        return rows.groupBy("u").agg(F.min("v").alias("m"))

    if not hubs:
        return edges.join(least(edges), "u")
    many, rest = edges.where(F.col("u").isin(hubs)), edges.where(~F.col("u").isin(hubs))
    return rest.join(least(rest), "u").unionByName(many.join(F.broadcast(least(many)), "u"))


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first())


def local_roots(n: int, a: np.ndarray, b: np.ndarray, roots: np.ndarray | None = None) -> np.ndarray:
    """The least index that each of n indexes reaches over the pairs (a, b), on top of the given roots."""
    roots = np.arange(n) if roots is None else roots
    while True:
        x, y = roots[a], roots[b]
        apart = x != y
        if not apart.any():
            return roots
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(roots, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = roots[roots]
            if (up == roots).all():
                break
            roots = up
