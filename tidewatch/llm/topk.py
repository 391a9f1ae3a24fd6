"""Operator 2: exact top-k by inner product with no-random-access aggregation.

The candidates are dealt out in blocks of bounded size, and so are the queries;
each pair of blocks is one task's work.  A block keeps a sorted list of its
candidates for every dimension.  For a query, the lists are read sequentially
from the end that the sign of the query's component prefers.  What has been read
gives each candidate a lower score bound (unread components at the list's worst
value) and an upper one (unread components at the value read last).  Reading
stops when all but a few candidates have upper bounds below the k-th lower
bound; the scores of those few are then resolved.  The best of each block meet
in one window for each query.

Defined results: vectors that are null, or hold null or non-finite components,
take no part, nor do rows with a null vec_id; rows with the query's vec_id are
not its candidates; rows with the same id and vector ask once but are candidates
as often as they stand there; vectors of different lengths aren't compared; ties
go to the smaller vec_id; other columns are not read.  Bounds are in floating
point, with room for their rounding; scores are exact integers, and those that
64 bits can't hold stop at the nearest that they can.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, table

K = 5
#: Queries and candidates of a block.
QUERIES, CANDIDATES = 512, 4096
#: Queries whose bounds are computed together.
TOGETHER = 128
#: Shares of the lists after which the bounds are compared.
DEPTHS = (0.1, 0.25, 0.4, 0.55, 0.7, 0.85)
#: Candidates whose scores are resolved at the end, as a multiple of k.
RESOLVED = 8


class SortedLists:
    """The sorted lists of a block of integer vectors, read from the top or, for negative weights, from the bottom."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.exact, self.vectors = ids, vectors, vectors.astype(float)
        self.order = np.argsort(self.exact, axis=0, kind="stable")
        self.values = np.take_along_axis(self.vectors, self.order, axis=0)
        self.largest = np.abs(self.vectors).max(axis=0, initial=0.0)

    def scores(self, which: np.ndarray, query: np.ndarray) -> np.ndarray:
        """The exact inner products of some candidates with a query."""
        if np.abs(query.astype(float)) @ self.largest < 2.0**62:
            return self.exact[which] @ query
        sums = self.exact[which].astype(object) @ query.astype(object)
        return np.array([min(max(x, -(2**63)), 2**63 - 1) for x in sums], np.int64)

    def read(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Which entries of each list the first ``depth`` sequential reads have met: from the top, from the bottom."""
        top, bottom = np.zeros(self.vectors.shape), np.zeros(self.vectors.shape)
        np.put_along_axis(top, self.order[len(self.ids) - depth :], 1.0, axis=0)
        np.put_along_axis(bottom, self.order[:depth], 1.0, axis=0)
        return top, bottom

    def top(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query, ids and scores of the k best candidates that don't have its id.

        Queries read the same lists, so the bounds of all that still read are computed together.
        """
        n = len(self.ids)
        weights = queries.astype(float)
        # Twice what rounding can move a bound by.
        slack = (np.abs(weights) @ self.largest) * (self.vectors.shape[1] + 8) * 2.0**-50
        mine = self.ids[:, None] == query_ids
        alive = [np.flatnonzero(~mine[:, q]) for q in range(len(queries))]
        reading = np.array([q for q in range(len(queries)) if len(alive[q]) > RESOLVED * k], np.int64)
        for depth in (int(n * share) for share in DEPTHS):
            if not len(reading):
                break
            if depth < 1:
                continue
            top, bottom = self.read(depth)
            up, down = np.maximum(weights[reading], 0).T, np.minimum(weights[reading], 0).T
            known = (top * self.vectors) @ up + (bottom * self.vectors) @ down

            def unread(from_top: np.ndarray, from_bottom: np.ndarray) -> np.ndarray:
                """What the unread entries add if each has its list's given value."""
                high, low = up * from_top[:, None], down * from_bottom[:, None]
                return (high + low).sum(axis=0) - top @ high - bottom @ low

            least = known + unread(self.values[0], self.values[-1])
            most = known + unread(self.values[n - depth], self.values[depth - 1])
            own = mine[:, reading]
            least[own], most[own] = -np.inf, -np.inf
            bound = np.partition(least, n - k, axis=0)[n - k]
            able = most >= bound - slack[reading]
            for column, q in enumerate(reading):
                alive[q] = np.flatnonzero(able[:, column])
            reading = reading[able.sum(axis=0) > RESOLVED * k]
        out = []
        for q in range(len(queries)):
            scores = self.scores(alive[q], queries[q])
            best = np.lexsort((self.ids[alive[q]], ~scores))[:k]  # ~ turns the order around and never overflows
            out.append((self.ids[alive[q][best]], scores[best]))
        return out


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): floor(256 x) of every component, of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    return good.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long")).alias("v"))


def top_k(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of integer vectors (vec_id, v); is_query picks the asking rows."""
    vectors = stored(vectors.withColumn("asks", F.coalesce(is_query, F.lit(False))))
    n = vectors.agg(F.count("*").alias("rows"), F.count_if("asks").alias("queries")).first()
    nq, nc = max(1, -(-n.queries // QUERIES)), max(1, -(-n.rows // CANDIDATES))
    # Equal rows may be very many, so a candidate's block follows from its place, not from its id.
    candidates = vectors.select("vec_id", "v", F.lit(False).alias("asks"), (F.monotonically_increasing_id() % nc).alias("c"))
    candidates = candidates.withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nq - 1).cast("long"))))
    asking = vectors.where("asks").dropDuplicates(["vec_id", "v"]).select("vec_id", "v", "asks", F.pmod(F.xxhash64("vec_id"), F.lit(nq).cast("long")).alias("q"))
    asking = asking.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nc - 1).cast("long"))))
    blocks = candidates.unionByName(asking).withColumn("dims", F.size("v"))

    def search(block: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.empty(0, np.int64), "v": np.empty(0, object), "vec_id": np.empty(0, np.int64), "score": np.empty(0, np.int64)})]
        there, asks = block[~block["asks"]], block[block["asks"]]
        if len(there) and len(asks):
            lists = SortedLists(there["vec_id"].to_numpy(), np.array(there["v"].tolist(), np.int64).reshape(len(there), -1))
            found = []
            for at in range(0, len(asks), TOGETHER):
                some = asks.iloc[at : at + TOGETHER]
                found += lists.top(some["vec_id"].to_numpy(), np.array(some["v"].tolist(), np.int64).reshape(len(some), -1), k)
            for query_id, v, (ids, scores) in zip(asks["vec_id"].tolist(), asks["v"], found):
                out.append(pd.DataFrame({"query_id": query_id, "v": pd.Series([v] * len(ids), dtype=object), "vec_id": ids, "score": scores}))
        return pd.concat(out)

    best = blocks.groupBy("dims", "q", "c").applyInPandas(search, "query_id long, v array<long>, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id", "v").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(integer_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")), F.col("vec_id") % 50 == 0)
