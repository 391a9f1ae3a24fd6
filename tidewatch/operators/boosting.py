"""Boosted trees of several classes as one softmax ensemble, on histograms that Spark adds up.

Columns are cut at quantiles into bins, a missing value is a bin of its own.  In
each round every class gets a tree of the same depth; all trees of a round grow
level by level together.  For a level each task adds its rows' gradients and
curvatures by (class, node, column, bin), the sums meet in one aggregation, and
the driver, which sees these sums only, picks for every node the column, the
cut and the side of missing values with the largest gain.  Sums are of whole
numbers, so a fit doesn't depend on the order of rows or tasks.

A row's margins, the sums of the leaves that it has reached so far, are kept
with its bins every STEP rounds and carried on from there.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bins of a column besides the one of missing values; their cuts are approximate quantiles.
BINS = 64
#: Gradients and curvatures are counted in this part of 1.
UNIT = 1 << 20
#: Rounds after which margins are kept anew.
STEP = 10
#: A task has this many rows at least; a level's job on fewer costs more to start than to run.
TASK_ROWS = 20_000


@dataclass
class Trees:
    """Trees of equal depth in level order: column, highest bin of the left side, whether missing values go left, and leaf values.

    A node that isn't split sends all rows left.
    """

    depth: int
    column: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """(trees, rows): the leaf that each row reaches in each tree."""
        node = np.zeros((len(self.column), len(bins)), np.int64)
        tree, row = np.arange(len(self.column))[:, None], np.arange(len(bins))[None, :]
        for _ in range(self.depth):
            seen = bins[row, self.column[tree, node]]
            left = np.where(seen == 0, self.missing_left[tree, node], seen <= self.cut[tree, node])
            node = 2 * node + 2 - left
        return node - (2**self.depth - 1)

    def margins(self, bins: np.ndarray, n_classes: int) -> np.ndarray:
        """(rows, classes): sums of the reached leaves; tree i belongs to class i modulo their number."""
        reached = np.take_along_axis(self.value, self.leaves(bins), axis=1)
        return reached.reshape(-1, n_classes, len(bins)).sum(axis=0).T


def _stumpless(n: int, depth: int) -> Trees:
    inner = 2**depth - 1
    return Trees(depth, np.zeros((n, inner), np.int64), np.full((n, inner), 1 << 30), np.ones((n, inner), bool), np.zeros((n, 2**depth)))


def _joined(parts: list[Trees]) -> Trees:
    return Trees(parts[0].depth, *(np.concatenate([getattr(p, c) for p in parts]) for c in ("column", "cut", "missing_left", "value")))


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def binned(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """(rows, columns): 0 for a missing value, else 1 and how many cuts lie below it."""
    out = np.empty(values.shape, np.uint8)
    for i, cuts in enumerate(edges):
        out[:, i] = np.where(np.isnan(values[:, i]), 0, 1 + np.searchsorted(cuts, values[:, i], "left"))
    return out


def best_splits(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[np.ndarray, ...]:
    """(gain, column, cut, missing_left) of each node from sums (nodes, columns, bins), bin 0 the missing ones.

    Gain is the drop of the loss's second-order bound; a side needs curvature of at least ``least``.
    Of equal gains the first column, then missing values right, then the lowest cut counts.
    """
    g_all, h_all = g[:, :1].sum(axis=2, keepdims=True), h[:, :1].sum(axis=2, keepdims=True)
    known = np.cumsum(g[:, :, 1:], axis=2), np.cumsum(h[:, :, 1:], axis=2)
    # (nodes, columns, missing left, cuts)
    left_g, left_h = (np.stack([k, k + x[:, :, :1]], axis=2) for k, x in zip(known, (g, h)))
    right_g, right_h = g_all[..., None] - left_g, h_all[..., None] - left_h
    score = lambda a, b: a * a / (b + ridge)
    gain = score(left_g, left_h) + score(right_g, right_h) - score(g_all, h_all)[..., None]
    gain = np.where((left_h >= least) & (right_h >= least), gain, -np.inf)
    flat = gain.reshape(len(g), -1)
    at = flat.argmax(axis=1)
    column, side, cut = np.unravel_index(at, gain.shape[1:])
    return flat[np.arange(len(g)), at], column, cut + 1, side == 1


@dataclass
class SoftmaxBoost:
    """A fitted ensemble.  ``transform`` adds prediction (number of the likeliest class) and probability (an array)."""

    cols: tuple[str, ...]
    n_classes: int
    edges: list[np.ndarray]
    trees: Trees
    gains: np.ndarray
    params: dict = field(default_factory=dict)

    def probabilities(self, values: np.ndarray) -> np.ndarray:
        return softmax(self.trees.margins(binned(values, self.edges), self.n_classes)) if len(values) else np.zeros((0, self.n_classes))

    def transform(self, df: DataFrame) -> DataFrame:
        shipped = df.sparkSession.sparkContext.broadcast((self.edges, self.trees, self.n_classes))  # a few numbers a node

        @F.pandas_udf("array<double>")
        def probability(values: pd.DataFrame) -> pd.Series:
            edges, trees, n_classes = shipped.value
            x = values.to_numpy(np.float64, na_value=np.nan)
            return pd.Series(list(softmax(trees.margins(binned(x, edges), n_classes))))

        p = F.col("probability")
        out = df.withColumn("probability", probability(F.struct(*(F.col(c).cast("double").alias(c) for c in self.cols))))
        return out.withColumn("prediction", (F.array_position(p, F.array_max(p)) - 1).cast("double"))

    @property
    def featureImportances(self) -> dict[str, float]:
        """Share of each column in all gains."""
        return dict(zip(self.cols, (self.gains / max(self.gains.sum(), 1e-300)).tolist()))

    def save(self, spark: SparkSession, path: str) -> None:
        """One line of JSON."""
        t = self.trees
        text = json.dumps({
            "cols": self.cols, "n_classes": self.n_classes, "edges": [e.tolist() for e in self.edges], "gains": self.gains.tolist(), "params": self.params,
            "depth": t.depth, "column": t.column.tolist(), "cut": t.cut.tolist(), "missing_left": t.missing_left.tolist(), "value": t.value.tolist(),
        })
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SoftmaxBoost:
        d = json.loads(spark.read.text(path, wholetext=True).first().value)
        trees = Trees(d["depth"], np.array(d["column"]), np.array(d["cut"]), np.array(d["missing_left"]), np.array(d["value"]))
        return cls(tuple(d["cols"]), d["n_classes"], [np.array(e) for e in d["edges"]], trees, np.array(d["gains"]), d["params"])


def _known(c: str) -> Column:
    """A column as double, NaN as null."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x).alias(c)


def fit_softmax(train: DataFrame, cols: tuple[str, ...], n_classes: int = 3, rounds: int = 20, depth: int = 4, rate: float = 0.3, ridge: float = 1.0, least: float = 1.0, bins: int = BINS) -> SoftmaxBoost:
    """Learns from cols, label (0, 1, ...) and weight; rows without a label or weight take no part.

    The trees' order, and so the result, is that of rounds, each with one tree a class.
    """
    rows = train.where("label IS NOT NULL AND weight IS NOT NULL").select(*map(_known, cols), F.col("label").cast("int").alias("_label"), F.col("weight").cast("double").alias("_weight"))
    shares = [i / bins for i in range(1, bins)]
    found = rows.agg(F.count("*").alias("_n"), *(F.percentile_approx(c, shares, 100 * bins).alias(c) for c in cols)).first()
    edges = [np.unique(np.array(found[c] or [], np.float64)) for c in cols]
    n_bins = max(map(len, edges)) + 2
    context = train.sparkSession.sparkContext

    def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns[:-2]]).astype(np.float64)
            raw = binned(x, edges).tobytes()
            w = len(cols)
            start = np.zeros(n_classes).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([raw[i : i + w] for i in range(0, len(raw), w)], pa.binary()), pa.array([start] * len(x), pa.binary()), b.columns[-2], b.columns[-1]], ["bins", "margins", "label", "weight"])

    kept_as = "bins binary, margins binary, label int, weight double"
    table = rows.mapInArrow(prepared, kept_as).coalesce(max(1, -(-found["_n"] // TASK_ROWS))).persist()
    done: list[Trees] = []
    since: list[Trees] = []
    gains = np.zeros(len(cols))

    def unpacked(b: pa.RecordBatch, more: Trees | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        joined = lambda c, kind: np.frombuffer(b"".join(c.to_pylist()), kind).reshape(len(c), -1)
        bins, margins = joined(b.column(0), np.uint8), joined(b.column(1), np.float64)
        if more is not None:
            margins = margins + more.margins(bins, n_classes)
        return bins, margins, b.column(2).to_numpy(), b.column(3).to_numpy()

    def sums_of(growing: Trees, level: int) -> np.ndarray:
        """(classes, nodes of the level, columns, bins, 2): sums of gradients and curvatures."""
        shape = (n_classes, 2**level, len(cols), n_bins)
        shipped = context.broadcast((_joined(since) if since else None, growing))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            more, growing = shipped.value
            total = np.zeros((2, int(np.prod(shape))), np.int64)
            upto = Trees(level, growing.column, growing.cut, growing.missing_left, growing.value)
            for b in batches:
                if not b.num_rows:
                    continue
                bins, margins, label, weight = unpacked(b, more)
                p = softmax(margins)
                node = upto.leaves(bins)
                for k in range(n_classes):
                    g = np.rint(weight * (p[:, k] - (label == k)) * UNIT)
                    h = np.rint(weight * 2 * p[:, k] * (1 - p[:, k]) * UNIT)
                    cell = ((k * 2**level + node[k][:, None]) * len(cols) + np.arange(len(cols))) * n_bins + bins
                    for i, x in enumerate((g, h)):
                        total[i] += np.bincount(cell.ravel(), np.repeat(x, len(cols)), total.shape[1]).astype(np.int64)
            some = np.flatnonzero(total.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0, some]), pa.array(total[1, some])], ["cell", "g", "h"])

        sums = table.mapInArrow(add, "cell long, g long, h long").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
        shipped.destroy()
        out = np.zeros((int(np.prod(shape)), 2))
        out[sums["cell"].to_numpy()] = np.column_stack([sums["g"].to_numpy(), sums["h"].to_numpy()]) / UNIT
        return out.reshape(*shape, 2)

    try:
        for number in range(rounds):
            growing = _stumpless(n_classes, depth)
            for level in range(depth):
                sums = sums_of(growing, level)
                nodes = slice(2**level - 1, 2 ** (level + 1) - 1)
                for k in range(n_classes):
                    gain, column, cut, missing_left = best_splits(sums[k, ..., 0], sums[k, ..., 1], ridge, least)
                    split = gain > 1e-9
                    np.add.at(gains, column[split], gain[split])
                    growing.column[k, nodes] = np.where(split, column, 0)
                    growing.cut[k, nodes] = np.where(split, cut, 1 << 30)
                    growing.missing_left[k, nodes] = np.where(split, missing_left, True)
                    if level == depth - 1:
                        growing.value[k] = rate * _leaf_values(sums[k], growing, k, nodes, ridge)
            done.append(growing)
            since.append(growing)
            if len(since) == STEP and number + 1 < rounds:
                shipped = context.broadcast(_joined(since))

                def carried(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
                    for b in batches:
                        if b.num_rows:
                            _, margins, _, _ = unpacked(b, shipped.value)
                            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.tobytes() for m in margins], pa.binary()), b.column(2), b.column(3)], ["bins", "margins", "label", "weight"])

                before, table, since = table, table.mapInArrow(carried, kept_as).persist(), []
                table.count()
                before.unpersist()
    finally:
        table.unpersist()
    params = {"rounds": rounds, "depth": depth, "rate": rate, "ridge": ridge, "least": least}
    return SoftmaxBoost(tuple(cols), n_classes, edges, _joined(done) if done else _stumpless(n_classes, depth), gains, params)


def _leaf_values(sums: np.ndarray, growing: Trees, k: int, nodes: slice, ridge: float) -> np.ndarray:
    """Values of the leaves below the last level's nodes, from that level's sums: no further pass over the rows."""
    out = np.zeros(2 * len(sums))
    for i, (column, cut, missing_left) in enumerate(zip(growing.column[k, nodes], growing.cut[k, nodes], growing.missing_left[k, nodes])):
        own = sums[i, column]
        bins = np.arange(len(own))
        left = np.where(bins == 0, missing_left, bins <= cut)
        for side, mask in enumerate((left, ~left)):
            g, h = own[mask].sum(axis=0)
            out[2 * i + side] = -g / (h + ridge)
    return out


def log_loss(scored: DataFrame, label: str = "label") -> DataFrame:
    """(n, log_loss): mean of -ln of the probability of the class that came, from label and the array probability."""
    p = F.greatest(F.get("probability", F.col(label).cast("int")), F.lit(1e-15))
    return scored.where(F.col(label).isNotNull()).agg(F.count("*").alias("n"), F.avg(-F.log(p)).alias("log_loss"))
