"""Operator 10: near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors with cosine >= t lie within squared distance 2 - 2t.  A fixed
rotation spreads their energy, the rotated vectors are split into blocks, and
each block gets its share of that squared distance, in proportion to its
dimensions: in at least one block a pair stays within the block's share.  Each
block is range-joined on a grid over its first dimensions, among vectors of one
label; the union of what the blocks find is verified by the cosine in double
precision.

Equal vectors of a label are one class.  A vector is at home in one cell of each
block and visits those of the cells within reach that come after its own, so two
partners meet once in a block, where one of them is at home, and both count the
link there, in the first block that finds it: no list of pairs is written.  A cell with many vectors is dealt out in pieces of bounded
size.  What leaves a task is a count for each vector and a spanning forest of
the links, from which the components follow.

Defined results: vectors that are null, zero, hold null or non-finite
components, or have a null label link with nothing; vectors of different
lengths don't link; equal rows count as different vectors; a null vec_id never
becomes a component's id unless all of the component's are null; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_facts, stored, table
from .components import connected_components, local_roots

COSINE = 0.98
#: Blocks of a vector and gridded dimensions of a block.
BLOCKS, GRID = 8, 2
#: Vectors at home, and vectors altogether, of one piece of a cell.
HOME, ALL = 1024, 4096
_SLACK = 1e-9
_CELL = ["label", "dims", "block", "c0", "c1"]


_rotations: dict[int, np.ndarray] = {}


def rotation(dims: int) -> np.ndarray:
    """A fixed orthogonal matrix, made once for each number of dimensions."""
    if dims not in _rotations:
        q, r = np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))
        _rotations[dims] = q * np.sign(np.diag(r))
    return _rotations[dims]


def unit_and_rotated(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and their rotations, by sums in a fixed order: a row's result never depends on the other rows.

    A power of two takes the largest component near 1 first, so no square leaves the range of doubles.
    """
    vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, initial=0))[1][:, None])
    total = np.zeros(len(vectors))
    for k in range(vectors.shape[1]):
        total += vectors[:, k] ** 2
    unit = vectors / np.sqrt(total)[:, None]
    turned = np.zeros_like(unit)
    for k, row in enumerate(rotation(vectors.shape[1])):
        turned += unit[:, k, None] * row
    return unit, turned


def blocks(dims: int) -> list[slice]:
    """The dimensions of each block, of sizes as equal as can be."""
    n = min(BLOCKS, dims)
    cuts = [dims * i // n for i in range(n + 1)]
    return [slice(a, b) for a, b in zip(cuts, cuts[1:])]


def budget(block: slice, dims: int, cosine: float) -> float:
    return max(0.0, 2 - 2 * cosine) * (block.stop - block.start) / dims + _SLACK


def _cells(vectors: np.ndarray, cosine: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(block, which vectors, their cells, at home or visiting)."""
    dims = vectors.shape[1]
    _, turned = unit_and_rotated(vectors)
    for no, block in enumerate(blocks(dims)):
        reach = np.sqrt(budget(block, dims, cosine)) + _SLACK
        y = np.zeros((len(vectors), GRID))
        n = min(GRID, block.stop - block.start)
        y[:, :n] = turned[:, block][:, :n]
        low, own, high = (np.floor((y + d) / (2 * reach)).astype(np.int64) for d in (-reach, 0.0, reach))
        for code in range(3**GRID // 2, 3**GRID):  # the own cell, then those that come after it: of two cells one is visited
            picks = [code // 3**k % 3 for k in range(GRID)]
            cell = np.stack([(low, own, high)[p][:, k] for k, p in enumerate(picks)], axis=1)
            # A neighbour is visited only if it is another cell than the own one, in each dimension that moves.
            moves = np.ones(len(vectors), bool)
            for k, p in enumerate(picks):
                if p != 1:
                    moves &= cell[:, k] != own[:, k]
            which = np.flatnonzero(moves)
            yield no, which, cell[which], np.full(len(which), all(p == 1 for p in picks))


def _by_shape(rows: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows with vectors of one length, and those vectors in double precision."""
    for _, part in rows.groupby(rows["embedding"].map(len)):
        yield part.reset_index(drop=True), np.array(part["embedding"].tolist(), float)


def cell_counts(classes: DataFrame, cosine: float) -> DataFrame:
    """For each cell: how many vectors are at home, and how many there are."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for part, vectors in _by_shape(rows):
                out = []
                for no, which, cell, home in _cells(vectors, cosine):
                    out.append(pd.DataFrame({"label": part["label"].to_numpy()[which], "dims": vectors.shape[1], "block": no, "c0": cell[:, 0], "c1": cell[:, 1], "homes": home.astype(np.int64), "there": 1}))
                yield pd.concat(out).groupby(_CELL, as_index=False).sum()

    found = classes.select("label", "embedding").mapInPandas(count, "label int, dims int, block int, c0 long, c1 long, homes long, there long")
    return found.groupBy(*_CELL).agg(F.sum("homes").alias("homes"), F.sum("there").alias("there"))


def _placed(classes: DataFrame, cosine: float) -> DataFrame:
    """A row for each class and cell: home or visit.  Vectors keep the width of their numbers."""
    kind = classes.schema["embedding"].dataType.simpleString()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for part, vectors in _by_shape(rows):
                for no, which, cell, home in _cells(vectors, cosine):
                    yield part.iloc[which].assign(dims=vectors.shape[1], block=no, c0=cell[:, 0], c1=cell[:, 1], home=home)

    return classes.select("cls", "n", "label", "embedding").mapInPandas(place, f"cls long, n long, label int, embedding {kind}, dims int, block int, c0 long, c1 long, home boolean")


def links(classes: DataFrame, cosine: float) -> DataFrame:
    """(cls, links, root) rows: links to add to the class's, and an edge of a spanning forest of the links."""
    counts = cell_counts(classes, cosine).where("homes > 0")
    placed = _placed(classes, cosine).join(counts, _CELL)
    kh, kp = F.ceil(F.col("homes") / HOME), F.ceil(F.col("there") / ALL)
    hi, pj = F.pmod(F.xxhash64("cls"), kh), F.pmod(F.xxhash64(F.col("cls") + 1), kp)
    as_home = F.transform(F.sequence(F.lit(0).cast("long"), kp - 1), lambda j: F.struct(hi.alias("i"), j.alias("j"), F.lit(True).alias("at_home"), (j == pj).alias("partner")))
    as_guest = F.transform(F.sequence(F.lit(0).cast("long"), kh - 1), lambda i: F.struct(i.alias("i"), pj.alias("j"), F.lit(False).alias("at_home"), F.lit(True).alias("partner")))
    pieces = F.when(F.col("home"), F.concat(as_home, F.filter(as_guest, lambda x: x["i"] != hi))).otherwise(as_guest)
    dealt = placed.select("cls", "n", "embedding", "home", *_CELL, F.explode(pieces).alias("p")).select("cls", "n", "embedding", "home", *_CELL, "p.*")

    def join(group: pd.DataFrame) -> pd.DataFrame:
        return _range_join(group, cosine)

    return dealt.groupBy(*_CELL, "i", "j").applyInPandas(join, "cls long, links long, root long")


def _range_join(group: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Links between the vectors at home and all partners of a piece of a cell.

    Two vectors at home meet twice, each as the other's partner; a guest meets those at home once.
    """
    dims, no = int(group["dims"].iloc[0]), int(group["block"].iloc[0])
    unit, turned = unit_and_rotated(np.array(group["embedding"].tolist(), float))
    parts = blocks(dims)
    limits = [budget(p, dims, cosine) for p in parts]
    cls, n, guest = group["cls"].to_numpy(), group["n"].to_numpy(), ~group["home"].to_numpy(bool)
    homes, partners = np.flatnonzero(group["at_home"]), np.flatnonzero(group["partner"])
    own = turned[:, parts[no]]
    square = (own**2).sum(axis=1)
    counted, roots = np.zeros(len(group), np.int64), np.arange(len(group))
    step = max(1, 400_000 // max(1, len(partners)))
    for s in range(0, len(homes), step):
        h = homes[s : s + step]
        near = square[h, None] + square[partners] - 2 * own[h] @ own[partners].T <= limits[no] + 1e-7
        x, y = np.nonzero(near)
        x, y = h[x], partners[y]
        keep = x != y
        x, y = x[keep], y[keep]
        for k in range(no + 1):  # the first block within its share owns the pair
            gap = np.zeros(len(x))
            for d in range(parts[k].start, parts[k].stop):
                gap += (turned[x, d] - turned[y, d]) ** 2
            keep = gap <= limits[k] if k == no else gap > limits[k]
            x, y = x[keep], y[keep]
        cos = np.zeros(len(x))
        for d in range(dims):
            cos += unit[x, d] * unit[y, d]
        keep = cos >= cosine
        x, y = x[keep], y[keep]
        np.add.at(counted, x, n[y])
        np.add.at(counted, y[guest[y]], n[x[guest[y]]])
        roots = local_roots(len(group), x, y, roots)
    out = np.flatnonzero((counted > 0) | (roots != np.arange(len(group))))
    return pd.DataFrame({"cls": cls[out], "links": counted[out], "root": cls[roots[out]]})


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding, label)."""
    double = vectors.schema["embedding"].dataType.simpleString() == "array<double>"
    rows = vectors.select("vec_id", F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>" if double else "array<float>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("usable", usable)
    classes = rows.where("usable").groupBy("label", "embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"))
    classes = stored(classes.withColumn("cls", F.monotonically_increasing_id()))
    found = stored(links(classes, cosine))
    member = connected_components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    counted = found.groupBy("cls").agg(F.sum("links").alias("links"))
    named = classes.select("cls", "n", "first_id").join(counted, "cls", "left").join(member.withColumnRenamed("node", "cls"), "cls", "left")
    named = stored(named.select("cls", "first_id", F.coalesce("component", "cls").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    ids = named.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n"))
    named = join_facts(named, ids, ["component"]).select("cls", "n_links", "component_id")
    named = classes.select("cls", "label", "embedding", "n").join(named, "cls").drop("cls")
    linked = join_facts(rows.where("usable"), named, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
