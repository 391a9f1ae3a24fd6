"""Operator 13: importance resampling towards a target distribution, by bit-sliced aggregation.

Features are runs of words, hashed to buckets.  One pass adds up the buckets of
all documents and of all target texts; their smoothed log ratio, in thousandths
and rounded down, is a bucket's gain.  The gains become signed bit planes: for
each binary digit the set of buckets that have it, the highest digit counting
negative.  In a second pass each document's bucket counts become such planes
too, and its weight is the sum, over a plane of the counts and a plane of the
gains, of the number of buckets in both times a power of two: exact integers,
with nothing shuffled and no row for a word.  A Gumbel number that follows from
the id is added, and the highest scores are drawn, which samples without
replacement in proportion to exp(weight / 1000).

Ranks come from one range sort: slices of the order are counted, and a row's
rank is its place in its slice after all slices before it.  Rows with equal
scores and ids may lie in different slices, so no group gathers.

Defined results: a null text has no features and weight 0; a null id is drawn
with the hash of an empty one and stands behind equal scores of others; equal
rows are drawn one by one; without documents or target texts all counts are 0;
other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, stored, table
from .wordbytes import crc32, owners, parts, runs

BUCKETS = 10_000
#: The shortest and the longest run of words that is a feature.
WORDS = (1, 1)
#: Documents with fewer words are never drawn; of the others this share is.
LEAST_WORDS, PERCENT = 20, 10
SEED = 2024

#: Words whose features are hashed together, and documents whose planes lie in memory together.
STEP, ROWS = 500_000, 256


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Whether a byte belongs to a word, and its lower case."""
    word = np.zeros(256, bool)
    word[0x30:0x3A] = word[0x61:0x7B] = word[0x80:] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[0x41:0x5B] += 32
    return word, lower


def features(flat: np.ndarray, at: np.ndarray, words: tuple[int, int], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of all features of the texts, some words at a time."""
    word, lower = _tables()
    flat = lower[flat]
    starts, ends = runs(word[flat], at)
    own = owners(starts, at)
    space = np.full(1, 0x20, np.uint8)
    for i in range(0, len(starts), STEP):
        begin = np.arange(i, min(i + STEP, len(starts)))
        state = np.zeros(len(begin), np.uint32)
        for n in range(words[1]):
            if n:
                begin = begin[begin + n < len(starts)]
                begin = begin[own[begin] == own[begin + n]]
                state = crc32(space, np.zeros(len(begin), np.int64), np.ones(len(begin), np.int64), state[begin - i])
            state = crc32(flat, starts[begin + n], ends[begin + n] - starts[begin + n], state)
            if n + 1 >= words[0]:
                yield own[begin], (state % buckets).astype(np.int64)
            whole = np.zeros(min(i + STEP, len(starts)) - i, np.uint32)
            whole[begin - i] = state
            state = whole


def bucket_totals(texts: DataFrame, words: tuple[int, int] = WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """The features of all texts (a column text) in each bucket; a task adds up its own before they meet."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, flat, at in parts(batch.column(0)):
                for _, found in features(flat, at, words, buckets):
                    total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    rows = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:  # one row for each bucket at most
        out[r.bucket] = r.n
    return out


def gains(here: np.ndarray, there: np.ndarray) -> np.ndarray:
    """The gain of each bucket from its counts in all documents and in all target texts."""
    n, s_all, t_all = len(here), float(here.sum()), float(there.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(here.tolist(), there.tolist())], np.int64)


def gain_planes(gain: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Bit planes of the gains, one row of 64-bit words for each digit, and what each digit counts; the last counts negative."""
    width = max(int(g).bit_length() for g in gain) + 1 if len(gain) else 1
    planes = np.stack([_packed(((gain >> j) & 1).astype(bool)[None, :])[0] for j in range(width)])
    return planes, [1 << j for j in range(width - 1)] + [-(1 << (width - 1))]


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    packed = np.packbits(bits, axis=1, bitorder="little")
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def weights(doc: np.ndarray, bucket: np.ndarray, n_docs: int, planes: np.ndarray, values: list[int], buckets: int) -> np.ndarray:
    """The weight of each of n_docs documents from its features (document, bucket)."""
    out = np.zeros(n_docs, np.int64)
    cell, times = np.unique(doc * buckets + bucket, return_counts=True)
    doc, bucket = cell // buckets, cell % buckets
    for digit in range(int(times.max()).bit_length() if len(times) else 0):
        has = (times >> digit) & 1 == 1
        rows, row = np.unique(doc[has], return_inverse=True)
        cut = np.searchsorted(row, np.arange(0, len(rows), ROWS))
        for first, i, j in zip(range(0, len(rows), ROWS), cut, [*cut[1:], len(row)]):
            some = rows[first : first + ROWS]
            bits = np.zeros((len(some), buckets), bool)
            bits[row[i:j] - first, bucket[has][i:j]] = True
            counted = _packed(bits)
            for plane, value in zip(planes, values):
                out[some] += (value << digit) * np.bitwise_count(counted & plane).sum(axis=1, dtype=np.int64)
    return out


def weighed(docs: DataFrame, gain: np.ndarray, words: tuple[int, int] = WORDS) -> DataFrame:
    """(doc_id, n_features, n_words, weight) of every document."""
    buckets = len(gain)
    shipped = docs.sparkSession.sparkContext.broadcast(gain_planes(gain))  # one bit a bucket and digit

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, values = shipped.value
        for batch in batches:
            counts = []
            for first, end, flat, at in parts(batch.column(1)):
                n, n_words, weight = (np.zeros(end - first, np.int64) for _ in range(3))
                for doc, found in features(flat, at, words, buckets):
                    n += np.bincount(doc, minlength=end - first)
                    weight += weights(doc, found, end - first, planes, values, buckets)
                starts, _ = runs(_tables()[0][_tables()[1][flat]], at)
                n_words += np.bincount(owners(starts, at), minlength=end - first)
                counts.append((n, n_words, weight))
            if counts:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.concatenate(c)) for c in zip(*counts))], ["doc_id", "n_features", "n_words", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(weigh, f"doc_id {kind}, n_features long, n_words long, weight long")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """long: thousandths of a Gumbel number that follows from the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, words: tuple[int, int] = WORDS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every document; target needs a column text.  Drawn are the rows with a rank."""
    gain = gains(bucket_totals(docs, words, buckets), bucket_totals(target, words, buckets))
    scored = weighed(docs, gain, words).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = stored(scored.withColumn("short", F.col("n_words") < least_words))
    n = scored.where("NOT short").count()
    order = [F.col("short"), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    ranked = numbered(scored, [], order, "rank")
    drawn = ~F.col("short") & (F.col("rank") <= percent * n // 100)
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("rank")).alias("rank"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
