"""Operator 7: toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

The features are the character n-grams that a text holds (present or not), by
hash in one of BINS bins.  From labelled texts, each bin gets the log ratio of
its smoothed shares in toxic and in other texts.  Every bin whose shares differ
beyond chance (a G-test at the level of EVIDENCE, however many bins that are) is
a feature, scaled by its ratio, and a logistic regression of Spark ML weighs them.

The labelled sample is bounded by SAMPLE (the least hashes of the ids); only its
ids, at most that many, are broadcast.  Scoring is one pass without a shuffle.

Defined results: a null text counts as empty; an empty text gets the score of no
n-grams; equal rows stay as many rows; other columns are not read.  A document
that several label rows name is toxic if one says so.  If no bin tells the kinds
apart, every score is the share of toxic labels.  Without labelled rows of
both kinds every score is the share of toxic ones, 0 if there are none.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: Lengths of the n-grams and the number of hashed features.
ORDERS = (3, 5, 6)
BINS = 2**20
#: At most so many labelled documents are learned from.
SAMPLE = 12_000
#: Tasks that count the sample's n-grams.
COUNTERS = 8
#: The G statistic from which on a bin tells the kinds apart: chance alone reaches it once in a thousand times.
EVIDENCE = 10.83
#: Added to each count of documents.
SMOOTHING = 1.0
REGULARIZATION = 1e-4
ITERATIONS = 60

_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F), np.uint32(0x165667B1), np.uint32(0xD3A2646D))


def ngrams(text: str | None) -> np.ndarray:
    """The bins of all n-grams of a text in lower case, with a space before and after; repeats stay."""
    chars = np.frombuffer(f" {text or ''} ".lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    parts = []
    rolled = np.zeros(len(chars), np.uint32)
    for k in range(max(ORDERS)):
        if len(chars) <= k:
            break
        n = len(chars) - k
        rolled = (rolled[:n] ^ (chars[k:] * _MIX[k])) * np.uint32(0x01000193)
        if k + 1 in ORDERS:
            parts.append((rolled ^ (rolled >> np.uint32(15))) & np.uint32(BINS - 1))
    return np.concatenate(parts) if parts else np.empty(0, np.uint32)


def bin_counts(labelled: DataFrame) -> DataFrame:
    """(bin, toxic, clean): in how many toxic and other texts (text, label) a bin's n-grams stand."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, BINS), np.int32)
        for rows in batches:
            for text, label in zip(rows["text"], rows["label"]):
                sums[int(label), distinct(ngrams(text))] += 1
        found = np.flatnonzero(sums.any(axis=0))
        yield pd.DataFrame({"bin": found, "toxic": sums[1, found], "clean": sums[0, found]})

    # The sample is bounded, so a few tasks do; each yields at most BINS rows.
    return labelled.coalesce(COUNTERS).mapInPandas(count, "bin long, toxic long, clean long").groupBy("bin").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def log_count_ratios(counts: DataFrame, n_toxic: int, n_clean: int, evidence: float = EVIDENCE) -> DataFrame:
    """(bin, ratio) of all bins whose shares differ beyond chance (G-test against equal shares)."""
    p, q = F.col("toxic") + SMOOTHING, F.col("clean") + SMOOTHING
    ratio = F.log(p / (n_toxic + 2 * SMOOTHING)) - F.log(q / (n_clean + 2 * SMOOTHING))

    def term(seen: Column, of: int, rate: Column) -> Column:
        absent = F.greatest(of - seen, F.lit(1e-9))
        return F.when(seen > 0, seen * F.log(seen / (of * rate))).otherwise(0.0) + absent * F.log(absent / F.greatest(of * (1 - rate), F.lit(1e-9)))

    rate = (F.col("toxic") + F.col("clean")) / (n_toxic + n_clean)
    gain = term(F.col("toxic"), n_toxic, rate) + term(F.col("clean"), n_clean, rate)
    return counts.select("bin", ratio.alias("ratio"), (2 * gain).alias("g")).where(F.col("g") >= evidence).select("bin", "ratio")


class Classifier:
    """A weight for each bin (ratio times coefficient, 0 for bins that are no feature) and the intercept."""

    def __init__(self, weights: np.ndarray, intercept: float) -> None:
        self.weights, self.intercept = weights, intercept

    def score(self, text: Column) -> Column:
        """double, 0 to 1: higher means likelier toxic."""
        shipped, intercept = SparkSession.active().sparkContext.broadcast(self.weights), self.intercept

        @F.pandas_udf("double")
        def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            weights = shipped.value
            for texts in batches:
                sums = []
                for t in texts:
                    found = ngrams(t)
                    sums.append(intercept + weights[distinct(found[weights[found] != 0])].sum())
                with np.errstate(over="ignore"):
                    yield pd.Series(1 / (1 + np.exp(-np.array(sums, float))))

        return scores(text)


def distinct(bins: np.ndarray) -> np.ndarray:
    """The bins, each once, in their order."""
    found = np.sort(bins)
    return found[np.append(True, found[1:] != found[:-1])] if len(found) else found


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Learns from the documents (doc_id, text) that the labels (doc_id, label 0 or 1) name."""
    chosen = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded, so it may be broadcast
    learn = stored(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", F.col("label").cast("int").alias("label")))
    n = {r.label: r.n for r in learn.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        share = float(n.get(1, 0) > 0)
        return Classifier(np.zeros(BINS), math.inf if share else -math.inf)
    found = log_count_ratios(bin_counts(learn), n[1], n[0]).orderBy("bin").toPandas()  # at most BINS rows
    weights, bins, ratios = np.zeros(BINS), found["bin"].to_numpy(int), found["ratio"].to_numpy(float)
    if not len(bins):
        return Classifier(weights, math.log(n[1] / n[0]))
    number = np.full(BINS, -1, np.int32)
    number[bins] = np.arange(len(bins), dtype=np.int32)
    shipped = docs.sparkSession.sparkContext.broadcast(number)

    @F.pandas_udf("array<int>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            places = (shipped.value[ngrams(t)] for t in texts)
            yield pd.Series([distinct(p[p >= 0]) for p in places], dtype=object)

    # Present features as a sparse vector, scaled by their ratios.
    held = stored(learn.select(F.col("label").cast("double").alias("label"), features("text").cast("array<string>").alias("held")))
    present = CountVectorizerModel.from_vocabulary([str(k) for k in range(len(bins))], inputCol="held", outputCol="present", binary=True)
    scaled = ElementwiseProduct(scalingVec=Vectors.dense(ratios), inputCol="present", outputCol="features")
    fit = LogisticRegression(regParam=REGULARIZATION, maxIter=ITERATIONS, standardization=False).fit(scaled.transform(present.transform(held)).select("label", "features"))
    weights[bins] = ratios * fit.coefficients.toArray()
    return Classifier(weights, float(fit.intercept))


def held_out() -> Column:
    """The fifth of the ids that is never learned from; a null id, which no label can name, is not in it."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def learning_labels(labels: DataFrame) -> DataFrame:
    return labels.where(~held_out()).select("doc_id", F.col("toxic").alias("label"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = train(docs, learning_labels(table(spark, sf_dir, "labels")))
    scored = docs.select("doc_id", held_out().alias("held_out"), found.score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
