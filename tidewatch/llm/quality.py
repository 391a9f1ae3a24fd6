"""Operator 8: quality by the perplexity of an interpolated modified Kneser-Ney model of trusted text.

The model is over characters.  All trusted texts are counted; the counts of the
orders are derived and joined shard by shard in Spark (each join is dealt by
n-gram or context), and give the log probability of every n-gram that any
document holds.  A document's n-grams meet that table in two ways.  The most
frequent n-grams of all documents, a bounded number, come to the texts by
broadcast and are summed in the pass that reads them.  Every other n-gram is
rare, and goes as a row (document, n-gram, count) to a join by n-gram, whose
products are summed by document.  So neither a task nor the driver holds more
than that bounded table, and no n-gram that is joined is frequent.  A document is
kept if its perplexity is at most its language's quantile among the trusted texts.

Defined results: a null text counts as empty; an empty text is the end mark
alone; equal rows stay as many rows; a null language is a language of its own; a
language without trusted texts takes the quantile of all trusted texts, and
without any trusted text every document is kept and its perplexity is that of
equally likely characters.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .toxicity import held_out

ORDER = 4
#: Share of the trusted texts of a language that its threshold keeps.
QUANTILE = 0.995
#: N-grams that are broadcast: the most frequent.
FREQUENT = 1_000_000
#: Characters that a task counts together.
PART = 4_000_000
_START, _END = "\x02", "\x03"


def _marked(text: str | None) -> str:
    return _START * (ORDER - 1) + (text or "") + _END


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all texts on end, marked, and where each text begins (with the end)."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return chars, np.cumsum([0, *map(len, texts)])


def _parts(batches: Iterator[pd.Series]) -> Iterator[list[str]]:
    part, size = [], 0
    for texts in batches:
        for t in texts:
            part.append(_marked(t))
            size += len(part[-1])
            if size >= PART:
                yield part
                part, size = [], 0
    if part:
        yield part


def _spelled(letters: np.ndarray) -> list[str]:
    """N-grams as strings from rows of code points."""
    flat = letters.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [flat[i : i + ORDER] for i in range(0, len(flat), ORDER)]


def _windows(numbers: np.ndarray, base: int) -> np.ndarray:
    """A number for the n-gram that begins at each place, different for different n-grams; numbers lie below base.

    Where four of them might not fit into 64 bits, what has been joined so far is numbered anew.
    """
    n = len(numbers) - ORDER + 1
    keys, width = numbers[:n].astype(np.int64), base
    for k in range(1, ORDER):
        if width * base >= 2**63:
            found, keys = np.unique(keys, return_inverse=True)
            keys, width = keys.astype(np.int64), len(found)
        keys = keys * base + numbers[k : k + n]
        width *= base
    return keys


def _inside(at: np.ndarray, n: int) -> np.ndarray:
    """Places whose n-gram lies within one text."""
    inside = np.ones(n, bool)
    for back in range(1, ORDER):
        inside[at[1:-1] - back] = False
    return inside


def ngram_counts(texts: DataFrame) -> DataFrame:
    """(g, c): the n-grams of all texts (column text) and how often they stand there, counted in parts first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _parts(b["text"] for b in batches):
            chars, at = _codes(part)
            alphabet, numbers = np.unique(chars, return_inverse=True)
            keys = _windows(numbers, len(alphabet))
            places = np.flatnonzero(_inside(at, len(keys)))
            if len(alphabet) ** ORDER < 2**63:  # the letters follow from the number
                found, counts = np.unique(keys[places], return_counts=True)
                letters = np.stack([alphabet[found // len(alphabet) ** (ORDER - 1 - k) % len(alphabet)] for k in range(ORDER)], axis=1)
            else:
                _, first, counts = np.unique(keys[places], return_index=True, return_counts=True)
                letters = chars[places[first][:, None] + np.arange(ORDER)]
            yield pd.DataFrame({"g": _spelled(letters), "c": counts})

    return texts.select("text").mapInPandas(count, "g string, c long").groupBy("g").agg(F.sum("c").alias("c"))


def _context(g: str = "g") -> Column:
    return F.expr(f"left({g}, length({g}) - 1)")


def _shorter(g: str = "g") -> Column:
    return F.expr(f"substring({g}, 2)")


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of one, two, and three or more."""
    n = counts.agg(*(F.count_if(F.col("c") == k).alias(f"n{k}") for k in range(1, 5))).first()
    y = n.n1 / (n.n1 + 2 * n.n2) if n.n1 else 0.0
    raw = [k - (k + 1) * y * n[f"n{k + 1}"] / n[f"n{k}"] if n[f"n{k}"] else k / 2 for k in (1, 2, 3)]
    return tuple(min(max(d, 0.05), k) for k, d in zip((1, 2, 3), raw))


def log_probabilities(trusted: DataFrame, asked: DataFrame, alphabet: int) -> DataFrame:
    """(g, logp) for every asked n-gram (column g), from the counts (g, c) of trusted text."""
    orders = {ORDER: trusted}
    for k in range(ORDER - 1, 0, -1):  # lower orders count in how many different n-grams they are continued from
        orders[k] = stored(orders[k + 1].select(_shorter().alias("g")).groupBy("g").agg(F.count("*").alias("c")))
    asked_of = {ORDER: asked.select("g")}
    for k in range(ORDER - 1, 0, -1):
        asked_of[k] = asked_of[k + 1].select(_shorter().alias("g")).distinct()
    lower = None
    for k in range(1, ORDER + 1):
        d = discounts(orders[k])
        cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        contexts = orders[k].groupBy(_context().alias("ctx")).agg(F.sum("c").alias("total"), F.sum(cut).alias("freed"))
        rows = asked_of[k].withColumn("ctx", _context()).withColumn("rest", _shorter())
        rows = rows.join(orders[k], "g", "left").join(contexts, "ctx", "left")
        rows = rows.join(lower.withColumnRenamed("g", "rest"), "rest") if lower is not None else rows.withColumn("low", F.lit(1.0 / alphabet))
        own = F.coalesce((F.col("c") - cut) / F.col("total"), F.lit(0.0))
        p = own + F.coalesce(F.col("freed") / F.col("total"), F.lit(1.0)) * F.col("low")
        lower = stored(rows.select("g", p.alias("low")))
    return lower.select("g", F.log("low").alias("logp"))


_SCORED = "row long, doc_id long, lang string, total double, n long, g string, c long"


def frequent_table(table: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(alphabet, keys, log probabilities) of at most ``most`` n-grams, the most frequent of a table (g, logp, c), by key.

    A key must fit into 64 bits, so n-grams with letters beyond the 50,000 most frequent stay out.
    """
    top = table.orderBy(F.desc("c"), "g").limit(most).select("g", "logp").toPandas()  # of bounded size
    letters = _codes(top["g"].tolist())[0].reshape(-1, ORDER)
    alphabet, counts = np.unique(letters, return_counts=True)
    alphabet = np.sort(alphabet[np.argsort(-counts, kind="stable")[:50_000]])
    fits = np.isin(letters, alphabet).all(axis=1) if len(letters) else np.zeros(0, bool)
    numbers = np.searchsorted(alphabet, letters[fits])
    keys = np.zeros(len(numbers), np.int64)
    for k in range(ORDER):
        keys = keys * (len(alphabet) + 1) + numbers[:, k]
    order = np.argsort(keys)
    return alphabet, keys[order], top["logp"].to_numpy(float)[fits][order]


def _scored(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """Of every row of docs (row, doc_id, lang, text): a row (total, n) of its frequent n-grams, and rows (g, c) of the others."""
    shipped = docs.sparkSession.sparkContext.broadcast(frequent)
    columns = [c.split()[0] for c in _SCORED.split(", ")]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        alphabet, keys, logps = shipped.value
        number = np.full(0x110000, len(alphabet), np.int32)
        number[alphabet] = np.arange(len(alphabet), dtype=np.int32)
        for rows in batches:
            begun = 0
            for part in _parts(iter([rows["text"]])):
                own = rows.iloc[begun : begun + len(part)]
                begun += len(part)
                chars, at = _codes(part)
                packed = _windows(number[chars], len(alphabet) + 1)
                inside = _inside(at, len(packed))
                place = np.minimum(np.searchsorted(keys, packed), len(keys) - 1)
                known = (keys[place] == packed) & inside if len(keys) else np.zeros(len(packed), bool)
                sums = np.concatenate(([0.0], np.where(known, logps[place], 0.0))) if len(keys) else np.zeros(len(packed) + 1)
                ends = np.minimum(at[1:] - ORDER + 1, len(packed))
                totals = np.array([sums[a + 1 : b + 1].sum() for a, b in zip(at.tolist(), ends.tolist())])
                yield pd.DataFrame({**{c: own[c] for c in ("row", "doc_id", "lang")}, "total": totals, "n": ends - at[:-1]}).reindex(columns=columns).astype({"doc_id": "Int64", "c": "Int64", "lang": object, "g": object})
                rest = np.flatnonzero(~known & inside)
                if len(rest):
                    frame = pd.DataFrame({"row": own["row"].to_numpy()[np.searchsorted(at, rest, "right") - 1], "g": _spelled(chars[rest[:, None] + np.arange(ORDER)])})
                    counted = frame.groupby(["row", "g"], as_index=False).size().rename(columns={"size": "c"})
                    yield counted.reindex(columns=columns).astype({"doc_id": "Int64", "n": "Int64", "lang": object, "g": object})

    return docs.select("row", "doc_id", "lang", "text").mapInPandas(score, _SCORED)


def perplexities(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(doc_id, lang, trusted, perplexity) for every row of docs (doc_id, lang, text); trusted names ids (doc_id)."""
    ids = trusted.where("doc_id IS NOT NULL").select("doc_id").distinct()
    # The ids grow with the corpus, so they are never broadcast.
    known = stored(ngram_counts(docs.join(ids.hint("merge"), "doc_id", "left_semi")))
    asked = stored(ngram_counts(docs))
    alphabet = asked.select(F.substring("g", ORDER, 1).alias("w")).distinct().count() + 1
    finished = stored(log_probabilities(known, asked, alphabet).join(asked, "g"))
    # Written at once, so a row's number is the same in both kinds of rows.
    found = stored(_scored(docs.withColumn("row", F.monotonically_increasing_id()), frequent_table(finished, FREQUENT)))
    rare = found.where("g IS NOT NULL").select("row", "g", F.col("c").alias("times"))
    rare = rare.join(finished.select("g", "logp").hint("merge"), "g").groupBy("row").agg(F.sum(F.col("times") * F.col("logp")).alias("more"))
    rows = found.where("g IS NULL").select("row", "doc_id", "lang", "total", "n").join(rare.hint("merge"), "row", "left")
    rows = rows.withColumn("perplexity", F.exp(-(F.col("total") + F.coalesce("more", F.lit(0.0))) / F.col("n")))
    marked = ids.withColumn("trusted", F.lit(True)).hint("merge")
    return rows.join(marked, "doc_id", "left").select("doc_id", "lang", F.coalesce("trusted", F.lit(False)).alias("trusted"), "perplexity")


def classify(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, lang, trusted, perplexity, threshold, kept); trusted marks texts that the model counted.

    A fifth of the trusted texts is not counted and sets the thresholds, so that
    they are those of texts which the model hasn't seen.
    """
    unseen = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    scored = perplexities(docs, trusted.where(~unseen))
    measure = trusted.where(unseen).select("doc_id").distinct().withColumn("measures", F.lit(True))
    scored = stored(scored.join(measure.hint("merge"), "doc_id", "left"))

    def level(by: str) -> Column:
        return F.percentile_approx(F.when(F.col(by), F.col("perplexity")), quantile, 10_000)

    at = scored.groupBy("lang").agg(level("measures").alias("own")).withColumnRenamed("lang", "own_lang")
    overall = scored.agg(F.coalesce(level("measures"), level("trusted")).alias("overall"))
    rows = scored.join(at, F.col("lang").eqNullSafe(F.col("own_lang")), "left").crossJoin(F.broadcast(overall))
    threshold = F.coalesce("own", "overall", F.lit(math.inf))
    return rows.select("doc_id", "lang", "trusted", "perplexity", threshold.alias("threshold"), (F.col("perplexity") <= threshold).alias("kept"))


def trusted_labels(labels: DataFrame) -> DataFrame:
    """Ids of texts labelled good, but for the fifth that is held out."""
    return labels.where("quality = 1").where(~held_out()).select("doc_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return classify(docs, trusted_labels(table(spark, sf_dir, "labels")))
