"""Operator 3: URL filter, by rules and by gradient-boosted trees on lexical features.

A rule names a host and a path prefix; it fits that host and its subdomains, and
the longest fitting rule decides.  The URLs that a rule decides are the labelled
ones: the trees learn from a bounded sample of them and judge all others.
Features: length, depth, digit ratio, entropy, parameter counts and statistics
of suffixes and of the first folder.  A suffix's share of blocked URLs is taken
over the other folds of the sample, never over the row itself, and two of five
folds show none of a host's suffixes, so that the trees learn how to judge where
they are unknown; an unknown one has the share 0.5.  Both verdicts
weigh the same in the fit.  Everything is DataFrame functions and Spark ML.

Defined results: a null URL or one without ``://`` has an empty host and path,
no rule, and the verdict of the trees on its features (those of an empty text
for null); equal rows stay as many rows; the page's html is never read.  Without
labelled rows of both kinds there are no trees, and the verdict is the kind that
is there, or allow.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, stored, table

#: (host, path prefix, verdict): fixed values of the contract.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

#: At most so many different labelled URLs fit the trees: those with the least hashes.  Copies count once.
SAMPLE = 20_000
TREES, DEPTH, SEED = 15, 4, 11
#: Weight, in URLs, of the even share in a suffix's share of blocked URLs.
PRIOR_WEIGHT = 10.0
#: Parts of the sample: the statistics of a part come from the others.
FOLDS = 5

SUFFIXES = ("suffix1", "suffix2", "suffix3", "folder")
FEATURES = ("f_length", "f_host_length", "f_path_length", "f_depth", "f_labels", "f_digits", "f_entropy", "f_params", "f_hyphens", "f_tail", "f_fragment", *(f"f_{k}" for k in SUFFIXES))
_URL = ("url", "host", "path")


def host_of(url: Column) -> Column:
    return lower_ascii(_part(url, 1))


def path_of(url: Column) -> Column:
    return _part(url, 2)


def _part(url: Column, k: int) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))


def longest_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for own, prefix, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(prefix)
        rule = F.when(fits, own + prefix).otherwise(rule)
        verdict = F.when(fits, says).otherwise(verdict)
    return rule, verdict


def decided(urls: DataFrame, url_col: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """(row, url, host, path, rule, decided): each row as a struct, so that its columns may have any names."""
    rows = urls.select(F.struct("*").alias("row"), F.col(f"`{url_col}`").alias("url"))
    rows = rows.select("row", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    return rows.select("*", rule.alias("rule"), verdict.alias("decided"))


def _count(text: Column, what: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))).cast("double")


def lexical(urls: DataFrame) -> DataFrame:
    """Adds the features but those of suffixes, and the suffixes: suffix1 (last label), suffix2 (last two), suffix3 (last label and first folder), folder."""
    u = F.coalesce("url", F.lit(""))
    n = F.greatest(F.length(u), F.lit(1)).cast("double")
    chars = F.array_distinct(F.filter(F.split(u, ""), lambda c: c != ""))
    share = lambda c: (F.length(u) - F.length(F.replace(u, c, F.lit("")))) / n
    entropy = F.aggregate(chars, F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    tail = F.element_at(F.split("path", r"\."), -1)
    return urls.select(
        "*",
        n.alias("f_length"),
        F.length("host").cast("double").alias("f_host_length"),
        F.length("path").cast("double").alias("f_path_length"),
        F.size(F.filter(F.split("path", "/"), lambda p: p != "")).cast("double").alias("f_depth"),
        F.size(F.split("host", r"\.")).cast("double").alias("f_labels"),
        (F.length(F.regexp_replace(u, "[^0-9]", "")) / n).alias("f_digits"),
        entropy.alias("f_entropy"),
        F.when(query == "", 0.0).otherwise(_count(query, "&") + 1).alias("f_params"),
        _count(F.col("host"), "-").alias("f_hyphens"),
        F.when(F.col("path").contains("."), F.length(tail)).otherwise(0).cast("double").alias("f_tail"),
        u.contains("#").cast("double").alias("f_fragment"),
        F.substring_index("host", ".", -1).alias("suffix1"),
        F.substring_index("host", ".", -2).alias("suffix2"),
        F.concat_ws("/", F.substring_index("host", ".", -1), F.get(F.split("path", "/"), 1)).alias("suffix3"),
        F.coalesce(F.get(F.split("path", "/"), 1), F.lit("")).alias("folder"),
    )


def _share(blocked: Column, n: Column) -> Column:
    """A share of blocked URLs, drawn towards an even one."""
    return (F.coalesce(blocked, F.lit(0.0)) + PRIOR_WEIGHT / 2) / (F.coalesce(n, F.lit(0)) + PRIOR_WEIGHT)


def _rates(sample: DataFrame, kind: str, *by: str) -> DataFrame:
    return sample.groupBy(kind, *by).agg(F.sum("weight").alias("_n"), F.sum(F.col("label") * F.col("weight")).alias("_blocked"))


def with_statistics(urls: DataFrame, sample: DataFrame) -> DataFrame:
    """Adds each suffix's share of blocked URLs.  The tables have at most SAMPLE rows, so they may be broadcast."""
    for k in SUFFIXES:
        urls = urls.join(F.broadcast(_rates(sample, k)), k, "left").withColumn(f"f_{k}", _share(F.col("_blocked"), F.col("_n"))).drop("_n", "_blocked")
    return urls


def shows_suffixes(suffix1: Column, fold: Column) -> Column:
    """Two of the folds, for each last label two others, show none of the host's suffixes, as if they were unknown."""
    return F.pmod(F.xxhash64(suffix1) + fold, F.lit(FOLDS)) >= 2


def with_other_folds(sample: DataFrame) -> DataFrame:
    """The same for the sample itself: from the other folds, and in some folds not at all for the host's suffixes."""
    out = sample
    for k in SUFFIXES:
        own = _rates(sample, k, "fold").withColumnRenamed("_n", "_own_n").withColumnRenamed("_blocked", "_own_blocked")
        out = out.join(F.broadcast(_rates(sample, k)), k).join(F.broadcast(own), [k, "fold"])
        known = F.lit(True) if k == "folder" else shows_suffixes(F.col("suffix1"), F.col("fold"))
        out = out.withColumn(f"f_{k}", _share(F.when(known, F.col("_blocked") - F.col("_own_blocked")), F.when(known, F.col("_n") - F.col("_own_n"))))
        out = out.drop("_n", "_blocked", "_own_n", "_own_blocked")
    return out


def fit(labelled: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Learns from rows (url, host, path, label 0.0 or 1.0); the result adds block_score to rows with url, host and path."""
    chosen = labelled.select(*_URL, "label").distinct().orderBy(F.xxhash64("url"), "url", "label").limit(SAMPLE)
    sample = stored(lexical(chosen).withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(FOLDS))))
    kinds = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(kinds) < 2:
        return lambda urls: urls.withColumn("block_score", F.lit(1.0 if kinds.get(1.0) else 0.0))
    even = F.when(F.col("label") == 1, sum(kinds.values()) / (2 * kinds[1.0])).otherwise(sum(kinds.values()) / (2 * kinds[0.0]))
    sample = stored(sample.withColumn("weight", even))
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    train = stored(with_other_folds(sample).select(*FEATURES, "label", "weight"))
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, weightCol="weight").fit(assembler.transform(train).select("features", "label", "weight"))

    def score(urls: DataFrame) -> DataFrame:
        rows = urls.select(F.struct("*").alias("_row"), *_URL)
        scored = trees.transform(assembler.transform(with_statistics(lexical(rows), sample)))
        return scored.select(*(F.col(f"_row.`{c}`").alias(c) for c in urls.columns), F.get(vector_to_array("probability"), 1).alias("block_score"))

    return score


def judge(urls: DataFrame, url_col: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """The rows, but for columns of these names, with host, path, rule, decided (by a rule), block_score (of the trees) and verdict."""
    rows = decided(urls, url_col, rules)
    score = fit(rows.where(F.col("decided").isNotNull()).select(*_URL, (F.col("decided") == "block").cast("double").alias("label")))
    says = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    adds = {"host": F.col("host"), "path": F.col("path"), "rule": F.col("rule"), "decided": F.col("decided"), "block_score": F.col("block_score"), "verdict": F.coalesce("decided", says)}
    return score(rows).select(*(F.col(f"row.`{c}`").alias(c) for c in urls.columns if c not in adds), *(c.alias(n) for n, c in adds.items()))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "block_score")
