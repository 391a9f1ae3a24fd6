"""Evaluation of predictions: confusion, metrics, transitions, scoreboards, bootstrap, picks and top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.params import CLASSES
from ..sources.tables import with_position


def _grid(df: DataFrame, *names: str) -> DataFrame:
    """Every combination of classes: a table of a fixed few rows."""
    out = df.sparkSession.range(1).drop("id")
    for n in names:
        out = out.withColumn(n, F.explode(F.array(*map(F.lit, CLASSES))))
    return out


def confusion(df: DataFrame, truth: str, pred: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., truth, pred, n) with zeros kept; rows without truth or prediction don't count."""
    seen = df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull()).groupBy(*by, F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    grid = _grid(df, "truth", "pred")
    if by:
        grid = seen.select(*by).distinct().crossJoin(F.broadcast(grid))
    return grid.join(seen, [*by, "truth", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def class_metrics(cm: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Precision, recall, F1 and support of each class; 0 where nothing is divided."""
    each = cm.select(*by, "n", "truth", "pred", F.explode(F.array(*map(F.lit, CLASSES))).alias("class"))
    sums = each.groupBy(*by, "class").agg(
        F.sum(F.when((F.col("truth") == F.col("class")) & (F.col("pred") == F.col("class")), F.col("n")).otherwise(0)).alias("hit"),
        F.sum(F.when(F.col("pred") == F.col("class"), F.col("n")).otherwise(0)).alias("said"),
        F.sum(F.when(F.col("truth") == F.col("class"), F.col("n")).otherwise(0)).alias("support"),
    )
    sums = sums.withColumn("precision", _share(F.col("hit"), F.col("said"))).withColumn("recall", _share(F.col("hit"), F.col("support")))
    f1 = _share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return sums.withColumn("f1", f1).select(*by, "class", "precision", "recall", "f1", "support")


def summary_metrics(cm: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    per = class_metrics(cm, by).groupBy(*by).agg(F.avg("f1").alias("macro_f1"), F.avg("recall").alias("balanced_accuracy"))
    hits = cm.groupBy(*by).agg(_share(F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)), F.sum("n")).alias("accuracy"), F.sum("n").alias("n"))
    return per.join(hits, list(by)) if by else per.crossJoin(F.broadcast(hits))


def transitions(df: DataFrame, pred: str) -> DataFrame:
    """(now, future, n, hits, accuracy) of all nine transitions; accuracy is null where there are no rows."""
    seen = df.where("status_future IS NOT NULL").groupBy(F.col("status_now").alias("now"), F.col("status_future").alias("future")).agg(F.count("*").alias("n"), F.count_if(F.col(pred) == F.col("status_future")).alias("hits"))
    out = _grid(df, "now", "future").join(seen, ["now", "future"], "left").na.fill(0, ["n", "hits"])
    return out.withColumn("accuracy", F.try_divide("hits", "n"))


def change_split(df: DataFrame, pred: str) -> DataFrame:
    """Accuracy where the future equals now and where it changes."""
    rows = df.where("status_future IS NOT NULL").withColumn("changes", F.col("status_now") != F.col("status_future"))
    return rows.groupBy("changes").agg(F.count("*").alias("n"), F.avg((F.col(pred) == F.col("status_future")).cast("double")).alias("accuracy"))


def metrics_long(cm: DataFrame) -> DataFrame:
    """(metric, class, value): one row for each number."""
    per = class_metrics(cm).withColumn("support", F.col("support").cast("double")).unpivot(["class"], ["precision", "recall", "f1", "support"], "metric", "value")
    total = summary_metrics(cm).withColumn("class", F.lit("all")).unpivot(["class"], ["macro_f1", "balanced_accuracy", "accuracy"], "metric", "value")
    return per.unionByName(total).select("metric", "class", "value")


def flow_counts(df: DataFrame, preds: dict[str, str], key: str = "flow_id") -> DataFrame:
    """One numbered row for each flow with verified rows: its rows, and support, hits and sayings of each class for each named prediction."""
    truth, sums = F.col("status_future"), [F.count("*").alias("_rows")]
    for c in CLASSES:
        sums.append(F.count_if(truth == c).alias(f"_support_{c}"))
        for m, pred in preds.items():
            sums += [F.count_if((truth == c) & (F.col(pred) == c)).alias(f"_hit_{m}_{c}"), F.count_if(F.col(pred) == c).alias(f"_said_{m}_{c}")]
    flows = with_position(df.where("status_future IS NOT NULL").groupBy(key).agg(*sums), [key], "_no")
    return flows.withColumn("_no", F.col("_no") - 1)


def bootstrap_draws(flows: DataFrame, resamples: int, pieces: int = 64, chunk: int = 4_096) -> DataFrame:
    """(resample, _no): as many numbers of flows for each resample as there are flows.  They follow from MD5 hashes and are made in pieces."""
    f = flows.agg(F.count("*").alias("_f"))
    ids = flows.sparkSession.range(resamples * pieces).select(F.expr(f"id DIV {pieces}").alias("resample"), (F.col("id") % pieces).alias("_piece"))
    first = lambda piece: F.floor(F.col("_f") * piece / pieces).cast("long")
    parts = ids.crossJoin(F.broadcast(f)).select("resample", "_f", first(F.col("_piece")).alias("_a"), first(F.col("_piece") + 1).alias("_b")).where("_a < _b")
    parts = parts.select("resample", "_f", "_b", F.explode(F.sequence("_a", F.col("_b") - 1, F.lit(chunk).cast("long"))).alias("_c"))
    draws = parts.select("resample", "_f", F.explode(F.sequence("_c", F.least(F.col("_c") + chunk, "_b") - 1)).alias("_i"))
    number = F.conv(F.substring(F.md5(F.concat_ws(":", "resample", "_i")), 1, 8), 16, 10).cast("long") % F.col("_f")
    return draws.select("resample", number.alias("_no"))


def bootstrap_ci(df: DataFrame, pred_a: str, pred_b: str, resamples: int, key: str = "flow_id", pieces: int = 64, chunk: int = 4_096) -> DataFrame:
    """95 % interval of the difference in macro F1, resampling whole flows: the counts of the drawn flows are summed."""
    flows = flow_counts(df, {"a": pred_a, "b": pred_b}, key)
    counts = [c for c in flows.columns if c not in (key, "_no", "_rows")]
    drawn = bootstrap_draws(flows, resamples, pieces, chunk).join(flows, "_no").groupBy("resample").agg(*(F.sum(c).alias(c) for c in counts))

    def macro(m: str) -> Column:
        each = []
        for c in CLASSES:
            precision, recall = _share(F.col(f"_hit_{m}_{c}"), F.col(f"_said_{m}_{c}")), _share(F.col(f"_hit_{m}_{c}"), F.col(f"_support_{c}"))
            each.append(_share(2 * precision * recall, precision + recall))
        return sum(each[1:], each[0]) / len(CLASSES)

    diffs = drawn.select((macro("a") - macro("b")).alias("diff"))
    return diffs.agg(F.percentile("diff", 0.025).alias("low"), F.percentile("diff", 0.975).alias("high"), F.count("*").alias("resamples"))


def scoreboard(df: DataFrame, instant: Column, pred: str) -> DataFrame:
    """Verified rows at an instant, hits of the prediction and of 'nothing changes'."""
    return df.where(F.col("status_future").isNotNull() & (F.col("t_future") <= instant)).agg(F.count("*").alias("verified"), F.count_if(F.col(pred) == F.col("status_future")).alias("hits"), F.count_if(F.col("status_now") == F.col("status_future")).alias("persistence_hits"))


def counters(df: DataFrame, instant: Column) -> DataFrame:
    now = df.where(F.col("t") <= instant)
    return now.agg(F.count("*").alias("n"), *(F.count_if(F.col("status_now") == c).alias(f"n_{c.lower()}") for c in CLASSES), F.count_if(F.col("is_timeout") == 1).alias("n_timeout"), F.count_if(F.col("status_future").isNull()).alias("n_without_future"))


def score_curve(df: DataFrame, pred: str, by: str = "region", bucket_s: int = 86_400) -> DataFrame:
    """Running hits and verified rows along t_future in each group.

    Time buckets of a group are summed first; their sums are cumulated, and a row's
    place within its bucket is added, so no task orders a whole group.
    """
    bucket = F.floor(F.col("t_future").cast("timestamp").cast("long") / bucket_s)
    rows = df.where("status_future IS NOT NULL").select(by, "flow_id", "t", "t_future", (F.col(pred) == F.col("status_future")).cast("long").alias("_hit"), bucket.alias("_bucket"))
    sums = rows.groupBy(by, "_bucket").agg(F.count("*").alias("_n"), F.sum("_hit").alias("_h"))
    earlier = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    starts = sums.select(F.col(by).alias("_by"), F.col("_bucket").alias("_of"), start("_n").alias("_n0"), start("_h").alias("_h0"))
    placed = rows.join(starts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_bucket") == F.col("_of")))
    own = Window.partitionBy(by, "_bucket").orderBy("t_future", "flow_id", "t").rowsBetween(Window.unboundedPreceding, 0)
    return placed.select(by, "flow_id", "t_future", (F.col("_n0") + F.count("*").over(own)).alias("verified"), (F.col("_h0") + F.sum("_hit").over(own)).alias("hits"))


def global_curve(df: DataFrame, pred: str, bucket_s: int) -> DataFrame:
    """The running scoreboard of all flows by time bucket: only the buckets' sums are ordered."""
    bucket = F.floor(F.col("t_future").cast("timestamp").cast("long") / bucket_s)
    sums = df.where("status_future IS NOT NULL").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.count_if(F.col(pred) == F.col("status_future")).alias("h"))
    order = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return sums.select("bucket", F.sum("n").over(order).alias("verified"), F.sum("h").over(order).alias("hits"))


def typical_interval(df: DataFrame) -> DataFrame:
    """The upper median of each flow's steps in seconds: sorted[n // 2], counted from 0."""
    by = Window.partitionBy("flow_id").orderBy("t")
    steps = df.withColumn("delta_s", F.col("t").cast("timestamp").cast("long") - F.lag("t").over(by).cast("timestamp").cast("long")).where("delta_s IS NOT NULL")
    ranked = steps.withColumn("_r", F.row_number().over(Window.partitionBy("flow_id").orderBy("delta_s", "t"))).withColumn("_n", F.count("*").over(Window.partitionBy("flow_id")))
    return ranked.where("_r = _n DIV 2 + 1").select("flow_id", F.col("delta_s").alias("interval_s"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


def single_valued(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Keys for which a column takes several values (null counts as one)."""
    counts = df.groupBy(key).agg(*(F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\0"))).alias(f"n_{c}") for c in cols))
    return counts.where(" OR ".join(f"n_{c} > 1" for c in cols))


def null_profile(df: DataFrame) -> DataFrame:
    """(column, nulls) in one pass."""
    counts = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    return counts.unpivot([], df.columns, "column", "nulls")


def block_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("block").agg(F.count("*").alias("n"), *(F.count_if(F.col("status_now") == c).alias(f"n_{c.lower()}") for c in CLASSES), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def distribution(df: DataFrame, col: str) -> DataFrame:
    counts = df.groupBy(col).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(df.agg(F.count("*").alias("_all")))).withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def null_future_reasons(df: DataFrame, gate: tuple[int, int]) -> DataFrame:
    d = F.col("delta_s")
    why = F.when(d.isNull(), "end_of_series").when(d < gate[0], "too_soon").when(d > gate[1], "too_late").otherwise("has_future")
    return df.groupBy(why.alias("reason")).agg(F.count("*").alias("n"))


def change_rate(df: DataFrame) -> DataFrame:
    return df.where("status_future IS NOT NULL").agg(F.avg((F.col("status_now") != F.col("status_future")).cast("double")).alias("change_rate"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def coverage(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("bursts"), F.sum("is_timeout").alias("timeouts"))


def coverage_summary(df: DataFrame, key: str) -> DataFrame:
    return coverage(df, key).agg(F.min("bursts").alias("least"), F.percentile("bursts", 0.5).alias("middle"), F.max("bursts").alias("most"))


def top1_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in a total order."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def pick_examples(df: DataFrame) -> DataFrame:
    """Three rows to show: a clean OK of a long path, a RISK in the middle of the band, a FAIL of a short path."""
    cols = ["flow_id", "t", "rtt", "robust_z", "rule"]
    ok = df.where("status_now = 'OK' AND abs(robust_z) <= 1 AND n5_moderate = 0").orderBy(F.desc("rtt"), "flow_id", "t").limit(1).select(F.lit("ok").alias("example"), *cols)
    risk = df.where("rule = 5 AND robust_z BETWEEN 2 AND 3.5").orderBy(F.abs(F.col("robust_z") - 2.75), "flow_id", "t").limit(1).select(F.lit("risk").alias("example"), *cols)
    fail = df.where("rule = 3 AND robust_z >= 4").orderBy("rtt", "flow_id", "t").limit(1).select(F.lit("fail").alias("example"), *cols)
    return ok.unionByName(risk).unionByName(fail)


def error_case(df: DataFrame, pred: str, truth: str, said: str, long_path: bool, stable: bool, largest: bool) -> DataFrame:
    """One wrong prediction: the path's median above (below) the median of medians, ties by flow and time."""
    side = F.col("median") > F.col("median_of_medians") if long_path else F.col("median") < F.col("median_of_medians")
    rows = df.where(side & (F.col("status_future") == truth) & (F.col(pred) == said) & F.col("rtt").isNotNull())
    rows = rows.where(F.abs("robust_z") <= 1) if stable else rows
    return rows.orderBy(F.desc("rtt") if largest else F.asc("rtt"), "flow_id", "t").limit(1).select("flow_id", "t", "rtt")


def feed(df: DataFrame, instant: Column, n: int, only_errors: str | None = None) -> DataFrame:
    """The latest verified rows, newest first; only_errors names a prediction that must be wrong."""
    rows = df.where(F.col("status_future").isNotNull() & (F.col("t_future") <= instant))
    rows = rows.where(F.col(only_errors) != F.col("status_future")) if only_errors else rows
    return rows.orderBy(F.desc("t_future"), "flow_id", F.desc("t")).limit(n)


def page(df: DataFrame, number: int, size: int, order: list[Column]) -> DataFrame:
    """A page (from 1) of a listing in a total order."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_after(df: DataFrame, time: str, key: str, after: tuple, size: int) -> DataFrame:
    """The rows after the last one seen, newest first: pages of any depth cost the same."""
    t, k = map(F.lit, after)
    return df.where((F.col(time) < t) | ((F.col(time) == t) & (F.col(key) < k))).orderBy(F.desc(time), F.desc(key)).limit(size)


def choose(results: DataFrame, score: str, simple_first: list[str], tolerance: float) -> DataFrame:
    """The simplest result whose score is within tolerance of the best."""
    best = results.agg(F.max(score).alias("_best"))
    near = results.crossJoin(F.broadcast(best)).where(F.col(score) >= F.col("_best") - tolerance).drop("_best")
    return near.orderBy(*simple_first, F.desc(score)).limit(1)


def parity_sample(df: DataFrame, strata: str, each: int, order: str) -> DataFrame:
    """At most so many rows of each stratum, in the order of a hash."""
    place = F.row_number().over(Window.partitionBy(strata).orderBy(F.sha2(F.col(order).cast("string"), 256), order))
    return df.withColumn("_place", place).where(F.col("_place") <= each).drop("_place")


def sample_keys(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n keys that follow from a seed, whatever the order of the rows."""
    return df.select(key).distinct().orderBy(F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256), key).limit(n)
