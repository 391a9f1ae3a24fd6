"""Accounts that must balance, and results that must equal an independent path to them.

Each function gives its offenders, or a few rows of sums to be compared; every
result is a DataFrame, and nothing is collected.
"""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.params import CLASSES, Params
from .evaluate import bootstrap_draws, class_metrics, confusion, flow_counts, transitions
from .joins import compare_tables, range_window
from .labels import gap_flag


def window_mismatches(feat: DataFrame, p: Params, tol: float = 1e-9) -> DataFrame:
    """Rows whose trailing z features differ from a self-join on positions, or are null although the window holds a z."""
    other = range_window(feat, p.window, "robust_z").select("flow_id", "t", "min_k", "mean_k", "n_k")
    both = feat.select("flow_id", "t", "min5_z", "mean5_z").join(other, ["flow_id", "t"], "full_outer")
    differs = lambda x, y: (F.col(x).isNull() != F.col(y).isNull()) | F.coalesce(F.abs(F.col(x) - F.col(y)) > tol, F.lit(False))
    return both.where(differs("min5_z", "min_k") | differs("mean5_z", "mean_k") | (F.col("min5_z").isNull() != (F.coalesce("n_k", F.lit(0)) == 0))).select("flow_id", "t")


def labelled_account(feat: DataFrame, lab: DataFrame, declared: tuple[str, ...]) -> DataFrame:
    """(rows_in, rows_out, missing, undeclared) of labelling: rows before and after, and columns against a declared list (metadata)."""
    missing, extra = (F.array(*map(F.lit, sorted(x))).cast("array<string>") for x in (set(declared) - set(lab.columns), set(lab.columns) - set(declared)))
    return feat.agg(F.count("*").alias("rows_in")).crossJoin(F.broadcast(lab.agg(F.count("*").alias("rows_out")))).select("*", missing.alias("missing"), extra.alias("undeclared"))


def floor_faults(lab: DataFrame, p: Params) -> DataFrame:
    """(flow_id, t, fault): labels that contradict the values behind rule 3, read from the columns and not from the order of the rules.

    An extreme z with an increase above the floor belongs to rules 1 to 3; an
    extreme z with an increase below it, or without one, never to rule 3.  Without a
    floor every increase is above it.  Rows without z have no fault.
    """
    extreme, rule = F.col("robust_z") >= p.z_fail, F.col("rule")
    above = F.lit(True) if p.floor is None else F.coalesce(F.col("increase_pct") >= p.floor, F.lit(False))
    fault = F.when(extreme & above & (rule > 3), "extreme outside rules 1 to 3").when(extreme & ~above & (rule == 3), "rule 3 below the floor")
    return lab.select("flow_id", "t", fault.alias("fault")).where("fault IS NOT NULL")


def block_order_faults(blk: DataFrame, names: tuple[str, ...] = ("train", "validation", "test")) -> DataFrame:
    """(block, fault): blocks that are absent, begin before the one before them ends, or lack a class."""
    ends = blk.groupBy("block").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.collect_set("status_now").alias("seen"))
    wanted = blk.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, names))).alias("no", "block"))
    all_blocks = wanted.join(ends, "block", "left")
    before = all_blocks.select((F.col("no") + 1).alias("no"), F.col("last_t").alias("ended"))
    faults = F.array_compact(
        F.array(
            F.when(F.col("first_t").isNull(), "absent"),
            F.when(F.col("first_t") <= F.col("ended"), "overlaps"),
            F.when(F.size(F.array_except(F.array(*map(F.lit, CLASSES)), "seen")) > 0, "lacks a class"),
        )
    )
    return all_blocks.join(before, "no", "left").select("block", F.explode(faults).alias("fault"))


def feature_faults(x: DataFrame, source: DataFrame, declared: tuple[str, ...]) -> DataFrame:
    """(column, fault): columns of a feature matrix that are missing or undeclared, aren't double, or have other null counts than their source."""
    kinds = dict(x.dtypes)
    named = [(c, "missing") for c in declared if c not in kinds] + [(c, "undeclared") for c in kinds if c not in declared] + [(c, "not double") for c in declared if kinds.get(c, "double") != "double"]
    nulls = lambda df, name: df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in kinds if c in source.columns)).unpivot([], [c for c in kinds if c in source.columns], "column", name)
    changed = nulls(x, "a").join(nulls(source, "b"), "column").where("a <> b").select("column", F.lit("nulls changed").alias("fault"))
    return x.sparkSession.createDataFrame(named, "column string, fault string").unionByName(changed)


def row_account(blk: DataFrame, k: int) -> DataFrame:
    """(rows, no_future, in_gap, kept, balance): all rows, those without a future, those with one but in the gap, those kept; balance is 0."""
    marked = gap_flag(blk, k)
    future = F.col("status_future").isNotNull()
    sums = marked.agg(F.count("*").alias("rows"), F.count_if(~future).alias("no_future"), F.count_if(future & F.col("in_gap")).alias("in_gap"), F.count_if(future & ~F.col("in_gap")).alias("kept"))
    return sums.withColumn("balance", F.expr("rows - no_future - in_gap - kept"))


def metrics_from_rows(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Class metrics counted from the rows, with no matrix between: an independent path to class_metrics."""
    rows = df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull())
    counts = lambda is_c, said_c: (F.count_if(is_c & said_c).alias("hit"), F.count_if(said_c & ~is_c).alias("false_alarms"), F.count_if(is_c & ~said_c).alias("misses"))
    lines = rows.agg(*(F.struct(F.lit(c).alias("class"), *counts(F.col(truth) == c, F.col(pred) == c)).alias(c) for c in CLASSES))
    out = lines.select(F.inline(F.array(*CLASSES)))
    zero = F.lit(0.0)
    return out.select(
        "class",
        F.coalesce(F.try_divide("hit", F.expr("hit + false_alarms")), zero).alias("precision"),
        F.coalesce(F.try_divide("hit", F.expr("hit + misses")), zero).alias("recall"),
        F.coalesce(F.try_divide(F.expr("2 * hit"), F.expr("2 * hit + false_alarms + misses")), zero).alias("f1"),
        F.expr("hit + misses").alias("support"),
    )


def metric_faults(df: DataFrame, truth: str, pred: str, tol: float = 1e-9, cm: DataFrame | None = None) -> DataFrame:
    """(class, why): classes whose metrics from the matrix differ from those from the rows, and a line if the matrix doesn't sum to the rows.

    cm is a matrix kept elsewhere that is to be held against the rows; without it, theirs.
    """
    cm = confusion(df, truth, pred) if cm is None else cm
    apart = compare_tables(class_metrics(cm), metrics_from_rows(df, truth, pred), ["class"], ["precision", "recall", "f1", "support"], tol)
    n = df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull()).agg(F.count("*").alias("rows"))
    short = cm.agg(F.sum("n").alias("n")).crossJoin(F.broadcast(n)).where("n <> rows").select(F.lit("all").alias("class"), F.lit("sum").alias("why"))
    return apart.unionByName(short)


def count_account(df: DataFrame, pred: str, by: str = "region") -> DataFrame:
    """(part, n, hits): rows and hits as the transitions, the groups and the rows themselves count them; the three agree."""
    rows = df.where("status_future IS NOT NULL")
    hit = F.count_if(F.col(pred) == F.col("status_future")).alias("hits")
    parts = {"transitions": transitions(df, pred), "groups": rows.groupBy(by).agg(F.count("*").alias("n"), hit), "rows": rows.agg(F.count("*").alias("n"), hit)}
    out = None
    for name, part in parts.items():
        line = part.agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).select(F.lit(name).alias("part"), "n", "hits")
        out = line if out is None else out.unionByName(line)
    return out


def choice_faults(results: DataFrame, chosen: DataFrame, key: str, score: str, simple_first: str, tolerance: float) -> DataFrame:
    """(key, fault): a choice that is out of tolerance of the best, and results within it that are simpler than the choice."""
    best = results.agg(F.max(score).alias("_best"))
    pick = chosen.select(F.col(simple_first).alias("_simple"), F.col(score).alias("_score"))
    near = F.col(score) >= F.col("_best") - tolerance
    simpler = results.crossJoin(F.broadcast(best)).crossJoin(F.broadcast(pick)).where(near & (F.col(simple_first) < F.col("_simple"))).select(key, F.lit("simpler").alias("fault"))
    far = chosen.crossJoin(F.broadcast(best)).where(~near).select(key, F.lit("out of tolerance").alias("fault"))
    return simpler.unionByName(far)


def bootstrap_account(df: DataFrame, resamples: int) -> DataFrame:
    """(resample, draws, flows, rows, weighted_rows): draws equal the flows, and the rows of the drawn flows equal each flow's rows times its draws."""
    flows = flow_counts(df, {})
    draws = bootstrap_draws(flows, resamples)
    by_draw = draws.join(flows.select("_no", "_rows"), "_no").groupBy("resample").agg(F.count("*").alias("draws"), F.sum("_rows").alias("rows"))
    weights = draws.groupBy("resample", "_no").agg(F.count("*").alias("w")).join(flows.select("_no", "_rows"), "_no")
    by_weight = weights.groupBy("resample").agg(F.sum(F.col("w") * F.col("_rows")).alias("weighted_rows"))
    total = flows.agg(F.count("*").alias("flows"))
    return by_draw.join(by_weight, "resample").crossJoin(F.broadcast(total)).select("resample", "draws", "flows", "rows", "weighted_rows")


def leaf_rules(model: Model, columns: list[str], path: str, df: DataFrame) -> list[tuple[int, dict[int, tuple[float, float]]]]:
    """For each leaf of a saved tree, by its number, the interval (low, high] of every feature that its path tests.

    A tree has a bounded number of nodes, so its table may be read by the driver.
    """
    model.write().overwrite().save(path)
    nodes = {r.id: r for r in df.sparkSession.read.parquet(f"{path}/data").selectExpr("nodeData.*" if "nodeData" in df.sparkSession.read.parquet(f"{path}/data").columns else "*").collect()}
    out: list[tuple[int, dict[int, tuple[float, float]]]] = []

    def walk(node: int, held: dict[int, tuple[float, float]]) -> None:
        r = nodes[node]
        if r.leftChild < 0:
            out.append((len(out), held))
            return
        k, cut = r.split.featureIndex, r.split.leftCategoriesOrThreshold[0]
        low, high = held.get(k, (float("-inf"), float("inf")))
        walk(r.leftChild, held | {k: (low, min(high, cut))})
        walk(r.rightChild, held | {k: (max(low, cut), high)})

    walk(0, {})
    return out


def leaf_predicate(rule: dict[int, tuple[float, float]], features: Column) -> Column:
    """The condition of a leaf over an array of feature values."""
    out = F.lit(True)
    for k, (low, high) in sorted(rule.items()):
        x = F.get(features, k)
        out = out & (x > low) & (x <= high)
    return out


def leaf_faults(scored: DataFrame, rules: list[tuple[int, dict[int, tuple[float, float]]]], features: str = "features") -> DataFrame:
    """Rows (with leaf and a features array) that the predicates put into another leaf, into none or into several."""
    fits = F.filter(F.array(*(F.when(leaf_predicate(rule, F.col(features)), F.lit(leaf)) for leaf, rule in rules)), lambda x: x.isNotNull())
    return scored.withColumn("_fits", fits).where((F.size("_fits") != 1) | (F.get("_fits", 0) != F.col("leaf").cast("int"))).drop("_fits")


def replay_faults(rows: DataFrame, flows: DataFrame) -> DataFrame:
    """(flow_id, t, faults) of replay rows out of order, of unknown class or flow, verifiable without a future, or whose future isn't later."""
    known = flows.select("flow_id").distinct().withColumn("_known", F.lit(True))
    both = rows.join(known, "flow_id", "left")
    domain = lambda c: F.col(c).isNull() | F.col(c).isin(*CLASSES)
    faults = F.array_compact(
        F.array(
            F.when(F.col("_known").isNull(), "unknown flow"),
            F.when(~(domain("status_now") & domain("prediction") & domain("status_future") & F.col("status_now").isNotNull()), "class"),
            F.when(F.col("verifiable") != F.col("status_future").isNotNull(), "future"),
            F.when(F.coalesce(F.col("t_future") <= F.col("t"), F.lit(False)), "time"),
            F.when(~F.col("in_order"), "order"),
        )
    )
    return both.select("flow_id", "t", faults.alias("faults")).where(F.size("faults") > 0)


def outside_block(exported: DataFrame, blk: DataFrame, block: str) -> DataFrame:
    """(flow_id, t, fault): exported rows that aren't rows of the shown block, or that stand there more than once."""
    keys = exported.groupBy("flow_id", "t").agg(F.count("*").alias("n"))
    inside = blk.where(F.col("block") == block).select("flow_id", "t")
    foreign = keys.join(inside, ["flow_id", "t"], "left_anti").select("flow_id", "t", F.lit("foreign").alias("fault"))
    return foreign.unionByName(keys.where("n > 1").select("flow_id", "t", F.lit("repeated").alias("fault")))
