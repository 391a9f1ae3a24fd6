"""Robust baselines: one frozen card for each flow, exact for flows of any length.

A flow's quantiles come from one aggregation, its median absolute deviation from
a second one after its median has come back by a join.  Such an aggregation
holds a flow's different values in one task, so flows above LONG_FLOW rows go
another way, to the same numbers: a sketch that tasks merge cuts a flow's values
into parts of about equal size, whose rows are counted; only the parts in which
a quantile's ranks lie are then put in order, each by itself.  Inputs that
Catalyst estimates below SMALL_BYTES hold no such flow that a task couldn't,
and are planned without that way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import robust_scale
from ..functions.params import Params

#: Columns of a measurement that a card describes.
DESCRIBED = ("rtt", "jitter", "loss_pct")
KEYS = ("flow_id", "route")
#: Rows from which on a flow's values are cut into parts, and how many: SIDE times SIDE.
LONG_FLOW, SIDE = 1_000_000, 16
#: Estimated size of an input from which on it may hold long flows.
SMALL_BYTES = 256 << 20


def at_rank(value: Column, upto: Column, times: Column, total: Column, share: float) -> Column:
    """What a value adds to the quantile at ``share``, between ranks in proportion; summed over all values it is the quantile.

    upto counts the values up to and with this one, times how often it stands there.
    """
    rank = (total - 1) * share
    low = F.floor(rank)
    holds = lambda r: ((r < upto) & (r >= upto - times)).cast("double")
    return value * (holds(low) * (low + 1 - rank) + holds(low + 1) * (rank - low))


def _part_of(value: Column, rough: Column, fine: Column) -> Column:
    """How many of a key's sorted cuts lie below a value: among every SIDEth one, then among those in between."""
    below = lambda some: F.size(F.filter(some, lambda c: c < value))
    return below(rough) * SIDE + below(F.get(fine, below(rough)))


def value_cuts(values: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, n, rough, fine): cuts of a key's values into SIDE times SIDE parts of about equal size."""
    points = [i / SIDE**2 for i in range(1, SIDE**2)]
    cuts = values.groupBy(*keys).agg(F.percentile_approx("value", points, 10 * SIDE**2).alias("c"), F.count("*").alias("n"))
    rough, fine = [F.get("c", F.lit(i * SIDE - 1)) for i in range(1, SIDE)], [F.slice("c", i * SIDE + 1, SIDE - 1) for i in range(SIDE)]
    return cuts.select(*keys, "n", F.array(*rough).alias("rough"), F.array(*fine).alias("fine"))


def split_quantiles(values: DataFrame, keys: tuple[str, ...], shares: dict[str, float]) -> DataFrame:
    """(keys and a column for each share): exact quantiles of ``value``, never null, whatever the rows of a key.

    The cuts only decide which task counts a value, so their error changes no result.
    """
    dealt = _joined(values, value_cuts(values, keys), keys).select(*keys, "value", "n", _part_of(F.col("value"), F.col("rough"), F.col("fine")).alias("part"))
    sizes = dealt.groupBy(*keys, "part", "n").agg(F.count("*").alias("size"))
    upto = F.sum("size").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    wanted = None
    for share in shares.values():
        low = F.floor((F.col("n") - 1) * share)
        has = ((low < F.col("upto")) & (low >= F.col("upto") - F.col("size"))) | ((low + 1 < F.col("upto")) & (low + 1 >= F.col("upto") - F.col("size")))
        wanted = has if wanted is None else wanted | has
    asked = sizes.withColumn("upto", upto).where(wanted).select(*keys, "part", (F.col("upto") - F.col("size")).alias("before"))
    counted = _joined(dealt, asked, (*keys, "part")).groupBy(*keys, "part", "before", "n", "value").agg(F.count("*").alias("times"))
    inside = F.sum("times").over(Window.partitionBy(*keys, "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumn("upto", F.col("before") + inside)
    return ranked.groupBy(*keys).agg(*(F.sum(at_rank(F.col("value"), F.col("upto"), F.col("times"), F.col("n"), q)).alias(name) for name, q in shares.items()))


_LINE = (*KEYS, "n_rows", "n_valid", "median", "iqr", "mad", "jitter_typical", "loss_typical")


def _joined(left: DataFrame, right: DataFrame, keys: tuple[str, ...], how: str = "inner") -> DataFrame:
    """A join in which null keys meet."""
    other = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    match = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return left.join(other, match, how).drop(*(f"_{k}" for k in keys))


def _short(rows: DataFrame) -> DataFrame:
    """Lines of flows whose values fit one task."""
    q = F.percentile("rtt", F.array(*map(F.lit, (0.25, 0.5, 0.75))))
    first = rows.groupBy(*KEYS).agg(
        F.count("*").alias("n_rows"), F.count("rtt").alias("n_valid"), q.alias("_q"), F.percentile("jitter", 0.5).alias("jitter_typical"), F.percentile("loss_pct", 0.5).alias("loss_typical")
    )
    first = first.select("*", F.get("_q", F.lit(1)).alias("median"), (F.get("_q", F.lit(2)) - F.get("_q", F.lit(0))).alias("iqr"))
    own = [c for c in _LINE if c not in (*KEYS, "mad")]
    away = _joined(rows.select(*KEYS, "rtt"), first.select(*KEYS, F.struct(*own).alias("line")), KEYS)
    mad = F.percentile(F.abs(F.col("rtt") - F.col("line.median")), 0.5)
    return away.groupBy(*KEYS).agg(F.any_value("line").alias("line"), mad.alias("mad")).select(*KEYS, "line.*", "mad").select(*_LINE)


def _long(rows: DataFrame) -> DataFrame:
    """Lines of flows of any length."""
    values = rows.select(*KEYS, *(F.col(c).cast("double").alias(c) for c in DESCRIBED)).unpivot(list(KEYS), list(DESCRIBED), "column", "value").where("value IS NOT NULL")
    found = split_quantiles(values, (*KEYS, "column"), {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    of = lambda column, stat: F.max(F.when(F.col("column") == column, stat))
    found = found.groupBy(*KEYS).agg(of("rtt", F.col("q50")).alias("median"), of("rtt", F.col("q75") - F.col("q25")).alias("iqr"), of("jitter", F.col("q50")).alias("jitter_typical"), of("loss_pct", F.col("q50")).alias("loss_typical"))
    away = _joined(rows.where("rtt IS NOT NULL"), found.select(*KEYS, "median"), KEYS).select(*KEYS, F.abs(F.col("rtt").cast("double") - F.col("median")).alias("value"))
    counts = rows.groupBy(*KEYS).agg(F.count("*").alias("n_rows"), F.count("rtt").alias("n_valid"))
    return _joined(_joined(counts, found, KEYS, "left"), split_quantiles(away, KEYS, {"mad": 0.5}), KEYS, "left").select(*_LINE)


def may_be_long(rows: DataFrame) -> bool:
    """Whether Catalyst's estimate lets a flow be too long for one task; an unknown size counts as large."""
    return int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= SMALL_BYTES


def described(rows: DataFrame) -> DataFrame:
    """A line for each flow: counts, medians, quartile range and MAD, whatever the number of answers; statistics of no values are null."""
    if may_be_long(rows):
        long = rows.groupBy(*KEYS).agg(F.count("*").alias("_n")).where(F.col("_n") > LONG_FLOW).select(*KEYS)
        lines = _short(_joined(rows, long, KEYS, "left_anti")).unionByName(_long(_joined(rows, long, KEYS, "left_semi")))
    else:
        lines = _short(rows)
    return lines.select("*", (F.col("n_valid") / F.col("n_rows")).alias("response_rate"))


def distances(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """(flow_id, t, distance) of every answered row from its flow's median."""
    answered = rows.where("rtt IS NOT NULL").select("flow_id", "t", "rtt")
    return answered.join(lines.select("flow_id", "median"), "flow_id").selectExpr("flow_id", "t", "abs(rtt - median) AS distance")


def cards(rows: DataFrame, p: Params) -> DataFrame:
    """The cards of the rows given: those with too few answers are marked, and their median and MAD are null."""
    enough = F.col("n_valid") >= p.min_valid
    guarded = {c: F.when(enough, F.col(c)).alias(c) for c in ("median", "mad")}
    lines = described(rows)
    return lines.select(*(guarded.get(c, F.col(c)) for c in lines.columns), (~enough).alias("insufficient"))


def baseline(measured: DataFrame, p: Params) -> DataFrame:
    """The cards of period A."""
    return cards(measured.where("period = 'A'"), p)


def limits_by_route(frozen: DataFrame, p: Params) -> DataFrame:
    """The thresholds in milliseconds: for each route the medians of its flows' limits."""
    limits = {"median": F.col("median")}
    for name, z, increase in (("risk", p.z_risk, p.increase_risk), ("fail", p.z_fail, p.increase_fail)):
        limits[f"limit_z_{name}"] = F.col("median") + z * robust_scale(p)
        limits[f"limit_increase_{name}"] = F.col("median") * (1 + increase / 100)
    each = frozen.where("NOT insufficient").select("route", *(c.alias(n) for n, c in limits.items()))
    return each.groupBy("route").agg(F.count("*").alias("flows"), *(F.round(F.percentile(n, 0.5), 1).alias(n) for n in limits))


def median_of_medians(frozen: DataFrame) -> DataFrame:
    """Each flow weighs once."""
    return frozen.agg(F.percentile("median", 0.5).alias("median_of_medians"))
