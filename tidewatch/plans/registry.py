"""The registered queries of the library and their SQL.

Keys begin with the number of the operator in the survey.  Every query reads the
given tables: events as measurements of sparse series, orders with their lines
as bursts of pings, and the dimensions.  Doubles are rounded to six digits, as
sums depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.params import EVENT_PARAMS as P
from ..functions.params import EXTRA_COLUMNS, HIDDEN_COLUMNS, MODEL_COLUMNS
from ..operators import audits as U
from ..operators import baseline as B
from ..operators import checks as C
from ..operators import evaluate as E
from ..operators import features as FT
from ..operators import geo as G
from ..operators import joins as J
from ..operators import labels as L
from ..operators import measurements as M
from ..operators import models as MD
from ..sources import adapters as A
from ..sources import files as S
from ..sources.tables import release, scratch, stored
from . import views as V
from .sql import KM, steps

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

AT = "TIMESTAMP '2024-01-20 00:00:00'"

#: What fits, scores and accounts of models read of a labelled row, besides its block.
MODEL_ROW = tuple(dict.fromkeys(("flow_id", "t", "region", "rtt", "is_timeout", "status_now", "status_future", *MODEL_COLUMNS, *EXTRA_COLUMNS)))


class Chain:
    """The measurement chain over one folder of tables; every step is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self.meas = A.event_measurements(spark, sf_dir)
        self.card = B.baseline(self.meas, P)
        self.joined = FT.attach_baseline(self.meas.where("period = 'B'"), self.card)
        self.rel = FT.relative_metrics(self.joined, P)
        self.feat = FT.window_features(self.rel, P)
        self.lab = L.current_labels(self.feat, P)
        self.fut = L.with_predictions(L.future_labels(self.lab, P))
        self.blk = L.tag_block(self.fut, P.splits)

    def table(self, name: str) -> DataFrame:
        return A.table(self.spark, self.sf_dir, name)

    @cached_property
    def model_rows(self) -> DataFrame:
        """What models read of blk, stored: a fit passes over its rows several times, scores and accounts do again, and each pass would compute the chain anew."""
        held = stored(self.fut.select(*MODEL_ROW))
        rows = stored(L.tag_block(held, P.splits))
        release(held)
        return rows

    @property
    def bursts(self) -> DataFrame:
        return A.order_bursts(self.spark, self.sf_dir)

    @property
    def lines(self) -> DataFrame:
        """The flows of period A described, before the floor."""
        return B.described(self.meas.where("period = 'A'"))

    @property
    def orders(self) -> DataFrame:
        return M.measurements(self.bursts)

    @property
    def replay(self) -> DataFrame:
        """The validation block as replay documents."""
        rows = self.blk.where("block = 'validation'").withColumn("prediction", F.col("rule_pred"))
        models = self.spark.range(2).select(F.element_at(F.array(F.lit("rule"), F.lit("persistence")), F.col("id").cast("int") + 1).alias("model"))
        return S.export_replay(rows, {"block": "validation"}, models)

    @property
    def hubs(self) -> DataFrame:
        return A.hubs(self.spark, self.sf_dir)

    @property
    def probes(self) -> DataFrame:
        return A.probes(self.spark, self.sf_dir)

    @property
    def instant(self):
        """An instant of the middle of the data, as a column."""
        return F.expr(self.at)

    @property
    def at(self) -> str:
        return AT.replace("TIMESTAMP", "TIMESTAMP_NTZ")


def _rounded(df: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*(F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c).cast("timestamp_ntz").alias(c) if kinds[c] == "timestamp" else F.col(c) for c in df.columns))


def query(name: str, sql: str | None = None):
    """Registers a function of a Chain; sql is put behind the steps that it names."""

    def add(f: Callable[[Chain], DataFrame]) -> Callable[[Chain], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: _rounded(f(Chain(spark, sf_dir)))
        if sql:
            ORACLE_SQL[name] = steps(sql)
        return f

    return add


def _six(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.distribution(Chain(spark, sf_dir).lab, "status_now")


FEATS = _six("latency_ratio", "increase_pct", "robust_z", "jitter_ratio")

# Projections and measurements
query("p1_measurements", f"SELECT flow_id, prb_id, dst_addr, msm_id, route, destination_country, destination_region, t, {_six('rtt', 'jitter', 'loss_pct')}, is_timeout FROM om")(lambda c: c.orders)
query("p2_flow_key", "SELECT flow_id, count(*) AS n FROM om GROUP BY flow_id")(lambda c: c.bursts.groupBy(M.flow_id("prb_id", "dst_addr", "msm_id").alias("flow_id")).agg(F.count("*").alias("n")))
query("p3_split_flow_key", "SELECT DISTINCT flow_id, split_part(flow_id, '|', 1) AS prb, split_part(flow_id, '|', 2) AS dst FROM om")(lambda c: c.orders.select("flow_id").distinct().select("flow_id", F.get(M.split_flow_id("flow_id"), 0).alias("prb"), F.get(M.split_flow_id("flow_id"), 1).alias("dst")))
query("p4_route", "SELECT 'net→' || r_name AS route FROM region")(lambda c: c.table("region").select(M.route("net", "r_name").alias("route")))
query("p5_timeout_flag", "SELECT is_timeout, count(*) AS n FROM om GROUP BY is_timeout")(lambda c: c.orders.groupBy("is_timeout").agg(F.count("*").alias("n")))
query("p6_period", "SELECT period, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM meas GROUP BY period")(lambda c: c.meas.groupBy("period").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t")))
query("p7_relative_metrics", f"SELECT flow_id, t, {_six('latency_ratio', 'increase_pct')} FROM rel")(lambda c: c.rel.select("flow_id", "t", "latency_ratio", "increase_pct"))
query("p8_robust_z", f"SELECT flow_id, t, {_six('robust_z')} FROM rel")(lambda c: c.rel.select("flow_id", "t", "robust_z"))
query("p9_robust_scale", "SELECT flow_id, round(CASE WHEN mad > 0 THEN 1.4826 * mad ELSE greatest(iqr / 1.349, 1.0) END, 6) AS scale FROM card")(lambda c: c.card.select("flow_id", X.robust_scale(P).alias("scale")))
query("p10_jitter_ratio", f"SELECT flow_id, t, {_six('jitter_ratio')} FROM rel")(lambda c: c.rel.select("flow_id", "t", "jitter_ratio"))
query("p11_moderate", "SELECT flow_id, t, moderate FROM rel")(lambda c: c.rel.select("flow_id", "t", "moderate"))
query("p12_deviated", "SELECT flow_id, t, deviated FROM rel")(lambda c: c.rel.select("flow_id", "t", "deviated"))
query("p13_flag", "SELECT CAST(coalesce(rtt > 50, false) AS INTEGER) AS flag, count(*) AS n FROM meas GROUP BY 1")(lambda c: c.meas.groupBy(X.flag(F.col("rtt") > 50).alias("flag")).agg(F.count("*").alias("n")))
query("p14_rule", "SELECT flow_id, t, rule FROM lab")(lambda c: c.lab.select("flow_id", "t", "rule"))
query("p15_status", "SELECT flow_id, t, status_now FROM lab")(lambda c: c.lab.select("flow_id", "t", "status_now"))
query("p16_floor_effect", "SELECT rule AS rule_with, CAST(CASE WHEN loss_pct >= 10 THEN 1 WHEN n5_timeout >= 3 THEN 2 WHEN robust_z >= 3.5 THEN 3 WHEN n5_increase80 >= 2 THEN 4 WHEN moderate = 1 AND n5_moderate >= 2 THEN 5 ELSE 6 END AS INTEGER) AS rule_without, count(*) AS n FROM lab GROUP BY 1, 2")(lambda c: L.floor_effect(c.feat, P))
query("p17_block", "SELECT block, count(*) AS n FROM blk GROUP BY block")(lambda c: c.blk.groupBy("block").agg(F.count("*").alias("n")))
query("p18_block_by_rows", "SELECT flow_id, t, k AS position, CASE WHEN k <= floor(n * 0.5) THEN 'train' WHEN k <= floor(n * 0.7) THEN 'validation' ELSE 'test' END AS block FROM (SELECT flow_id, t, row_number() OVER (ORDER BY t, flow_id) AS k, count(*) OVER () AS n FROM feat)")(lambda c: L.tag_block_by_rows(c.feat.select("flow_id", "t", X.epoch_us(F.col("t")).alias("us")), ["us", "flow_id"], P.splits).select("flow_id", "t", "position", "block"))
query("p19_split_ties", "SELECT count(*) AS ties FROM (SELECT block, min(t) AS a, max(t) AS b FROM blk GROUP BY block) x JOIN (SELECT block, min(t) AS a FROM blk GROUP BY block) y ON x.b = y.a AND x.block <> y.block")(lambda c: L.split_ties(c.blk).agg(F.count("*").alias("ties")))
query("p20_usable_rows", "SELECT flow_id, t, block FROM gapped WHERE status_future IS NOT NULL AND NOT in_gap")(lambda c: L.usable_rows(c.blk, 3).select("flow_id", "t", "block"))
query("p21_verifiable", "SELECT flow_id, t, status_future IS NOT NULL AS verifiable, t_future FROM fut")(lambda c: L.verifiable(c.fut).select("flow_id", "t", "verifiable", "t_future"))
query("p22_select_features", f"SELECT {_six('robust_z', 'increase_pct', 'jitter_ratio', 'loss_pct')}, is_timeout, n5_timeout, n5_increase80, n5_moderate FROM fut")(lambda c: C.select_features(c.fut.drop("delta_s", "median", "mad", "iqr", "jitter_typical", "persistence_pred", "rule_pred", "min5_z", "mean5_z"), MODEL_COLUMNS, HIDDEN_COLUMNS))
query("p23_one_hot", "SELECT flow_id, t, " + ", ".join(f"CAST(CASE WHEN region = {k} THEN 1 ELSE 0 END AS DOUBLE) AS region_{k}" for k in range(5)) + " FROM blk")(lambda c: C.one_hot(c.blk, "region", list(range(5))).select("flow_id", "t", *(f"region_{k}" for k in range(5))))
query("p24_zero_fill", "SELECT flow_id, t, round(coalesce(robust_z, 0), 6) AS robust_z, coalesce(n5_increase80, 0) AS n5_increase80 FROM feat")(lambda c: c.feat.select("flow_id", "t", "robust_z", "n5_increase80").na.fill(0))
query("p25_null_unanswered", "SELECT o_orderkey, CASE WHEN packets_received > 0 THEN packets_sent END AS answered FROM bursts0 WHERE o_orderkey IN (SELECT o_orderkey FROM orders)")(lambda c: S.without_unanswered(c.bursts.select("o_orderkey", "packets_received", F.col("packets_sent").alias("answered")), ("answered",), "packets_received").drop("packets_received"))
query("p26_source_filter", "SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAYS AND value > 0")(lambda c: S.source_filter(c.table("events"), "ts", 7).where("value > 0").select("event_id", "ts"))
query("p27_recent", "SELECT flow_id, t FROM meas WHERE t > (SELECT max(t) FROM meas) - INTERVAL 24 HOURS")(lambda c: S.recent(c.meas, 24).select("flow_id", "t"))
query("p28_display_round", "SELECT flow_id, t, round(rtt, 2) AS rtt FROM meas")(lambda c: c.meas.select("flow_id", "t", F.round("rtt", 2).alias("rtt")))
query("p29_as_of", f"SELECT count(*) AS n FROM fut WHERE t <= {AT}")(lambda c: J.as_of(c.fut, c.instant).agg(F.count("*").alias("n")))

# Joins
query("j1_attach_baseline", f"SELECT flow_id, t, {_six('median', 'iqr')} FROM rel")(lambda c: c.joined.select("flow_id", "t", "median", "iqr"))
query("j2_stats_with_mad", f"SELECT s.flow_id, {_six('median0', 'mad0')} FROM stats s LEFT JOIN mads d ON s.flow_id = d.flow_id")(lambda c: c.lines.select("flow_id", F.col("median").alias("median0"), F.col("mad").alias("mad0")))
query("j3_deviation", "SELECT m.flow_id, t, round(abs(rtt - median0), 6) AS distance FROM meas m JOIN stats s ON m.flow_id = s.flow_id WHERE period = 'A' AND rtt IS NOT NULL")(lambda c: B.distances(c.meas.where("period = 'A'"), c.lines))
query("j4_with_scalar", "SELECT flow_id, t, round(rtt - (SELECT max(rtt) FROM meas), 6) AS below FROM meas")(lambda c: J.with_scalar(c.meas, c.meas.agg(F.max("rtt").alias("top"))).select("flow_id", "t", (F.col("rtt") - F.col("top")).alias("below")))
query("j5_missing_baseline", "SELECT DISTINCT flow_id FROM meas WHERE flow_id NOT IN (SELECT flow_id FROM card WHERE n_valid >= 40)")(lambda c: J.missing_baseline(c.meas, c.card.where("n_valid >= 40")))
query("j6_range_window", f"SELECT flow_id, t, {_six('min5_z', 'mean5_z')} FROM feat")(lambda c: J.range_window(c.rel, 5, "robust_z").select("flow_id", "t", F.col("min_k").alias("min5_z"), F.col("mean_k").alias("mean5_z")))
query("j7_join_ahead", "SELECT flow_id, t, status3 AS ahead, t_future AS t_ahead FROM ahead")(lambda c: J.join_ahead(c.lab, 3, "status_now").select("flow_id", "t", "ahead", "t_ahead"))
query("j8_lookup_at", "SELECT flow_id, t, status3 AS found FROM fut WHERE status_future IS NOT NULL")(lambda c: J.lookup_at(c.fut).select("flow_id", "t", "found"))
query("j9_count_between", "SELECT f.flow_id, f.t, count(*) AS n_between FROM fut f JOIN fut g ON f.flow_id = g.flow_id AND g.t > f.t AND g.t <= f.t_future WHERE f.status_future IS NOT NULL GROUP BY f.flow_id, f.t")(lambda c: J.count_between(c.fut))
query("j10_last_before", f"SELECT flow_id, max(t) AS t, arg_max(status_now, t) AS status_now FROM lab WHERE t <= {AT} GROUP BY flow_id")(lambda c: J.last_before(c.lab, c.instant))
query("j11_last_verified", f"SELECT flow_id, arg_max(t, t_future) AS t, arg_max(status_future, t_future) AS status_future FROM fut WHERE status_future IS NOT NULL AND t_future <= {AT} GROUP BY flow_id")(lambda c: J.last_before(c.fut.where("status_future IS NOT NULL"), c.instant, "t_future", ("t", "status_future")))
query("j12_as_of_join", "SELECT a.flow_id, a.t + INTERVAL 30 MINUTES AS instant, b.t, b.status_now FROM lab a ASOF JOIN lab b ON a.flow_id = b.flow_id AND a.t + INTERVAL 30 MINUTES >= b.t")(lambda c: J.as_of_join(c.lab.select("flow_id", (F.col("t") + F.expr("INTERVAL 30 MINUTES")).alias("instant")), c.lab))
query("j13_restrict", "SELECT s_suppkey AS probe, n_name AS country, l_orderkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 1")(
    lambda c: J.restrict(c.table("lineitem").select("l_orderkey", F.col("l_suppkey").alias("probe")), c.table("supplier").select(F.col("s_suppkey").alias("probe"), F.col("s_nationkey").alias("destination")), c.table("nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("destination"), F.col("n_name").alias("country"))).select("probe", "country", "l_orderkey")
)
query("j14_compare_tables", "SELECT flow_id, t, CASE WHEN t < (SELECT min(t) FROM meas) + INTERVAL 48 HOURS THEN 'only_a' ELSE 'differs' END AS why FROM meas WHERE t < (SELECT min(t) FROM meas) + INTERVAL 48 HOURS OR rtt > 90")(
    lambda c: J.compare_tables(c.meas, S.later_than_first(c.meas, 48).withColumn("rtt", F.when(F.col("rtt") > 90, F.col("rtt") + 1).otherwise(F.col("rtt"))), ["flow_id", "t"], ["rtt", "jitter"], 1e-9)
)
query("j15_present_in_all", "SELECT c_nationkey FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_nationkey HAVING count(DISTINCT o_orderpriority) = 5")(lambda c: J.present_in_all(c.table("orders").join(c.table("customer"), F.col("o_custkey") == F.col("c_custkey")), "c_nationkey", "o_orderpriority", 5))
query("j16_candidates", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) AND s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_discount < 0.005)")(
    lambda c: J.candidates(c.table("supplier"), c.table("nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("s_nationkey")), c.table("lineitem").where("l_quantity > 49 AND l_discount < 0.005").select(F.col("l_suppkey").alias("s_suppkey")), "s_suppkey", "s_nationkey")
)
_PLACES = "SELECT c.flow_id, h.hub AS place, h.lon, h.lat, o.lon AS from_lon, o.lat AS from_lat FROM card c JOIN hub o ON o.hub = CAST(c.flow_id AS INTEGER) % 25 JOIN hub h ON h.region = o.region"
query("j17_feasible", f"SELECT flow_id, place, round(rtt_min, 6) AS rtt_min FROM (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY rtt_min, place) AS k, bool_or(rtt_min <= median) OVER (PARTITION BY flow_id) AS any_ok FROM (SELECT a.flow_id, a.place, c.median, 2 * {KM} / 200.0 AS rtt_min FROM (SELECT flow_id, place, from_lon AS lon, from_lat AS lat, lon AS blon, lat AS blat FROM ({_PLACES})) a JOIN (SELECT hub, lon, lat FROM hub) b ON b.hub = a.place JOIN card c ON c.flow_id = a.flow_id WHERE NOT c.insufficient)) WHERE rtt_min <= median OR (NOT any_ok AND k = 1)")(lambda c: G.feasible_places(c.card, c.hubs).select("flow_id", "place", "rtt_min"))
query("j18_nearest", f"SELECT probe, arg_min(hub, km * 1000000 + hub) AS hub, round(min(km), 6) AS km FROM (SELECT a.probe, b.hub, {KM} AS km FROM probe a, hub b) GROUP BY probe")(lambda c: J.nearest(c.probes.select("probe", "lon", "lat"), c.hubs).select("probe", "hub", "km"))
query("j19_new_rows", "SELECT count(*) AS n FROM meas WHERE period = 'B'")(lambda c: J.new_rows(c.meas, c.meas.where("period = 'A'")).agg(F.count("*").alias("n")))

# Aggregations
query("a1_baseline_stats", f"SELECT flow_id, n_rows, n_valid, {_six('median0', 'iqr', 'jitter_typical', 'loss_typical', 'response_rate')} FROM stats")(lambda c: c.lines.withColumnRenamed("median", "median0").drop("route", "mad"))
query("a2_mad", f"SELECT flow_id, {_six('mad0')} FROM mads")(lambda c: c.lines.where("n_valid > 0").select("flow_id", F.col("mad").alias("mad0")))
query("a3_floor", f"SELECT flow_id, insufficient, {_six('median', 'mad', 'iqr')} FROM card")(lambda c: c.card.select("flow_id", "insufficient", "median", "mad", "iqr"))
query("a4_limits_by_route", "SELECT route, count(*) AS flows, round(quantile_cont(median, 0.5), 1) AS median, round(quantile_cont(median + 2 * s, 0.5), 1) AS limit_z_risk, round(quantile_cont(median + 3.5 * s, 0.5), 1) AS limit_z_fail, round(quantile_cont(median * 1.3, 0.5), 1) AS limit_increase_risk, round(quantile_cont(median * 1.8, 0.5), 1) AS limit_increase_fail FROM (SELECT *, CASE WHEN mad > 0 THEN 1.4826 * mad ELSE greatest(iqr / 1.349, 1.0) END AS s FROM card WHERE NOT insufficient) GROUP BY route")(lambda c: B.limits_by_route(c.card, P))
query("a5_block_counts", "SELECT block, count(*) AS n, count(*) FILTER (WHERE status_now = 'OK') AS n_ok, count(*) FILTER (WHERE status_now = 'RISK') AS n_risk, count(*) FILTER (WHERE status_now = 'FAIL') AS n_fail, min(t) AS first_t, max(t) AS last_t FROM blk GROUP BY block")(lambda c: E.block_counts(c.blk))
query("a6_distribution", "SELECT status_now, count(*) AS n, round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM lab), 6) AS share FROM lab GROUP BY status_now")(lambda c: E.distribution(c.lab, "status_now"))
query("a7_null_future_reasons", "SELECT CASE WHEN delta_s IS NULL THEN 'end_of_series' WHEN delta_s < 65000 THEN 'too_soon' WHEN delta_s > 152000 THEN 'too_late' ELSE 'has_future' END AS reason, count(*) AS n FROM fut GROUP BY 1")(lambda c: E.null_future_reasons(c.fut, P.gate))
query("a8_change_rate", "SELECT round(avg(CAST(status_now <> status_future AS INTEGER)), 6) AS change_rate FROM fut WHERE status_future IS NOT NULL")(lambda c: E.change_rate(c.fut))
query("a9_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")(lambda c: E.duplicate_keys(c.table("lineitem"), ["l_orderkey", "l_linenumber"]))
query("a10_coverage", "SELECT flow_id, count(*) AS bursts, CAST(sum(is_timeout) AS BIGINT) AS timeouts FROM meas GROUP BY flow_id")(lambda c: E.coverage(c.meas, "flow_id"))
query("a10_coverage_summary", "SELECT min(n) AS least, round(quantile_cont(n, 0.5), 6) AS middle, max(n) AS most FROM (SELECT count(*) AS n FROM meas GROUP BY flow_id)")(lambda c: E.coverage_summary(c.meas, "flow_id"))
query("a11_packet_totals", "SELECT CAST(sum(packets_sent) AS BIGINT) AS sent, CAST(sum(packets_received) AS BIGINT) AS received, count(*) FILTER (WHERE packets_received = 0) AS silent FROM bursts0")(lambda c: c.table("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("s"), F.count_if(F.col("l_discount") < 0.10).alias("r")).agg(F.sum("s").alias("sent"), F.sum("r").alias("received"), F.count_if(F.col("r") == 0).alias("silent")))
query("a12_null_profile", "SELECT 'rtt' AS \"column\", count(*) FILTER (WHERE rtt IS NULL) AS nulls FROM feat UNION ALL SELECT 'jitter', count(*) FILTER (WHERE jitter IS NULL) FROM feat UNION ALL SELECT 'min5_z', count(*) FILTER (WHERE min5_z IS NULL) FROM feat")(lambda c: E.null_profile(c.feat.select("rtt", "jitter", "min5_z")))
query("a13_median_of_medians", "SELECT round(quantile_cont(median, 0.5), 6) AS median_of_medians FROM card")(lambda c: B.median_of_medians(c.card))
query("a14_confusion", "SELECT truth, pred, n FROM cm")(lambda c: E.confusion(c.fut, "status_future", "rule_pred"))
query("a15_class_metrics", f"SELECT class, {_six('precision', 'recall', 'f1')}, support FROM f1s")(lambda c: E.class_metrics(E.confusion(c.fut, "status_future", "rule_pred")))
_SUM = "SELECT (SELECT round(avg(f1), 6) FROM f1s) AS macro_f1, (SELECT round(avg(recall), 6) FROM f1s) AS balanced_accuracy, (SELECT round(sum(CASE WHEN truth = pred THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE), 6) FROM cm) AS accuracy, (SELECT CAST(sum(n) AS BIGINT) FROM cm) AS n"
query("a16_summary_metrics", _SUM)(lambda c: E.summary_metrics(E.confusion(c.fut, "status_future", "rule_pred")))
query("a17_transitions", "SELECT a.class AS now, b.class AS future, count(f.flow_id) AS n, count(*) FILTER (WHERE f.rule_pred = f.status_future) AS hits, round(count(*) FILTER (WHERE f.rule_pred = f.status_future) / nullif(CAST(count(f.flow_id) AS DOUBLE), 0), 6) AS accuracy FROM classes a CROSS JOIN classes b LEFT JOIN fut f ON f.status_now = a.class AND f.status_future = b.class GROUP BY 1, 2")(lambda c: E.transitions(c.fut, "rule_pred"))
query("a17_change_split", "SELECT status_now <> status_future AS changes, count(*) AS n, round(avg(CAST(rule_pred = status_future AS INTEGER)), 6) AS accuracy FROM fut WHERE status_future IS NOT NULL GROUP BY 1")(lambda c: E.change_split(c.fut, "rule_pred"))
_BY_REGION = "SELECT r.region, k.class, CAST(count(*) FILTER (WHERE status_future = class AND rule_pred = class) AS DOUBLE) AS hit, count(*) FILTER (WHERE rule_pred = class) AS said, count(*) FILTER (WHERE status_future = class) AS support FROM (SELECT DISTINCT region FROM fut WHERE status_future IS NOT NULL) r CROSS JOIN classes k LEFT JOIN fut ON fut.region = r.region AND status_future IS NOT NULL GROUP BY 1, 2"
_BY_REGION = f"SELECT *, coalesce(hit / nullif(said, 0), 0.0) AS precision, coalesce(hit / nullif(support, 0), 0.0) AS recall, coalesce(2 * hit / nullif(said + support, 0), 0.0) AS f1 FROM ({_BY_REGION})"
query("a18_metrics_by_region", f"SELECT region, round(avg(f1), 6) AS macro_f1, round(avg(recall), 6) AS balanced_accuracy, round(sum(hit) / sum(support), 6) AS accuracy, CAST(sum(support) AS BIGINT) AS n FROM ({_BY_REGION}) GROUP BY region")(lambda c: E.summary_metrics(E.confusion(c.fut, "status_future", "rule_pred", ("region",)), ("region",)).select("region", "macro_f1", "balanced_accuracy", "accuracy", "n"))
query("a18_classes_by_region", f"SELECT region, class, {_six('precision', 'recall', 'f1')}, CAST(support AS BIGINT) AS support FROM ({_BY_REGION})")(lambda c: E.class_metrics(E.confusion(c.fut, "status_future", "rule_pred", ("region",)), ("region",)))
query("a19_metrics_long", "SELECT 'precision' AS metric, class, round(precision, 6) AS value FROM f1s UNION ALL SELECT 'recall', class, round(recall, 6) FROM f1s UNION ALL SELECT 'f1', class, round(f1, 6) FROM f1s UNION ALL SELECT 'support', class, CAST(support AS DOUBLE) FROM f1s UNION ALL SELECT 'macro_f1', 'all', round(avg(f1), 6) FROM f1s UNION ALL SELECT 'balanced_accuracy', 'all', round(avg(recall), 6) FROM f1s UNION ALL SELECT 'accuracy', 'all', round(sum(CASE WHEN truth = pred THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE), 6) FROM cm")(lambda c: E.metrics_long(E.confusion(c.fut, "status_future", "rule_pred")))
_MODELS = "SELECT m.model, status_now, status_future, CASE m.model WHEN 'rule' THEN rule_pred ELSE persistence_pred END AS said FROM fut CROSS JOIN (SELECT unnest(['rule', 'persistence']) AS model) m WHERE status_future IS NOT NULL"
_MODELS_BY_CLASS = f"SELECT x.model, class, CAST(count(*) FILTER (WHERE status_future = class AND said = class) AS DOUBLE) AS hit, count(*) FILTER (WHERE said = class) AS n_said, count(*) FILTER (WHERE status_future = class) AS support FROM ({_MODELS}) x CROSS JOIN classes GROUP BY 1, 2"
query(
    "a20_compare_models",
    f"SELECT a.model, a.macro_f1, a.balanced_accuracy, a.accuracy, a.n, a.f1_fail, a.recall_fail, b.accuracy_changed FROM (SELECT model, round(avg(f1), 6) AS macro_f1, round(avg(recall), 6) AS balanced_accuracy, round(sum(hit) / sum(support), 6) AS accuracy, CAST(sum(support) AS BIGINT) AS n, round(max(f1) FILTER (WHERE class = 'FAIL'), 6) AS f1_fail, round(max(recall) FILTER (WHERE class = 'FAIL'), 6) AS recall_fail FROM (SELECT *, coalesce(hit / nullif(support, 0), 0.0) AS recall, coalesce(2 * hit / nullif(n_said + support, 0), 0.0) AS f1 FROM ({_MODELS_BY_CLASS})) GROUP BY model) a JOIN (SELECT model, round(avg(CAST(said = status_future AS INTEGER)) FILTER (WHERE status_now <> status_future), 6) AS accuracy_changed FROM ({_MODELS}) GROUP BY model) b ON a.model = b.model",
)(lambda c: MD.compare_models({"rule": c.fut.withColumn("model_pred", F.col("rule_pred")), "persistence": c.fut.withColumn("model_pred", F.col("persistence_pred"))}))

_FLOWS = "SELECT flow_id, row_number() OVER (ORDER BY flow_id) - 1 AS no, count(*) AS n_rows, {0} FROM fut WHERE status_future IS NOT NULL GROUP BY flow_id"
_FLOW_SUMS = ", ".join(f"count(*) FILTER (WHERE status_future = '{k}') AS s_{k}, " + ", ".join(f"count(*) FILTER (WHERE status_future = '{k}' AND {p} = '{k}') AS h{m}_{k}, count(*) FILTER (WHERE {p} = '{k}') AS d{m}_{k}" for m, p in (("a", "rule_pred"), ("b", "persistence_pred"))) for k in ("OK", "RISK", "FAIL"))
_FLOWS = _FLOWS.format(_FLOW_SUMS)
_DRAWS = f"SELECT b AS resample, CAST('0x' || substr(md5(b || ':' || i), 1, 8) AS BIGINT) % n AS no FROM (SELECT count(*) AS n FROM ({_FLOWS})) f, range(0, {{0}}) r(b), range(0, 1000000) d(i) WHERE i < n"
_MACRO = lambda m: "(" + " + ".join(f"coalesce(2.0 * sum(h{m}_{k}) / nullif(sum(d{m}_{k}) + sum(s_{k}), 0), 0)" for k in ("OK", "RISK", "FAIL")) + ") / 3"
query("a22_bootstrap", f"SELECT round(quantile_cont(diff, 0.025), 6) AS low, round(quantile_cont(diff, 0.975), 6) AS high, count(*) AS resamples FROM (SELECT resample, {_MACRO('a')} - {_MACRO('b')} AS diff FROM ({_DRAWS.format(2_000)}) d JOIN ({_FLOWS}) f ON d.no = f.no GROUP BY resample)")(lambda c: E.bootstrap_ci(c.fut, "rule_pred", "persistence_pred", 2_000))
query("a23_scoreboard", f"SELECT count(*) AS verified, count(*) FILTER (WHERE rule_pred = status_future) AS hits, count(*) FILTER (WHERE status_now = status_future) AS persistence_hits FROM fut WHERE status_future IS NOT NULL AND t_future <= {AT}")(lambda c: E.scoreboard(c.fut, c.instant, "rule_pred"))
query("a24_counters", f"SELECT count(*) AS n, count(*) FILTER (WHERE status_now = 'OK') AS n_ok, count(*) FILTER (WHERE status_now = 'RISK') AS n_risk, count(*) FILTER (WHERE status_now = 'FAIL') AS n_fail, count(*) FILTER (WHERE is_timeout = 1) AS n_timeout, count(*) FILTER (WHERE status_future IS NULL) AS n_without_future FROM fut WHERE t <= {AT}")(lambda c: E.counters(c.fut, c.instant))
_LAG = "SELECT flow_id, t, CAST(floor(epoch(t)) - floor(epoch(lag(t) OVER (PARTITION BY flow_id ORDER BY t))) AS BIGINT) AS delta_s FROM meas"
query("a25_typical_interval", f"SELECT flow_id, delta_s AS interval_s FROM (SELECT flow_id, delta_s, row_number() OVER (PARTITION BY flow_id ORDER BY delta_s, t) AS r, count(*) OVER (PARTITION BY flow_id) AS n FROM ({_LAG}) WHERE delta_s IS NOT NULL) WHERE r = n // 2 + 1")(lambda c: E.typical_interval(c.meas))
query("a26_crosstab", "SELECT period, region, count(*) AS n FROM meas GROUP BY 1, 2")(lambda c: E.crosstab(c.meas, "period", "region"))
query("a27_single_valued", "SELECT c_nationkey, count(DISTINCT c_mktsegment) AS n_c_mktsegment FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1")(lambda c: E.single_valued(c.table("customer"), "c_nationkey", ["c_mktsegment"]))
query("a28_infeasible", f"SELECT region, count(*) AS n, round(min(km), 6) AS km_min, round(max(km), 6) AS km_max, count(*) FILTER (WHERE median < rtt_min) AS impossible FROM (SELECT *, 2 * km / 200.0 AS rtt_min FROM (SELECT c.median, b.region, {KM} AS km FROM card c JOIN hub a ON a.hub = CAST(c.flow_id AS INTEGER) % 25 JOIN hub b ON b.hub = (CAST(c.flow_id AS INTEGER) * 7 + 3) % 25 WHERE NOT c.insufficient)) GROUP BY region")(lambda c: G.infeasible(G.with_endpoints(c.card, c.hubs)))
query("a29_distinct", "SELECT count(DISTINCT flow_id) AS flows, count(DISTINCT period) AS periods FROM meas")(lambda c: c.meas.agg(F.count_distinct("flow_id").alias("flows"), F.count_distinct("period").alias("periods")))

# Windows
for _n, _c in (("w1_n5_timeout", "n5_timeout"), ("w2_n5_increase80", "n5_increase80"), ("w3_n5_moderate", "n5_moderate")):
    query(_n, f"SELECT flow_id, t, {_c} FROM feat")(lambda c, _c=_c: c.feat.select("flow_id", "t", _c))
for _n, _c in (("w4_trend", "trend"), ("w5_persistence", "persistence"), ("w6_min5_z", "min5_z"), ("w7_mean5_z", "mean5_z")):
    query(_n, f"SELECT flow_id, t, {_six(_c)} FROM feat")(lambda c, _c=_c: c.feat.select("flow_id", "t", _c))
query("w8_status_future", "SELECT flow_id, t, status_future FROM fut")(lambda c: c.fut.select("flow_id", "t", "status_future"))
query("w9_t_future", "SELECT flow_id, t, t_future FROM fut")(lambda c: c.fut.select("flow_id", "t", "t_future"))
query("w10_future_block", "SELECT flow_id, t, lead(block, 3) OVER (PARTITION BY flow_id ORDER BY t) AS future_block FROM blk")(lambda c: L.future_block(c.blk, 3).select("flow_id", "t", "future_block"))
query("w11_gap", "SELECT block, in_gap, count(*) AS n FROM gapped GROUP BY 1, 2")(lambda c: L.gap_flag(c.blk, 3).groupBy("block", "in_gap").agg(F.count("*").alias("n")))
query("w12_row_no", "SELECT flow_id, t, CAST(row_number() OVER (PARTITION BY flow_id ORDER BY t) AS INTEGER) AS row_no FROM meas")(lambda c: J.numbered(c.meas).select("flow_id", "t", "row_no"))
query("w13_top1_per", "SELECT status_now, flow_id, t FROM (SELECT *, row_number() OVER (PARTITION BY status_now ORDER BY rtt DESC NULLS LAST, flow_id, t) AS k FROM lab) WHERE k = 1")(lambda c: E.top1_per(c.lab, ["status_now"], [F.col("rtt").desc_nulls_last(), F.col("flow_id"), F.col("t")]).select("status_now", "flow_id", "t"))
query("w14_score_curve", "SELECT region, flow_id, t_future, count(*) OVER w AS verified, CAST(sum(CASE WHEN rule_pred = status_future THEN 1 ELSE 0 END) OVER w AS BIGINT) AS hits FROM fut WHERE status_future IS NOT NULL WINDOW w AS (PARTITION BY region ORDER BY t_future, flow_id, t ROWS UNBOUNDED PRECEDING)")(lambda c: E.score_curve(c.fut, "rule_pred"))
query("w14_global_curve", "SELECT bucket, CAST(sum(n) OVER (ORDER BY bucket) AS BIGINT) AS verified, CAST(sum(h) OVER (ORDER BY bucket) AS BIGINT) AS hits FROM (SELECT CAST(floor(floor(epoch(t_future)) / 86400) AS BIGINT) AS bucket, count(*) AS n, count(*) FILTER (WHERE rule_pred = status_future) AS h FROM fut WHERE status_future IS NOT NULL GROUP BY 1)")(lambda c: E.global_curve(c.fut, "rule_pred", 86_400))
query("w15_delta_s", f"SELECT flow_id, t, delta_s FROM ({_LAG})")(lambda c: c.meas.select("flow_id", "t", (X.epoch_s(F.col("t")) - X.epoch_s(F.lag("t").over(L._by_flow()))).alias("delta_s")))
query("w16_chunked_window", f"SELECT flow_id, t, n5_timeout, n5_increase80, n5_moderate, {_six('trend', 'persistence', 'min5_z', 'mean5_z')} FROM feat")(lambda c: FT.chunked_window(c.rel, P, 200_000).select("flow_id", "t", "n5_timeout", "n5_increase80", "n5_moderate", "trend", "persistence", "min5_z", "mean5_z"))

# Order and limits
_PICK = "SELECT * FROM (SELECT '{0}' AS example, flow_id, t, round(rtt, 6) AS rtt, round(robust_z, 6) AS robust_z, rule FROM lab WHERE {1} ORDER BY {2}, flow_id, t LIMIT 1)"
query("o1_pick_examples", " UNION ALL ".join(_PICK.format(*x) for x in (("ok", "status_now = 'OK' AND abs(robust_z) <= 1 AND n5_moderate = 0", "rtt DESC"), ("risk", "rule = 5 AND robust_z BETWEEN 2 AND 3.5", "abs(robust_z - 2.75)"), ("fail", "rule = 3 AND robust_z >= 4", "lab.rtt"))))(lambda c: E.pick_examples(c.lab))
query("o2_error_case", "SELECT flow_id, t, round(rtt, 6) AS rtt FROM fut WHERE median > (SELECT quantile_cont(median, 0.5) FROM card) AND status_future = 'OK' AND rule_pred = 'FAIL' AND rtt IS NOT NULL ORDER BY fut.rtt DESC, flow_id, t LIMIT 1")(lambda c: E.error_case(J.with_scalar(c.fut, B.median_of_medians(c.card)), "rule_pred", "OK", "FAIL", True, False, True))
query("o2_missed_failure", "SELECT flow_id, t, round(rtt, 6) AS rtt FROM fut WHERE median > (SELECT quantile_cont(median, 0.5) FROM card) AND status_future = 'FAIL' AND rule_pred = 'OK' AND rtt IS NOT NULL ORDER BY fut.rtt DESC, flow_id, t LIMIT 1")(lambda c: E.error_case(J.with_scalar(c.fut, B.median_of_medians(c.card)), "rule_pred", "FAIL", "OK", True, False, True))
query("o3_feed", f"SELECT flow_id, t, t_future FROM fut WHERE status_future IS NOT NULL AND t_future <= {AT} AND rule_pred <> status_future ORDER BY t_future DESC, flow_id, t DESC LIMIT 20")(lambda c: E.feed(c.fut, c.instant, 20, "rule_pred").select("flow_id", "t", "t_future"))
query("o4_page", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 100")(lambda c: E.page(c.table("events").select("event_id", "ts"), 3, 50, [F.desc("ts"), F.desc("event_id")]))
query("o5_ordered", "SELECT flow_id, t, rule FROM lab ORDER BY t, flow_id")(lambda c: c.lab.select("flow_id", "t", "rule").orderBy("t", "flow_id"))
query("o6_peek", "SELECT event_id, ts, round(value, 6) AS value FROM events ORDER BY events.value DESC, event_id LIMIT 25")(lambda c: c.table("events").select("event_id", "ts", "value").orderBy(F.desc("value"), "event_id").limit(25))
query("o7_choose", "SELECT flow_id, n_rows FROM card WHERE n_valid >= (SELECT max(n_valid) FROM card) - 5 ORDER BY n_rows, flow_id, n_valid DESC LIMIT 1")(lambda c: E.choose(c.card.select("flow_id", "n_rows", "n_valid"), "n_valid", ["n_rows", "flow_id"], 5).select("flow_id", "n_rows"))
query("o8_parity_sample", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY sha256(CAST(event_id AS VARCHAR)), event_id) AS k FROM events) WHERE k <= 70")(lambda c: E.parity_sample(c.table("events").select("event_type", "event_id"), "event_type", 70, "event_id"))
query("o9_sample_keys", "SELECT user_id FROM (SELECT DISTINCT user_id FROM events) ORDER BY sha256('7|' || CAST(user_id AS VARCHAR)), user_id LIMIT 10")(lambda c: E.sample_keys(c.table("events"), "user_id", 10, "7"))

# Sets
query("u1_dedup_exact", "SELECT count(*) AS n FROM (SELECT DISTINCT flow_id, t, rtt FROM meas)")(lambda c: M.dedup_exact(c.meas.select("flow_id", "t", "rtt").unionByName(c.meas.where("period = 'A'").select("flow_id", "t", "rtt"))).agg(F.count("*").alias("n")))
query("u2_dedup_key", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k FROM lineitem) WHERE k = 1")(lambda c: M.dedup_key(c.table("lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey"))
query("u3_append", "SELECT period, count(*) AS n FROM (SELECT period FROM meas UNION ALL SELECT period FROM meas) GROUP BY period")(lambda c: c.meas.select("period").unionByName(c.meas.select("period")).groupBy("period").agg(F.count("*").alias("n")))
query("u4_common_ids", "SELECT flow_id FROM meas WHERE period = 'A' INTERSECT SELECT flow_id FROM meas WHERE period = 'B' INTERSECT SELECT flow_id FROM meas WHERE is_timeout = 1")(lambda c: J.common_ids(c.meas.where("period = 'A'").select("flow_id"), c.meas.where("period = 'B'").select("flow_id"), c.meas.where("is_timeout = 1").select("flow_id")))
query("u5_id_drift", "SELECT n_nationkey, 'a' AS side FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")(lambda c: J.id_drift(c.table("nation").select("n_nationkey"), c.table("supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey")), "n_nationkey"))
query("u6_disjoint", "SELECT count(*) AS shared FROM (SELECT flow_id, t FROM blk WHERE block = 'train' INTERSECT SELECT flow_id, t FROM blk WHERE block = 'validation')")(lambda c: J.overlap(c.blk.where("block = 'train'"), c.blk.where("block = 'validation'"), ["flow_id", "t"]).agg(F.count("*").alias("shared")))
query("u7_same_rows", "SELECT 'a' AS side, count(*) AS n FROM meas WHERE period = 'A'")(lambda c: J.different_rows(c.meas, c.meas.where("period = 'B'")).groupBy("side").agg(F.count("*").alias("n")))

# Scalar functions
query("f1_f6_burst_arrays", f"SELECT o_orderkey, {_six('rtt', 'jitter')} FROM om")(lambda c: c.bursts.withColumn("r", X.valid_rtts(F.col("pings"))).select("o_orderkey", X.array_mean(F.col("r")).alias("rtt"), X.mean_step(F.col("r")).alias("jitter")))
query("f7_strings", "SELECT n_name, 'net→' || n_name AS joined, split_part(n_name, ' ', 1) AS first_word FROM nation")(lambda c: c.table("nation").select("n_name", F.concat_ws("→", F.lit("net"), "n_name").alias("joined"), F.get(F.split("n_name", " "), 0).alias("first_word")))
query("f8_instant_text", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS text FROM events")(lambda c: c.table("events").select("event_id", X.instant_ms(F.col("ts")).alias("text")))
query("f9_iso_text", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS text FROM events")(lambda c: c.table("events").select("event_id", X.iso_utc(F.col("ts")).alias("text")))
query("f10_epochs", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, epoch_us(ts) AS us FROM events")(lambda c: c.table("events").select("event_id", X.epoch_s(F.col("ts")).alias("s"), X.epoch_us(F.col("ts")).alias("us")))
query("f11_interval", "SELECT event_id, ts + INTERVAL 108 HOURS AS later FROM events")(lambda c: c.table("events").select("event_id", (F.col("ts") + F.expr("INTERVAL 108 HOURS")).alias("later")))
query("f12_parse_iso", "SELECT event_id, date_trunc('second', ts) AS t FROM events")(lambda c: c.table("events").select("event_id", X.parse_iso_utc(X.iso_utc(F.col("ts"))).alias("t")))
query("f13_safe_divide", "SELECT event_id, round(100.0::DOUBLE / nullif(user_id % 3, 0), 6) AS ratio FROM events")(lambda c: c.table("events").select("event_id", F.try_divide(F.lit(100.0), F.col("user_id") % 3).alias("ratio")))
query("f14_math", "SELECT probe, round(sin(radians(lat)) + cos(radians(lon)) + sqrt(abs(lon)), 6) AS m, greatest(lon, lat) AS g FROM probe")(lambda c: c.probes.select("probe", (F.sin(F.radians("lat")) + F.cos(F.radians("lon")) + F.sqrt(F.abs("lon"))).alias("m"), F.greatest("lon", "lat").alias("g")))
query("f15_bands", "SELECT count(*) FILTER (WHERE rtt BETWEEN 30 AND 80) AS closed, count(*) FILTER (WHERE rtt >= 30 AND rtt < 80) AS half FROM meas")(lambda c: c.meas.agg(F.count_if(F.col("rtt").between(30, 80)).alias("closed"), F.count_if((F.col("rtt") >= 30) & (F.col("rtt") < 80)).alias("half")))
query("f16_nulls", "SELECT count(*) FILTER (WHERE rtt IS NULL) AS missing, count(*) FILTER (WHERE rtt IS DISTINCT FROM jitter) AS differ FROM meas")(lambda c: c.meas.agg(F.count_if(F.col("rtt").isNull()).alias("missing"), F.count_if(~F.col("rtt").eqNullSafe(F.col("jitter"))).alias("differ")))
query("f17_coercion", "SELECT c_custkey, try_cast(substr(c_name, 10) AS BIGINT) AS number, try_cast(c_mktsegment AS DOUBLE) AS no_number FROM customer")(lambda c: c.table("customer").select("c_custkey", F.expr("try_cast(substr(c_name, 10) AS BIGINT)").alias("number"), F.col("c_mktsegment").try_cast("double").alias("no_number")))
query("f18_decimal_comma", "SELECT event_id, round(value, 2) AS value FROM events")(lambda c: c.table("events").select("event_id", X.decimal_comma(F.regexp_replace(F.round("value", 2).cast("decimal(12,2)").cast("string"), r"\.", ",")).alias("value")))
query("f19_stable_pick", "SELECT c_custkey, CAST(CAST('0x' || substr(sha256(c_name), 1, 16) AS UBIGINT) % 7 AS INTEGER) AS pick FROM customer")(lambda c: c.table("customer").select("c_custkey", X.stable_pick(F.col("c_name"), 7).alias("pick")))
query("f20_stable_unit", "SELECT c_custkey, round(CAST('0x' || substr(sha256(c_name), 1, 8) AS BIGINT) / 4294967295.0 * 2 - 1, 6) AS dx, round(CAST('0x' || substr(sha256(c_name), 9, 8) AS BIGINT) / 4294967295.0 * 2 - 1, 6) AS dy FROM customer")(lambda c: c.table("customer").select("c_custkey", X.stable_unit(F.col("c_name")).alias("dx"), X.stable_unit(F.col("c_name"), 1).alias("dy")))
query("f21_json_parse", "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events")(lambda c: c.table("events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k")))
query("f22_json_emit", "SELECT flow_id, t, '{\"flow_id\":\"' || flow_id || '\",\"rtt\":' || coalesce(CAST(CAST(round(rtt) AS BIGINT) AS VARCHAR), 'null') || '}' AS json FROM meas")(lambda c: c.meas.select("flow_id", "t", F.to_json(F.struct("flow_id", F.round(F.nanvl("rtt", F.lit(None).cast("double"))).cast("long").alias("rtt")), {"ignoreNullFields": "false"}).alias("json")))
query("f21_parse_results", f"SELECT flow_id, t, {_six('rtt', 'jitter', 'loss_pct')}, is_timeout FROM om WHERE o_orderkey % 50 <> 0")(lambda c: S.parse_results(A.order_results(c.spark, c.sf_dir)))
query("f23_membership", "SELECT count(*) AS n FROM events WHERE event_type IN ('click', 'error')")(lambda c: c.table("events").where(F.col("event_type").isin("click", "error")).agg(F.count("*").alias("n")))

# Geography
query("g1_haversine", f"SELECT a.hub AS a_hub, b.hub AS b_hub, round({KM}, 6) AS km FROM hub a JOIN hub b ON a.region = b.region")(lambda c: G.pair_km(c.hubs).select("a_hub", "b_hub", "km"))
query("g2_path_km", f"SELECT a.region, round(coalesce(sum({KM}), 0), 6) AS km FROM (SELECT *, lead(hub) OVER (PARTITION BY region ORDER BY hub) AS next FROM hub) a JOIN hub b ON b.hub = a.next GROUP BY a.region")(lambda c: G.region_paths(c.hubs))
query("g3_min_rtt", f"SELECT a.hub AS a_hub, b.hub AS b_hub, round(2 * {KM} / 200.0, 6) AS rtt_min FROM hub a JOIN hub b ON a.region = b.region")(lambda c: G.pair_km(c.hubs).select("a_hub", "b_hub", X.min_rtt_ms(F.col("km")).alias("rtt_min")))
query("g4_impossible", f"SELECT c.flow_id FROM card c JOIN hub a ON a.hub = CAST(c.flow_id AS INTEGER) % 25 JOIN hub b ON b.hub = (CAST(c.flow_id AS INTEGER) * 7 + 3) % 25 WHERE NOT c.insufficient AND c.median < 2 * {KM} / 200.0")(lambda c: G.impossible_flows(G.with_endpoints(c.card, c.hubs)).select("flow_id"))
query("g6_valid_coords", "SELECT count(*) AS n FROM probe WHERE lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90")(lambda c: c.probes.where(X.valid_coords(F.col("lon"), F.col("lat"))).agg(F.count("*").alias("n")))

# Sources, checks
query("s9_slices", "SELECT CAST(k AS BIGINT) AS k, s0 + to_hours(12 * k) + to_seconds(k) AS slice_from, least(s0 + to_hours(12 * (k + 1)) + to_seconds(k), s1) AS slice_to FROM (SELECT min(ts) AS s0, max(ts) AS s1 FROM events), range(0, 10000) r(k) WHERE s0 + to_hours(12 * k) + to_seconds(k) <= s1")(lambda c: S.plan_slices(c.table("events").agg(F.min("ts").alias("start"), F.max("ts").alias("stop")), 12))
query("q_checks", " UNION ALL ".join(f"SELECT '{n}' AS \"check\", {s} AS offenders" for n, s in (("positive_rtt", "(SELECT count(*) FROM meas WHERE rtt <= 0)"), ("periods", "(SELECT count(*) FROM meas WHERE period NOT IN ('A', 'B'))"), ("unique_keys", "(SELECT count(*) FROM (SELECT 1 FROM meas GROUP BY flow_id, t HAVING count(*) > 1))"), ("no_period_a", "(SELECT count(*) FROM feat WHERE period = 'A')"), ("min_le_mean", "(SELECT count(*) FROM feat WHERE min5_z > mean5_z + 1e-9 OR min5_z > robust_z)"), ("rule_class", "(SELECT count(*) FROM lab WHERE rule IS NULL OR rule NOT BETWEEN 1 AND 6 OR (status_now = 'FAIL') <> (rule <= 4) OR (status_now = 'RISK') <> (rule = 5))"), ("loss_is_fail", "(SELECT count(*) FROM lab WHERE loss_pct >= 10 AND status_now <> 'FAIL')"), ("rule3_both", "(SELECT count(*) FROM lab WHERE rule = 3 AND NOT (robust_z >= 3.5 AND increase_pct >= 30))"), ("ok_not_extreme", "(SELECT count(*) FROM lab WHERE status_now = 'OK' AND robust_z >= 3.5 AND increase_pct >= 30)"), ("future_in_gate", "(SELECT count(*) FROM fut WHERE (status_future IS NOT NULL) <> coalesce(delta_s BETWEEN 65000 AND 152000, false))"))))(lambda c: C.run_all(C.chain_checks(c.meas, c.fut, P)))


def _plain_and_seeded(offenders: Callable[[DataFrame], DataFrame], plain: DataFrame, seeded: DataFrame) -> DataFrame:
    """A check's offenders in the table as it is and in one with faults put in."""
    counts = (offenders(df).agg(F.lit(name).alias("rows"), F.count("*").alias("offenders")) for name, df in (("plain", plain), ("seeded", seeded)))
    return reduce(DataFrame.unionByName, counts)


_SEEDED = "CAST(flow_id AS INTEGER) % 7 = 0"
query("q8_window_mismatches", f"SELECT 'plain' AS rows, 0::BIGINT AS offenders UNION ALL SELECT 'seeded', count(*) FROM feat WHERE {_SEEDED} AND min5_z IS NOT NULL")(lambda c: _plain_and_seeded(lambda df: U.window_mismatches(df, P), c.feat, c.feat.withColumn("min5_z", F.when(F.expr(_SEEDED), F.col("min5_z") + 1).otherwise(F.col("min5_z")))))
query("q9_labelled_account", "SELECT (SELECT count(*) FROM feat) AS rows_in, (SELECT count(*) FROM lab) AS rows_out, CAST(1 AS INTEGER) AS n_missing, CAST(2 AS INTEGER) AS n_undeclared")(lambda c: U.labelled_account(c.feat, c.lab, (*c.feat.columns, "ghost")).select("rows_in", "rows_out", F.size("missing").alias("n_missing"), F.size("undeclared").alias("n_undeclared")))
query("q13_future_by_join", f"SELECT 'plain' AS rows, 0::BIGINT AS offenders UNION ALL SELECT 'seeded', count(*) FROM fut WHERE {_SEEDED} AND status_future <> 'OK'")(lambda c: _plain_and_seeded(lambda df: C.future_by_join(df, P), c.fut, c.fut.withColumn("status_future", F.when(F.expr(_SEEDED) & F.col("status_future").isNotNull(), "OK").otherwise(F.col("status_future")))))
_MOVED = "SELECT *, CASE WHEN epoch_us(t) % 5 = 0 THEN 'validation' ELSE block END AS moved FROM blk"
_MOVED = f"SELECT *, lead(moved, 3) OVER (PARTITION BY flow_id ORDER BY t) AS moved3, row_number() OVER (PARTITION BY flow_id, moved ORDER BY t DESC) AS back FROM ({_MOVED})"
query("q16_future_same_block", f"SELECT 'plain' AS rows, 0::BIGINT AS offenders UNION ALL SELECT 'seeded', count(*) FROM ({_MOVED}) WHERE status_future IS NOT NULL AND moved <> 'test' AND back > 3 AND moved <> moved3")(lambda c: _plain_and_seeded(lambda df: C.future_leaves_block(df, 3), c.blk, c.blk.withColumn("block", F.when(X.epoch_us(F.col("t")) % 5 == 0, "validation").otherwise(F.col("block")))))
_ENDS = "SELECT n.no, n.block, min(t) AS a, max(t) AS b, count(DISTINCT status_now) AS k FROM (SELECT unnest([0, 1, 2]) AS no, unnest(['train', 'validation', 'test']) AS block) n LEFT JOIN blk ON blk.block = n.block AND NOT (blk.block = 'validation' AND status_now = 'OK') GROUP BY 1, 2"
_FAULTS = f"SELECT *, lag(b) OVER (ORDER BY no) AS before FROM ({_ENDS})"
query("q14_block_order", f"SELECT block, 'absent' AS fault FROM ({_FAULTS}) WHERE a IS NULL UNION ALL SELECT block, 'overlaps' FROM ({_FAULTS}) WHERE a <= before UNION ALL SELECT block, 'lacks a class' FROM ({_FAULTS}) WHERE k < 3")(lambda c: U.block_order_faults(c.blk.where("block <> 'validation' OR status_now <> 'OK'")))
query("q14_block_order_seeded", "SELECT 'test' AS block, 'overlaps' AS fault")(lambda c: U.block_order_faults(c.blk.unionByName(c.blk.withColumn("block", F.when(F.col("block") == "train", "test").otherwise("validation")))).where("fault = 'overlaps'"))
query("q15_feature_faults", "SELECT 'robust_z' AS \"column\", 'nulls changed' AS fault FROM (SELECT count(*) AS n FROM fut WHERE robust_z IS NULL) WHERE n > 0 UNION ALL SELECT unnest(['is_timeout', 'n5_timeout', 'n5_increase80', 'n5_moderate']), 'not double'")(lambda c: U.feature_faults(c.fut.select(*MODEL_COLUMNS).na.fill(0, ["robust_z"]), c.fut, MODEL_COLUMNS))
query("q17_row_account", "SELECT count(*) AS rows, count(*) FILTER (WHERE status_future IS NULL) AS no_future, count(*) FILTER (WHERE status_future IS NOT NULL AND in_gap) AS in_gap, count(*) FILTER (WHERE status_future IS NOT NULL AND NOT in_gap) AS kept, 0::BIGINT AS balance FROM gapped")(lambda c: U.row_account(c.blk, 3))
query("q18_metrics_from_rows", f"SELECT class, {_six('precision', 'recall', 'f1')}, support FROM f1s")(lambda c: U.metrics_from_rows(c.fut, "status_future", "rule_pred"))
query("q18_metric_faults", "SELECT 0::BIGINT AS faults")(lambda c: U.metric_faults(c.fut, "status_future", "rule_pred").agg(F.count("*").alias("faults")))
_LOST = "SELECT count(*) FROM cm WHERE truth = 'FAIL' AND pred <> 'FAIL' AND n > 0 AND (SELECT h.n FROM cm h WHERE h.truth = cm.pred AND h.pred = cm.pred) > 0"
query("q18_metric_faults_seeded", f"SELECT 'plain' AS rows, 0::BIGINT AS offenders UNION ALL SELECT 'seeded', CAST(({_LOST}) + 2 * (SELECT CAST(sum(n) > 0 AS INTEGER) FROM cm WHERE truth = 'FAIL') AS BIGINT)")(
    lambda c: _plain_and_seeded(lambda cm: U.metric_faults(c.fut, "status_future", "rule_pred", cm=cm), m := E.confusion(c.fut, "status_future", "rule_pred"), m.withColumn("n", F.when(F.col("truth") == "FAIL", 0).otherwise(F.col("n"))))
)
_SEEDED_3 = "CAST(flow_id AS INTEGER) % 7 = 1"
query("q12_floor_faults", f"SELECT 'plain' AS rows, 0::BIGINT AS offenders UNION ALL SELECT 'seeded', count(*) FROM lab WHERE robust_z >= 3.5 AND (({_SEEDED} AND increase_pct >= 30) OR ({_SEEDED_3} AND coalesce(increase_pct < 30, true)))")(
    lambda c: _plain_and_seeded(lambda df: U.floor_faults(df, P), c.lab, c.lab.withColumn("rule", F.when(F.expr(_SEEDED), 6).when(F.expr(_SEEDED_3), 3).otherwise(F.col("rule"))))
)
query("q19_count_account", "SELECT unnest(['transitions', 'groups', 'rows']) AS part, n, hits FROM (SELECT count(*) AS n, count(*) FILTER (WHERE rule_pred = status_future) AS hits FROM fut WHERE status_future IS NOT NULL)")(lambda c: U.count_account(c.fut, "rule_pred"))
query("q20_choice_faults", "SELECT flow_id, 'simpler' AS fault FROM card, (SELECT max(n_valid) AS best FROM card), (SELECT n_rows AS simple FROM card ORDER BY n_valid DESC, flow_id LIMIT 1) WHERE n_valid >= best - 5 AND n_rows < simple")(lambda c: U.choice_faults(c.card, c.card.orderBy(F.desc("n_valid"), "flow_id").limit(1), "flow_id", "n_valid", "n_rows", 5))
query("q21_bootstrap_account", f"SELECT resample, count(*) AS draws, any_value(k) AS flows, CAST(sum(n_rows) AS BIGINT) AS rows, CAST(sum(n_rows) AS BIGINT) AS weighted_rows FROM ({_DRAWS.format(50)}) d JOIN ({_FLOWS}) f ON d.no = f.no, (SELECT count(*) AS k FROM ({_FLOWS})) GROUP BY resample")(lambda c: U.bootstrap_account(c.fut, 50))
_PARSED = "SELECT flow_id, t, count(*) AS n, bool_or(rtt IS NOT NULL AND extract(second FROM t) = 7) AS moved FROM om WHERE o_orderkey % 50 <> 0 GROUP BY 1, 2"
query("q24_parse_parity", f"SELECT why, count(*) AS n FROM (SELECT CASE WHEN a.n IS NULL THEN 'only_b' WHEN a.n > 1 OR b.n > 1 THEN 'repeated' WHEN moved THEN 'differs' END AS why FROM ({_PARSED}) a RIGHT JOIN (SELECT flow_id, t, count(*) AS n FROM om GROUP BY 1, 2) b ON a.flow_id = b.flow_id AND a.t = b.t) WHERE why IS NOT NULL GROUP BY why")(
    lambda c: J.compare_tables(S.parse_results(A.order_results(c.spark, c.sf_dir)).withColumn("t", F.col("t").cast("timestamp_ntz")).withColumn("rtt", F.when(F.second("t") == 7, F.col("rtt") + 1).otherwise(F.col("rtt"))), c.orders, ["flow_id", "t"], ["rtt", "jitter", "loss_pct"], 1e-4, 1e-6).groupBy("why").agg(F.count("*").alias("n"))
)
query("q25_outside_block", "SELECT 'foreign' AS fault, count(*) AS n FROM blk WHERE block = 'test' HAVING count(*) > 0 UNION ALL SELECT 'repeated', count(*) FROM blk WHERE block = 'validation' AND is_timeout = 1 HAVING count(*) > 0")(lambda c: U.outside_block(c.blk.where("block <> 'train'").unionByName(c.blk.where("block = 'validation' AND is_timeout = 1")), c.blk, "validation").groupBy("fault").agg(F.count("*").alias("n")))
query("s11_replay_parts", "SELECT 'meta' AS part, 1::BIGINT AS n UNION ALL SELECT 'model', 2 UNION ALL SELECT 'flow', count(DISTINCT flow_id) FROM blk WHERE block = 'validation' UNION ALL SELECT 'rows', count(*) FROM (SELECT DISTINCT flow_id, floor(floor(epoch(t)) / 86400) FROM blk WHERE block = 'validation')")(lambda c: c.replay.groupBy("part").agg(F.count("*").alias("n")))
query("q26_replay_metrics", "SELECT a.class AS truth, b.class AS pred, count(f.flow_id) AS n FROM classes a CROSS JOIN classes b LEFT JOIN (SELECT * FROM blk WHERE block = 'validation') f ON f.status_future = a.class AND f.rule_pred = b.class GROUP BY 1, 2")(lambda c: E.confusion(S.read_replay(c.replay)[0], "status_future", "prediction"))
query("q31_replay_faults", "SELECT 'unknown flow' AS fault, count(*) AS n FROM blk WHERE block = 'validation' AND CAST(flow_id AS INTEGER) % 3 = 0 HAVING count(*) > 0")(lambda c: U.replay_faults(S.read_replay(c.replay)[0], S.read_replay(c.replay)[1].where("CAST(flow_id AS INT) % 3 <> 0")).select(F.explode("faults").alias("fault")).groupBy("fault").agg(F.count("*").alias("n")))
query("q4_expected_counts", "SELECT 'flows' AS name, count(DISTINCT flow_id) AS found, -1 AS expected FROM meas")(lambda c: C.expected_counts(c.meas, {"flows": -1}, {"flows": F.count_distinct("flow_id")}).select("name", "found", "expected"))
query("q29_model_rows", "SELECT count(*) AS n FROM events WHERE value > 60")(lambda c: C.model_row_errors(c.table("events").select(F.col("value").alias("robust_z"), F.when(F.col("value") > 60, 200.0).otherwise(50.0).alias("loss_pct"), F.lit(1.0).alias("is_timeout"), F.lit(2.0).alias("n5_timeout"))).where(F.size("errors") > 0).agg(F.count("*").alias("n")))
query("q30_strict_decode", "SELECT count(*) AS n FROM events")(lambda c: C.strict_decode(c.table("events").select(F.col("props").alias("json")), "k bigint").where(F.size("errors") == 0).agg(F.count("*").alias("n")))
query("m1_persistence", "SELECT flow_id, t, status_now AS persistence_pred FROM fut")(lambda c: c.fut.select("flow_id", "t", "persistence_pred"))
query("m3_weights", "SELECT status_now, CASE status_now WHEN 'FAIL' THEN 3.0 WHEN 'RISK' THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, count(*) AS n FROM lab GROUP BY 1, 2")(lambda c: C.weights(c.lab, "status_now", {"FAIL": 3.0, "RISK": 2.0, "OK": 1.0}).groupBy("status_now", "weight").agg(F.count("*").alias("n")))


# Models: what is certain of a fit on the rows of the train block, whatever its trees say.
_TRAIN = "block = 'train' AND status_future IS NOT NULL"


def _fitted(c: Chain, fit: Callable[..., object], **params) -> DataFrame:
    train = MD.prepare(c.model_rows.where(_TRAIN), MODEL_COLUMNS)
    return MD.score(fit(train, **params), MD.assemble(c.model_rows, MODEL_COLUMNS), "m", ("flow_id", "t"))


def _certain(scored: DataFrame) -> DataFrame:
    """Rows scored, rows with one of the classes, and rows whose probabilities sum to 1."""
    total = F.abs(F.col("p_ok") + F.col("p_risk") + F.col("p_fail") - 1) < 1e-6
    return scored.agg(F.count("*").alias("n"), F.count_if(F.col("model_pred").isin("OK", "RISK", "FAIL")).alias("n_class"), F.count_if(total).alias("n_sum"))


_CERTAIN = "SELECT count(*) AS n, count(*) AS n_class, count(*) AS n_sum FROM blk"
query("m4_tree_scores", _CERTAIN)(lambda c: _certain(_fitted(c, MD.fit_tree)))
query("m5_forest_scores", _CERTAIN)(lambda c: _certain(_fitted(c, MD.fit_forest, trees=10, depth=5)))
query("m6_boost_scores", "SELECT count(*) AS n, count(*) AS n_class, count(*) AS n_whole FROM blk")(lambda c: _fitted(c, MD.fit_boost, rounds=3, depth=3).agg(F.count("*").alias("n"), F.count_if(F.col("model_pred").isin("OK", "RISK", "FAIL")).alias("n_class"), F.count_if(F.abs(F.col("p_ok") + F.col("p_risk") + F.col("p_fail") - 1) < 1e-9).alias("n_whole")))
query("m7_grid", "SELECT unnest([2, 4]) AS depth, true AS learned, true AS gap_adds_up")(lambda c: MD.grid(MD.fit_tree, {"depth": [2, 4]}, MD.prepare(c.model_rows.where(_TRAIN), MODEL_COLUMNS), MD.prepare(c.model_rows.where("block = 'validation' AND status_future IS NOT NULL"), MODEL_COLUMNS)).select(F.col("depth").cast("int").alias("depth"), (F.col("f1_train") > 0).alias("learned"), (F.abs(F.col("f1_train") - F.col("f1_validation") - F.col("gap")) < 1e-9).alias("gap_adds_up")))
query("a21_importances", f"SELECT {len(MODEL_COLUMNS)}::BIGINT AS columns, 1.0::DOUBLE AS total")(lambda c: MD.importances(MD.fit_tree(MD.prepare(c.model_rows.where(_TRAIN), MODEL_COLUMNS)), MODEL_COLUMNS, "tree", c.model_rows).agg(F.count("*").alias("columns"), F.sum("importance").alias("total")))
query("m11_leaf_profile", f"SELECT count(*) AS n, true AS pure FROM blk WHERE {_TRAIN}")(lambda c: MD.leaf_profile(MD.score(MD.fit_tree(t := MD.prepare(c.model_rows.where(_TRAIN), MODEL_COLUMNS)), t, "m")).agg(F.sum("n").alias("n"), F.min((F.col("purity") > 1 / 3 - 1e-9) & (F.col("purity") <= 1)).alias("pure")))

query("m10_contrast", f"SELECT {len(MODEL_COLUMNS) + 6}::BIGINT AS columns, 1.0::DOUBLE AS total")(
    lambda c: MD.contrast(c.model_rows.where(_TRAIN), c.model_rows.where("block = 'validation'"), list(range(5)), depth=4)[1].agg(F.count("*").alias("columns"), F.sum("importance").alias("total"))
)
query("m12_scored_classes", "SELECT block, 'm' AS model_id, count(*) AS n, count(status_future) AS n_known FROM blk GROUP BY block")(
    lambda c: MD.score(MD.fit_boost(MD.prepare(c.model_rows.where(_TRAIN), MODEL_COLUMNS), rounds=2, depth=2), c.model_rows, "m", ("block",)).groupBy("block", "model_id").agg(F.count("model_pred").alias("n"), F.count("status_future").alias("n_known"))
)
query("m15_simple_tree", "SELECT block, count(*) AS n, true AS better_than_chance FROM blk GROUP BY block")(lambda c: MD.simple_tree(c.model_rows)[1].select("block", "n", (F.col("accuracy") > 1 / 3).alias("better_than_chance")))


# SQL text over named views
def _viewed(c: Chain, f: Callable[..., DataFrame], **params) -> DataFrame:
    V.register(c.spark, c.sf_dir, c)
    return f(c.spark, **params)


_BURST = "SELECT start_time, prb_id, dst_addr, destination_country, destination_region, CAST(1 AS BIGINT) AS msm_id, packets_sent, packets_received FROM (SELECT t AS start_time, om.*, b.packets_sent, b.packets_received FROM om JOIN bursts0 b ON b.o_orderkey = om.o_orderkey)"
query("sql_recent_bursts", f"SELECT start_time, prb_id, dst_addr, packets_sent, packets_received, round(CAST(packets_sent - packets_received AS DOUBLE) / packets_sent * 100, 2) AS loss_pct FROM ({_BURST}) WHERE start_time >= (SELECT max(t) FROM om) - INTERVAL 720 HOURS ORDER BY start_time DESC, prb_id, dst_addr, packets_sent, packets_received LIMIT 20")(lambda c: _viewed(c, V.recent_bursts, hours=720))
query("sql_regional_bursts", f"SELECT * FROM ({_BURST}) WHERE start_time >= (SELECT max(t) FROM om) - INTERVAL 700 DAYS AND prb_id IN (1, 3, 5, 8, 13) AND dst_addr IN ('1-URGENT', '5-LOW')")(
    lambda c: _viewed(c, V.regional_bursts, probes=[1, 3, 5, 8, 13], destinations=["1-URGENT", "5-LOW"], days=700).drop("pings")
)
query("sql_classes_by_route", "SELECT route, status_now, count(*) AS n, count(*) FILTER (WHERE status_now = status_future) AS n_same FROM blk GROUP BY 1, 2")(lambda c: _viewed(c, V.classes_by_route))
query("s9_ingested_slices", "SELECT CAST(k AS BIGINT) AS k, count(*) AS n FROM (SELECT floor((epoch(ts) - epoch(s0)) / (240 * 3600 + 1)) AS k FROM events, (SELECT min(ts) AS s0 FROM events) WHERE floor(epoch(ts)) - floor(epoch(s0)) - floor((epoch(ts) - epoch(s0)) / (240 * 3600 + 1)) * (240 * 3600 + 1) <= 240 * 3600) GROUP BY 1")(
    lambda c: S.in_slices(c.table("events").withColumn("t", F.col("ts")), "t", 240).groupBy("k").agg(F.count("*").alias("n"))
)


# Readers and writers, through the shared folder
def _through(c: Chain, write: Callable[[str], object], read: Callable[[str], DataFrame]) -> DataFrame:
    """What is read from a new path that was written to."""
    path = scratch(c.spark)
    write(path)
    return read(path)


query("s1_snapshot", "SELECT event_id, user_id, event_type, ts, round(value, 6) AS value FROM events")(lambda c: S.snapshot(c.spark, "parquet", {}, f"{c.sf_dir}/events.parquet", scratch(c.spark))[0].select("event_id", "user_id", "event_type", "ts", "value"))
query("s2_read_layer", f"SELECT flow_id, t, {_six('rtt')} FROM meas WHERE period = 'B'")(lambda c: _through(c, lambda path: S.write_layer(c.meas, path, ("period",)), lambda path: S.read_layer(c.spark, path, "the measurements")).where("period = 'B'").select("flow_id", "t", "rtt"))
query("s3_write_layer", "SELECT flow_id, t, rule, status_now FROM lab")(lambda c: S.write_layer(c.lab, scratch(c.spark)).select("flow_id", "t", "rule", "status_now"))
query("s4_report", "SELECT status_now, count(*) AS n, round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM lab), 6) AS share FROM lab GROUP BY status_now")(lambda c: _through(c, lambda path: S.write_report(E.distribution(c.lab, "status_now"), path), lambda path: S.read_csv(c.spark, path, "status_now string, n bigint, share double", ",")))
query("s5_typed_csv", "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_mktsegment AS segment, CASE WHEN c_acctbal >= 0 THEN round(CAST(c_acctbal AS DOUBLE), 6) END AS balance FROM customer")(
    lambda c: _through(
        c,
        lambda path: c.table("customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal").cast("string")).otherwise("overdrawn").alias("balance")).write.option("sep", ";").option("header", True).csv(path),
        lambda path: S.read_csv(c.spark, path, "c_custkey bigint, segment string, balance double"),
    )
)
query("s6_probe_dim", "SELECT CAST(probe AS BIGINT) AS prb_id, lon AS longitude, lat AS latitude, CAST(nation AS VARCHAR) AS country, CAST(probe % 97 AS BIGINT) AS asn FROM probe")(
    lambda c: _through(
        c,
        lambda path: c.probes.select(F.col("probe").alias("prb_id"), F.col("lon").alias("longitude"), F.col("lat").alias("latitude"), F.col("nation").alias("country"), (F.col("probe") % 97).alias("asn")).write.option("header", True).csv(path),
        lambda path: S.read_probe_dim(c.spark, path),
    )
)
query("s8_raw_record", "SELECT count(*) AS rows, count(DISTINCT flow_id) AS flows, min(t) AS first_t, max(t) AS last_t, count(*) - count(DISTINCT (flow_id, t)) AS repeats FROM om WHERE o_orderkey % 50 <> 0")(lambda c: S.land_raw(A.order_results(c.spark, c.sf_dir), scratch(c.spark)))


# Models saved, compared and explained
def _leaf_check(c: Chain) -> DataFrame:
    """Rows whose leaf isn't the one that the rules of the fitted tree's leaves say."""
    rows = MD.prepare(c.model_rows.where(_TRAIN), MODEL_COLUMNS)
    model = MD.fit_tree(rows)
    rules = U.leaf_rules(model, list(MODEL_COLUMNS), scratch(c.spark), c.model_rows)
    scored = model.transform(rows).select("flow_id", "t", "leaf", vector_to_array("features").alias("features"))
    return _plain_and_seeded(lambda df: U.leaf_faults(df, rules), scored, scored.withColumn("leaf", F.when(F.expr(_SEEDED), F.col("leaf") + 1).otherwise(F.col("leaf"))))


def _families(c: Chain) -> DataFrame:
    """A tree and a forest on the same rows of the validation block."""
    train, rows = MD.prepare(c.model_rows.where(_TRAIN), MODEL_COLUMNS), MD.assemble(c.model_rows.where("block = 'validation'"), MODEL_COLUMNS)
    return MD.compare_models({"tree": MD.score(MD.fit_tree(train), rows, "tree"), "forest": MD.score(MD.fit_forest(train, trees=10, depth=5), rows, "forest")})


query("q22_leaf_faults", f"SELECT 'plain' AS rows, 0::BIGINT AS offenders UNION ALL SELECT 'seeded', count(*) FROM blk WHERE {_TRAIN} AND {_SEEDED}")(_leaf_check)
query("m9_families", "SELECT unnest(['tree', 'forest']) AS model, n, true AS in_range FROM (SELECT count(*) AS n FROM blk WHERE block = 'validation' AND status_future IS NOT NULL)")(lambda c: _families(c).select("model", "n", (F.col("macro_f1").between(0, 1) & (F.col("accuracy") > 1 / 3)).alias("in_range")))
query("m13_round_trip", "SELECT count(*) AS n, 0::BIGINT AS changed FROM blk")(
    lambda c: (rows := MD.assemble(c.model_rows, MODEL_COLUMNS)).agg(F.count("*").alias("n")).crossJoin(F.broadcast(MD.round_trip(MD.fit_tree(MD.prepare(c.model_rows.where(_TRAIN), MODEL_COLUMNS)), rows, scratch(c.spark)).agg(F.count("*").alias("changed"))))
)
