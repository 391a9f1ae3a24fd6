"""Edge rows of the measurement chain, sources and checks."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import exprs as X
from tidewatch.functions.params import Params
from tidewatch.operators import audits as U
from tidewatch.operators import baseline as B
from tidewatch.operators import checks as C
from tidewatch.operators import evaluate as E
from tidewatch.operators import features as FT
from tidewatch.operators import joins as J
from tidewatch.operators import labels as L
from tidewatch.operators import measurements as M
from tidewatch.sources import files as S

T = dt.datetime(2024, 1, 1)
P = Params(min_valid=2, baseline_hours=1)


def test_bursts(spark):
    pings = "array<struct<rtt:float,timeout:boolean>>"
    rows = [
        (1, [(0.0, True), (0.0, None)], 2, 0), (2, [(5.0, False)], 1, 1), (3, [(5.0, None), (9.0, True), (8.0, False)], 3, 2),
        (4, [(0.0, False)], 1, 1), (5, [], 0, 0), (6, None, None, None),
    ]
    df = spark.createDataFrame([(k, "d", 1, "c", "r", T, s, r, p) for k, p, s, r in rows], f"prb_id long, dst_addr string, msm_id long, destination_country string, destination_region string, start_time timestamp_ntz, packets_sent int, packets_received int, pings {pings}")
    got = {r.prb_id: (r.rtt, r.jitter, r.loss_pct, r.is_timeout) for r in M.measurements(df).collect()}
    assert got == {1: (None, None, 100.0, 1), 2: (5.0, None, 0.0, 0), 3: (6.5, 3.0, pytest.approx(100 / 3), 0), 4: (None, None, 0.0, 1), 5: (None, None, None, 1), 6: (None, None, None, 1)}


def test_scale_z_and_jitter(spark):
    rows = [(0.0, 2.0, 10.0, 10.0), (0.0, 2.0, 10.0, 11.0), (0.0, None, 10.0, 12.0), (1.0, 2.0, 10.0, None), (2.0, 2.0, 0.0, 5.0)]
    df = spark.createDataFrame(rows, "mad double, iqr double, median double, rtt double").select("*", X.robust_z(P).alias("z"), F.lit(None).cast("double").alias("jitter"), F.lit(0.0).alias("jitter_typical"))
    assert [r.z for r in df.collect()] == [0.0, pytest.approx(1 / (2 / 1.349)), 2.0, None, pytest.approx(5 / (2 * 1.4826))]
    j = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (None, 0.0), (3.0, 2.0), (3.0, None)], "jitter double, jitter_typical double")
    assert [r.x for r in j.select(X.jitter_ratio(P).alias("x")).collect()] == [1.0, 3.0, None, 1.5, None]


def test_rule_thresholds(spark):
    base = dict(loss_pct=0.0, n5_timeout=0, robust_z=0.0, increase_pct=0.0, n5_increase80=0, moderate=0, n5_moderate=0)
    cases = [({}, 6), ({"loss_pct": 10.0}, 1), ({"n5_timeout": 3}, 2), ({"robust_z": 3.5, "increase_pct": 30.0}, 3), ({"robust_z": 3.5, "increase_pct": 29.9}, 6), ({"n5_increase80": 2}, 4), ({"moderate": 1, "n5_moderate": 2}, 5), ({"moderate": 1, "n5_moderate": 1}, 6), ({"loss_pct": None, "robust_z": None, "increase_pct": None}, 6)]
    df = spark.createDataFrame([tuple({**base, **c}.values()) for c, _ in cases], "loss_pct double, n5_timeout int, robust_z double, increase_pct double, n5_increase80 int, moderate int, n5_moderate int")
    assert [r.r for r in df.select(X.rule_number(P).alias("r")).collect()] == [want for _, want in cases]
    no_floor = df.select(X.rule_number(Params(floor=None)).alias("r")).collect()
    assert no_floor[4].r == 3


def series(spark, gaps, statuses):
    t, rows = T, []
    for g, s in zip(gaps, statuses):
        t += dt.timedelta(seconds=g)
        rows.append(("f", t, s))
    return spark.createDataFrame(rows, "flow_id string, t timestamp_ntz, status_now string")


def test_horizon_gate(spark):
    for total, want in ((599, None), (600, "FAIL"), (840, "FAIL"), (841, None)):
        df = series(spark, [0, 200, 200, total - 400], ["OK", "OK", "OK", "FAIL"])
        assert L.future_labels(df, P).orderBy("t").first().status_future == want


def test_windows_and_null_counts(spark):
    rows = [("f", T + dt.timedelta(minutes=i), None, None, None, 0, 1, 1) for i in range(6)]
    df = spark.createDataFrame(rows, "flow_id string, t timestamp_ntz, rtt double, increase_pct double, robust_z double, moderate int, deviated int, is_timeout int").withColumn("median", F.lit(10.0))
    last = FT.window_features(df, P).orderBy(F.desc("t")).first()
    assert last.n5_increase80 is None and last.n5_timeout == 5 and last.min5_z is None and last.persistence == 1.0
    assert FT.window_features(df, P, null_as_zero=True).first().n5_increase80 == 0
    for size in (60, 100, 10_000):
        a = FT.window_features(df, P).orderBy("t").collect()
        b = FT.chunked_window(df, P, size).orderBy("t").collect()
        assert [tuple(r) for r in a] == [tuple(r) for r in b]


def test_floor_of_cards(spark):
    rows = [(f, T + dt.timedelta(seconds=i), 1.0 + i, 0.0, 0.0, "r", "A") for f, n in (("one", 1), ("two", 2), ("three", 3)) for i in range(n)]
    cards = {r.flow_id: r for r in B.baseline(spark.createDataFrame(rows, "flow_id string, t timestamp_ntz, rtt double, jitter double, loss_pct double, route string, period string"), P).collect()}
    assert cards["one"].insufficient and cards["one"].median is None and cards["one"].iqr == 0.0
    assert cards["two"].median == 1.5 and cards["three"].mad == 1.0


def test_gap_and_blocks(spark):
    df = series(spark, [0] + [60] * 9, ["OK"] * 10)
    blk = L.tag_block(df, (0.5, 0.7))
    assert [r.block for r in blk.orderBy("t").collect()] == ["train"] * 5 + ["validation"] * 2 + ["test"] * 3
    assert [r.in_gap for r in L.gap_flag(blk, 3).orderBy("t").collect()] == [False, False, True, True, True, True, True, False, False, False]


def test_metrics_with_absent_classes(spark):
    df = spark.createDataFrame([("OK", "OK"), ("OK", "RISK"), (None, "OK")], "status_future string, p string")
    cm = E.confusion(df, "status_future", "p")
    assert cm.count() == 9
    m = {r["class"]: (r.precision, r.recall, r.f1, r.support) for r in E.class_metrics(cm).collect()}
    assert m == {"OK": (1.0, 0.5, pytest.approx(2 / 3), 2), "RISK": (0.0, 0.0, 0.0, 0), "FAIL": (0.0, 0.0, 0.0, 0)}


def test_haversine(spark):
    r = spark.range(1).select(X.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)).alias("a"), X.haversine_km(F.lit(179.0), F.lit(0.0), F.lit(-179.0), F.lit(0.0)).alias("b")).first()
    assert r.a == pytest.approx(10007.54, abs=0.01) and r.b == pytest.approx(222.39, abs=0.01)


def test_results_csv_history_replay(spark, tmp_path):
    lines = [
        {"type": "ping", "prb_id": 1, "msm_id": 2, "dst_addr": "d", "timestamp": 1700000000, "sent": 3, "rcvd": 2, "result": [{"rtt": 2.0}, {"x": "*"}, {"rtt": 4.0}]},
        {"type": "trace", "sent": 1, "rcvd": 1}, {"type": "ping", "sent": 0, "rcvd": 0}, {"type": "ping", "sent": 1},
        {"type": "ping", "prb_id": 1, "msm_id": 2, "dst_addr": "d", "timestamp": 1700000240, "sent": 1, "rcvd": 0, "result": [{"error": "down"}]},
    ]
    df = spark.createDataFrame([(json.dumps(x),) for x in lines] + [("{broken",)], "value string")
    got = S.parse_results(df).orderBy("t").collect()
    assert [(r.flow_id, r.rtt, r.jitter, round(r.loss_pct, 3), r.is_timeout) for r in got] == [("1|d|2", 3.0, 2.0, 33.333, 0), ("1|d|2", None, None, 100.0, 1)]
    assert S.land_raw(df, f"{tmp_path}/raw").first().rows == 2
    (tmp_path / "x.csv").write_text("﻿a;b\n1;2,5\nx;<1 ms\n3;T\n", encoding="utf-8")
    read = S.read_csv(spark, f"{tmp_path}/x.csv", "a int, b string")
    assert [(r.a, r.v) for r in read.select("a", X.decimal_comma(F.col("b")).alias("v")).collect()] == [(1, 2.5), (None, 0.5), (3, None)]
    (tmp_path / "p.csv").write_text("prb_id,longitude,latitude,country,asn\n1,10,20,BR,5\n2,200,0,BR,\n")
    with pytest.raises(ValueError):
        S.read_probe_dim(spark, f"{tmp_path}/p.csv")
    history = spark.createDataFrame([(1.0, "OK", T)], "robust_z double, class string, created_utc timestamp")
    for _ in range(2):
        S.append_history(history, f"{tmp_path}/h")
    assert S.read_layer(spark, f"{tmp_path}/h", "scoring").count() == 2
    with pytest.raises(FileNotFoundError):
        S.read_layer(spark, f"{tmp_path}/none", "scoring")


def test_replay_documents(spark):
    rows = [("f", 1, T + dt.timedelta(hours=h), 2.0, 0, "OK", "RISK", "FAIL" if h < 40 else None, T + dt.timedelta(hours=h + 3)) for h in range(0, 50, 2)] + [("g", 2, T, None, 1, "FAIL", None, None, None)]
    df = spark.createDataFrame(rows, "flow_id string, region int, t timestamp_ntz, rtt double, is_timeout int, status_now string, prediction string, status_future string, t_future timestamp_ntz")
    model = spark.createDataFrame([("fixed", 0)], "model string, trees int")
    docs = S.export_replay(df, {"block": "validation"}, model).cache()
    assert {r.part: r.n for r in docs.groupBy("part").agg(F.count("*").alias("n")).collect()} == {"meta": 1, "model": 1, "flow": 2, "rows": 4}
    meta = json.loads(docs.where("part = 'meta'").first().document)
    assert (meta["block"], meta["rows"], meta["flows"], meta["first_t"]) == ("validation", 26, 2, "2024-01-01T00:00:00.000000")
    assert json.loads(docs.where("key LIKE 'g|%'").first().document)["rows"][0]["rtt"] is None
    back, flows = S.read_replay(docs)
    assert U.replay_faults(back, flows).count() == 0
    cols = ["flow_id", "t", "rtt", "status_now", "prediction", "status_future", "t_future"]
    assert J.different_rows(back.select(*cols), df.select(*cols)).count() == 0
    bad = back.withColumn("status_now", F.when(F.hour("t") == 2, "ODD").otherwise(F.col("status_now"))).withColumn("verifiable", F.col("verifiable") | (F.hour("t") == 4)).withColumn("in_order", F.hour("t") != 6).withColumn("t_future", F.when(F.hour("t") == 8, F.col("t")).otherwise(F.col("t_future")))
    found = {(r.flow_id, r.t.hour, tuple(r.faults)) for r in U.replay_faults(bad, flows.where("flow_id = 'f'")).collect() if r.t.day == 1}
    assert found == {("f", 2, ("class",)), ("f", 6, ("order",)), ("f", 8, ("time",)), ("g", 0, ("unknown flow",))}
    assert U.outside_block(back.unionByName(back.where("flow_id = 'g'")), df.withColumn("block", F.when(F.col("t") < F.lit("2024-01-02").cast("timestamp_ntz"), "a").otherwise("b")), "b").groupBy("fault").count().count() == 2


def test_iso_instants(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("2024-01-01T02:30:00+02:30",), ("2024-01-01 00:00:00",), (None,)], "text string")
    assert [r.x for r in df.select(X.parse_iso_utc(F.col("text")).alias("x")).collect()] == [T, T, T, None]
    with pytest.raises(Exception, match="not an ISO instant"):
        spark.createDataFrame([("yesterday",)], "text string").select(X.parse_iso_utc(F.col("text"))).collect()


def test_layers_reports_and_counts(spark, tmp_path):
    """Snapshot, small CSV, metric tables, expected counts, schemas, classes of a split, pages by key."""
    df = spark.createDataFrame([(i, "abc"[i % 3], float(i)) for i in range(9)], "k int, s string, v double")
    df.write.parquet(f"{tmp_path}/source")
    copy, source = S.snapshot(spark, "parquet", {}, f"{tmp_path}/source", f"{tmp_path}/copy")
    assert J.different_rows(copy, source).count() == 0 and C.same_schema(copy, source) == []
    assert C.same_schema(copy, source.select("k", F.col("v").cast("int").alias("v"))) == [("s", "string", None), ("v", "double", "int")]
    S.write_report(df.orderBy("k"), f"{tmp_path}/report")
    assert S.read_csv(spark, f"{tmp_path}/report", "k int, s string, v double", ",").count() == 9
    both = S.write_metrics({"a": df, "b": df.limit(2)}, f"{tmp_path}/metrics")
    assert {r.model: r["count"] for r in both.groupBy("model").count().collect()} == {"a": 9, "b": 2}
    counts = {"rows": F.count("*"), "kinds": F.count_distinct("s")}
    assert [tuple(r) for r in C.expected_counts(df, {"rows": 9, "kinds": 4}, counts).select("name", "found", "expected").collect()] == [("kinds", 3, 4)]
    split = spark.createDataFrame([("x", c) for c in ("OK", "RISK", "FAIL")] + [("y", "OK")], "block string, status string")
    assert [(r.block, sorted(r.missing)) for r in C.all_classes_present(split, "block", "status").collect()] == [("y", ["FAIL", "RISK"])]
    times = spark.createDataFrame([(T + dt.timedelta(seconds=i // 2), i) for i in range(10)], "t timestamp_ntz, k int")
    first = E.page_after(times, "t", "k", (T + dt.timedelta(seconds=99), 0), 3).collect()
    then = E.page_after(times, "t", "k", (first[-1].t, first[-1].k), 3).collect()
    assert [r.k for r in first + then] == [9, 8, 7, 6, 5, 4]


def test_audits_find_seeded_faults(spark):
    blk = spark.createDataFrame([("f", T + dt.timedelta(hours=i), "train" if i < 5 else "validation" if i < 7 else "test", ("OK", "RISK", "FAIL")[i % 3]) for i in range(10)], "flow_id string, t timestamp_ntz, block string, status_now string")
    assert [(r.block, r.fault) for r in U.block_order_faults(blk).orderBy("block").collect()] == [("validation", "lacks a class")]
    mixed = blk.withColumn("block", F.when(F.hour("t") == 3, "test").otherwise(F.col("block"))).where("block <> 'validation'")
    assert {(r.block, r.fault) for r in U.block_order_faults(mixed).collect()} == {("validation", "absent")}
    late = blk.withColumn("block", F.when(F.hour("t") == 1, "validation").otherwise(F.col("block")))
    assert ("validation", "overlaps") in {(r.block, r.fault) for r in U.block_order_faults(late).collect()}
    x = spark.createDataFrame([(1.0, 2, None), (None, 3, 1.0)], "a double, b int, c double")
    assert {(r["column"], r.fault) for r in U.feature_faults(x, x.na.fill(0, ["c"]), ("a", "b", "d")).collect()} == {("d", "missing"), ("c", "undeclared"), ("b", "not double"), ("c", "nulls changed")}
    results = spark.createDataFrame([("m1", 0.70, 1), ("m2", 0.71, 2), ("m3", 0.72, 3), ("m4", 0.5, 0)], "model string, f1 double, size int")
    best = lambda name: results.where(F.col("model") == name)
    faults = lambda name: {(r.model, r.fault) for r in U.choice_faults(results, best(name), "model", "f1", "size", 0.015).collect()}
    assert faults("m2") == set() and faults("m3") == {("m2", "simpler")} and faults("m4") == {("m4", "out of tolerance")}


def test_floor_read_from_values(spark):
    rows = [("high", 4.0, 40.0, 6), ("low", 4.0, 10.0, 3), ("none", 4.0, None, 3), ("loss", 4.0, 40.0, 1), ("right", 4.0, 40.0, 3), ("calm", 4.0, 10.0, 6), ("silent", None, None, 3)]
    lab = spark.createDataFrame(rows, "flow_id string, robust_z double, increase_pct double, rule int").withColumn("t", F.lit(0))
    found = lambda p: {(r.flow_id, r.fault) for r in U.floor_faults(lab, p).collect()}
    outside, below = "extreme outside rules 1 to 3", "rule 3 below the floor"
    assert found(P) == {("high", outside), ("low", below), ("none", below)}
    assert found(Params(floor=None)) == {("high", outside), ("calm", outside)}


def test_checks_and_decode(spark):
    df = spark.createDataFrame([(101.0, 2.0, 5.5, float("nan")), (50.0, 1.0, 5.0, 1.0), (None, None, None, None)], "loss_pct double, is_timeout double, n5_timeout double, robust_z double")
    assert [r.errors for r in C.model_row_errors(df).collect()] == [["loss_pct", "is_timeout", "n5_timeout", "robust_z"], [], []]
    text = spark.createDataFrame([('{"k": 1}',), ('{"k": 1, "z": 2}',), ('{"k": "x"}',), ("[1]",), ("{",)], "json string")
    assert [bool(r.errors) for r in C.strict_decode(text, "k bigint").collect()] == [False, True, True, True, True]
    check = C.Check("high", df, F.col("loss_pct") > 100)
    with pytest.raises(C.CheckFailed):
        C.enforce(check)
    assert C.enforce(check, "warn").count() == 1 and C.enforce(check, "quarantine").count() == 2
    with pytest.raises(ValueError):
        C.select_features(df, ("loss_pct",), ())


def test_parity_and_ties(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0), (3, 3.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0 + 1e-12), (2, 2.0), (4, 4.0)], "k int, v double")
    assert {r.k: r.why for r in J.compare_tables(a, b, ["k"], ["v"], 1e-9).collect()} == {2: "differs", 3: "only_a", 4: "only_b"}
    first = M.dedup_key(spark.createDataFrame([("x", 2, "late"), ("x", 1, "early")], "k string, seen int, v string"), ["k"], ["seen"]).first()
    assert first.v == "early"
    even = series(spark, [0, 10, 20, 30, 40], ["OK"] * 5)
    assert E.typical_interval(even).first().interval_s == 30
