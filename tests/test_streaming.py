import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewatch.functions.params import EVENT_PARAMS as P
from tidewatch.functions.params import Params
from tidewatch.operators import features as FT
from tidewatch.operators import labels as L
from tidewatch.sources.adapters import event_measurements
from tidewatch.streaming import live

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    meas = event_measurements(spark, SF)
    t0 = meas.where("period = 'B'").agg(F.min("t")).first()[0] - timedelta(seconds=1)
    live.freeze_baseline(meas.where("period = 'A'"), str(t0), P, f"{tmp_path}/cards", "m1")
    cards = live.start_or_resume(spark, f"{tmp_path}/cards", "m1")
    rows = meas.withColumn("t", F.col("t").cast("timestamp")).select("flow_id", "t", "rtt", "jitter", "loss_pct", "is_timeout").orderBy("t")
    rows_now = rows.collect()
    step = len(rows_now) // 4 + 1
    for k in range(4):
        part = spark.createDataFrame(rows_now[max(0, k * step - 3) : (k + 1) * step], rows.schema)  # a few rows come twice
        part.coalesce(1).write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(f"{tmp_path}/in{k}")
    source = f"{tmp_path}/stream"
    import glob
    import os
    import shutil

    os.makedirs(source)
    for k in range(4):
        for f in glob.glob(f"{tmp_path}/in{k}/part-*.json"):
            shutil.copy(f, f"{source}/{k}.json")
            os.utime(f"{source}/{k}.json", (1_000_000 + k, 1_000_000 + k))
        out = live.live(live.read_bursts(spark, source), cards, P, str(t0), "2 days")
        live.run_available(out, f"{tmp_path}/sink", f"{tmp_path}/checkpoint")  # restarts and resumes each time
        live.run_scoreboard(spark, f"{tmp_path}/sink", f"{tmp_path}/board", f"{tmp_path}/board-checkpoint", "40 days")
        streamed, batch = live.latest_board(spark, f"{tmp_path}/board").first(), live.live_scoreboard(spark.read.parquet(f"{tmp_path}/sink")).first()
        assert tuple(streamed) == tuple(batch) and (k < 2 or batch.verified > 0)
    sink = spark.read.parquet(f"{tmp_path}/sink")
    batch = L.with_predictions(L.future_labels(L.current_labels(FT.features(meas, cards, P), P), P))
    want = {(r.flow_id, r.t): r for r in batch.collect()}
    got = {(r.flow_id, r.t): r for r in sink.where("kind = 'predicted'").collect()}
    assert set(got) == set(want)
    assert sink.where("kind = 'predicted'").count() == len(want)
    for k, r in got.items():
        w = want[k]
        assert (r.rule, r.status, r.prediction, r.n5_timeout, r.n5_increase80, r.n5_moderate) == (w.rule, w.status_now, w.rule_pred, w.n5_timeout, w.n5_increase80, w.n5_moderate)
        assert (r.mean5_z is None) == (w.mean5_z is None) and (r.mean5_z is None or abs(r.mean5_z - w.mean5_z) < 1e-6 * max(1, abs(w.mean5_z)))
    verified = sink.where("kind = 'verified'").collect()
    assert verified and all(want[(r.flow_id, r.t)].status_future == r.status for r in verified)
    assert live.stream_batch_parity(sink, batch, 1e-6).count() == 0
    moved = batch.withColumn("rule", F.when(F.col("flow_id") == "3", 0).otherwise(F.col("rule"))).where("flow_id <> '4'")
    wrong = {r.why: r.n for r in live.stream_batch_parity(sink, moved, 1e-6).groupBy("why").agg(F.count("*").alias("n")).collect()}
    assert wrong == {"differs": batch.where("flow_id = '3'").count(), "only_a": batch.where("flow_id = '4'").count()}
    board = live.live_scoreboard(sink).first()
    assert board.verified == len(verified)
    assert live.freshness(sink, "2100-01-01", 60).first().stopped


def land(spark, rows, folder, name, tmp_path):
    """Rows as one JSON file of the source, after the files before it."""
    spark.createDataFrame(rows, live.MEASUREMENT_SCHEMA).coalesce(1).write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(f"{tmp_path}/made-{name}")
    (made,) = (f for f in os.listdir(f"{tmp_path}/made-{name}") if f.endswith(".json"))
    os.makedirs(folder, exist_ok=True)
    os.rename(f"{tmp_path}/made-{name}/{made}", f"{folder}/{name}.json")


def test_late_dropped_ignored_and_expiring_rows(spark, tmp_path):
    """A repeat in a later file, a late row within the watermark, one beyond it, a flow without a card, a row at the start, a future that never comes."""
    p = Params(min_valid=2, baseline_hours=2, gate=(600, 840))
    t0 = datetime(2024, 1, 1)
    at = lambda minutes: t0 + timedelta(minutes=minutes)
    row = lambda flow, minutes, rtt=10.0: (flow, at(minutes), rtt, 1.0, 0.0, 0)
    history = spark.createDataFrame([("a", at(-k), 10.0 + k % 3, 1.0, 0.0, 0, "r") for k in range(1, 60)], f"{live.MEASUREMENT_SCHEMA}, route string")
    live.freeze_baseline(history, str(t0), p, f"{tmp_path}/cards", "m")
    cards = live.start_or_resume(spark, f"{tmp_path}/cards", "m")
    files = [
        [row("a", 0), row("a", 4), row("a", 8), row("none", 5)],
        [row("a", 16), row("a", 8), row("a", 20, 50.0)],
        [row("a", 12, 40.0), row("a", 24)],  # 12 comes 8 minutes late and takes its place
        [row("a", 120), row("a", 28)],
        [row("a", 6, 99.0), row("a", 200)],  # 6 lies behind the watermark
        [row("a", 400)],
        [row("a", 900)],
    ]
    for k, rows in enumerate(files):
        land(spark, rows, f"{tmp_path}/stream", str(k), tmp_path)
        live.run_available(live.live(live.read_bursts(spark, f"{tmp_path}/stream"), cards, p, str(t0), "30 minutes"), f"{tmp_path}/sink", f"{tmp_path}/checkpoint")
    sink = spark.read.parquet(f"{tmp_path}/sink").cache()
    minutes = lambda kind: sorted((r.t - t0).total_seconds() // 60 for r in sink.where(F.col("kind") == kind).collect())
    survived = [4, 8, 12, 16, 20, 24, 28, 120, 200, 400, 900]
    assert minutes("predicted") == survived and sink.where("flow_id <> 'a'").count() == 0
    kept = spark.createDataFrame([row("a", m, {12: 40.0, 20: 50.0}.get(m, 10.0)) for m in survived], live.MEASUREMENT_SCHEMA).withColumn("t", F.col("t").cast("timestamp_ntz"))
    batch = L.future_labels(L.current_labels(FT.features(kept.withColumn("period", F.lit("B")), cards, p), p), p).collect()
    want = {(r.t - t0).total_seconds() // 60: r.status_future for r in batch if r.status_future}
    verified = {(r.t - t0).total_seconds() // 60: r.status for r in sink.where("kind = 'verified'").collect()}
    assert verified == want == {4: want[4], 8: want[8], 12: want[12], 16: want[16]}
    assert set(minutes("expired")) >= {20, 24, 28, 120} and not set(minutes("expired")) & set(want)
    board = live.live_scoreboard(sink).first()
    account = {r.kind: r for r in live.sink_account(sink).collect()}
    assert account["predicted"].n == account["predicted"].keys == len(survived) and account["verified"].n == board.verified == 4
    frozen = {r.t: r.prediction for r in sink.where("kind = 'predicted'").collect()}
    assert board.hits == sum(frozen[r.t] == r.status for r in sink.where("kind = 'verified'").collect())


def test_backfill_equals_batch(spark, tmp_path):
    """A run that starts in the past and takes the rows since as if they arrived."""
    meas = event_measurements(spark, SF)
    newest = meas.agg(F.max("t")).first()[0]
    hours = 200
    sink = live.backfill(meas, newest, hours, P, str(tmp_path), "m", 100, "2 days").cache()
    start = newest - timedelta(hours=hours)
    cards = live.start_or_resume(spark, f"{tmp_path}/cards", "m")
    after = meas.where(F.col("t") > F.lit(str(start)).cast("timestamp_ntz")).withColumn("period", F.lit("B"))
    want = {(r.flow_id, r.t): (r.rule, r.status_now) for r in L.current_labels(FT.features(after, cards, P), P).collect()}
    got = {(r.flow_id, r.t): (r.rule, r.status) for r in sink.where("kind = 'predicted'").collect()}
    assert want and got == want


def test_other_model_is_refused(spark, tmp_path):
    import pytest

    live.freeze_baseline(event_measurements(spark, SF), "2024-01-10", P, f"{tmp_path}/cards", "m1")
    with pytest.raises(ValueError):
        live.start_or_resume(spark, f"{tmp_path}/cards", "m2")


def test_stopped_query_is_told_from_an_idle_source(spark, tmp_path):
    """Lines of a listener: a query that goes on without rows is idle, one that fails has failed, one without lines is silent."""
    import time

    listener = live.ProgressTable(spark, f"{tmp_path}/progress", every=1)
    spark.streams.addListener(listener)
    try:
        os.makedirs(f"{tmp_path}/in")
        land(spark, [("a", datetime(2024, 1, 1), 1.0, 1.0, 0.0, 0)], f"{tmp_path}/in", "0", tmp_path)
        fine = live.read_bursts(spark, f"{tmp_path}/in").writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c1").trigger(processingTime="200 milliseconds").start()
        bad = live.read_bursts(spark, f"{tmp_path}/in").select(F.raise_error(F.lit("broken")).cast("string").alias("x")).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c2").start()
        try:
            bad.awaitTermination(60)
        except Exception as e:
            assert "broken" in str(e)
        fine.processAllAvailable()
        deadline = time.time() + 60
        states = {}
        while time.time() < deadline and not (len(states) == 2 and set(states.values()) == {"running", "failed"}):
            time.sleep(1)
            if os.path.exists(f"{tmp_path}/progress/_SUCCESS"):
                now = str(datetime.now())
                states = {r["query"]: r.state for r in live.query_states(spark.read.parquet(f"{tmp_path}/progress"), now, 100).collect()}
        assert states == {str(fine.id): "running", str(bad.id): "failed"}
        progress = spark.read.parquet(f"{tmp_path}/progress")
        later = lambda cadence: {r["query"]: r.state for r in live.query_states(progress, str(datetime.now() + timedelta(hours=1)), cadence).collect()}
        assert later(60) == {str(fine.id): "silent", str(bad.id): "failed"}
        fine.stop()
    finally:
        spark.streams.removeListener(listener)
    at = datetime(2024, 1, 1)
    line = lambda event, s, rows=None: ("q", "r", event, at + timedelta(seconds=s), 0, rows, None, None)
    state = lambda lines: live.query_states(spark.createDataFrame(lines, live.ProgressTable.SCHEMA), str(at + timedelta(seconds=1000)), 60).first().state
    assert state([line("started", 0), line("progress", 500, 7), line("idle", 990)]) == "idle"
    assert state([line("started", 0), line("progress", 990, 7)]) == "running"
    assert state([line("started", 0), line("progress", 700, 7)]) == "silent"
    assert state([line("started", 0), line("progress", 990, 7), line("ended", 990)]) == "ended"


def test_recent_view_equals_batch_after_each_file(spark, tmp_path):
    """Late hours within the view, hours that newer ones push out, timeouts, a flow without answers; the view resumes between files."""
    t0 = datetime(2024, 1, 1)
    row = lambda flow, hours, rtt=10.0: (flow, t0 + timedelta(hours=hours), rtt, 1.0, 0.0, int(rtt is None))
    files = [
        [row("a", 0), row("a", 0.5, 20.0), row("b", 3, None)],
        [row("a", 23.5, None), row("a", 2, 40.0), row("b", 60, 5.0), row("c", 1)],
        [row("a", 24.2, 7.0), row("a", 1, 8.0), row("b", 50, 6.0), row("b", 30)],
    ]
    seen = []
    for k, rows in enumerate(files):
        land(spark, rows, f"{tmp_path}/in", str(k), tmp_path)
        live.run_recent(live.read_bursts(spark, f"{tmp_path}/in"), f"{tmp_path}/view", f"{tmp_path}/c", 24)
        seen += rows
        want = live.recent_by_flow(spark.createDataFrame(seen, live.MEASUREMENT_SCHEMA), 24)
        assert sorted(map(tuple, live.latest_view(spark, f"{tmp_path}/view").collect())) == sorted(map(tuple, want.collect()))


def test_job_by_cadence_and_its_claim(spark, tmp_path):
    """Batches come by the clock until the job is stopped; it resumes for its own model and start only."""
    import time

    import pytest

    p = Params(min_valid=2, baseline_hours=2, gate=(600, 840))
    t0 = datetime(2024, 1, 1)
    row = lambda minutes, rtt=10.0: ("a", t0 + timedelta(minutes=minutes), rtt, 1.0, 0.0, 0)
    history = spark.createDataFrame([(*row(-k, 10.0 + k % 3), "r") for k in range(1, 60)], f"{live.MEASUREMENT_SCHEMA}, route string")
    live.freeze_baseline(history, str(t0), p, f"{tmp_path}/cards", "m")
    cards = live.start_or_resume(spark, f"{tmp_path}/cards", "m")
    predicted = lambda: spark.read.schema(live.OUTPUT_SCHEMA).parquet(f"{tmp_path}/sink").where("kind = 'predicted'").count()
    for k in range(2):
        land(spark, [row(4 + 4 * k)], f"{tmp_path}/in", str(k), tmp_path)
        query = live.run_live(live.live(live.read_bursts(spark, f"{tmp_path}/in"), cards, p, str(t0)), f"{tmp_path}/sink", f"{tmp_path}/c", "m", str(t0), "500 milliseconds")
        try:
            deadline = time.time() + 60
            query.processAllAvailable()
            while predicted() < k + 1 and time.time() < deadline:
                time.sleep(0.5)
        finally:
            query.stop()
    assert predicted() == 2
    for model, start in (("other", str(t0)), ("m", "2024-01-02")):
        with pytest.raises(ValueError, match="belongs to model m"):
            live.claim_checkpoint(spark, f"{tmp_path}/c", model, start)
    live.claim_checkpoint(spark, f"{tmp_path}/c", "m", str(t0))
