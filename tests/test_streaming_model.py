"""A fitted model in the live job says what it says in batch."""

from datetime import timedelta
import os

from pyspark.sql import functions as F

from tidewatch.functions.params import EVENT_PARAMS as P
from tidewatch.functions.params import MODEL_COLUMNS
from tidewatch.operators import features as FT
from tidewatch.operators import labels as L
from tidewatch.operators import models as M
from tidewatch.sources.adapters import event_measurements
from tidewatch.streaming import live

SF = "/root/testdata/sf0.001"


def test_fitted_model_predicts_on_arrival(spark, tmp_path):
    meas = event_measurements(spark, SF)
    t0 = meas.where("period = 'B'").agg(F.min("t")).first()[0] - timedelta(seconds=1)
    live.freeze_baseline(meas.where("period = 'A'"), str(t0), P, f"{tmp_path}/cards", "tree")
    cards = live.start_or_resume(spark, f"{tmp_path}/cards", "tree")
    batch = L.with_predictions(L.future_labels(L.current_labels(FT.features(meas, cards, P), P), P)).cache()
    # The class of now tells the model from the fixed rule.
    model = M.fit_tree(M.prepare(batch, MODEL_COLUMNS, "status_now"), depth=6, min_rows=1)
    want = {(r.flow_id, r.t): r for r in M.score(model, M.assemble(batch, MODEL_COLUMNS), "tree", ("flow_id", "t", "rule_pred", *MODEL_COLUMNS)).collect()}
    assert any(r.model_pred != r.rule_pred for r in want.values())
    rows = meas.withColumn("t", F.col("t").cast("timestamp")).select("flow_id", "t", "rtt", "jitter", "loss_pct", "is_timeout").orderBy("t").collect()
    source = f"{tmp_path}/stream"
    os.makedirs(source)
    step = len(rows) // 4 + 1
    for k in range(4):
        df = spark.createDataFrame(rows[k * step : (k + 1) * step], live.MEASUREMENT_SCHEMA)
        df.coalesce(1).write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(f"{tmp_path}/in{k}")
        (name,) = (f for f in os.listdir(f"{tmp_path}/in{k}") if f.endswith(".json"))
        os.rename(f"{tmp_path}/in{k}/{name}", f"{source}/{k}.json")
        out = live.live(live.read_bursts(spark, source), cards, P, str(t0), "2 days")
        live.run_predicting(out, model, "tree", f"{tmp_path}/sink", f"{tmp_path}/checkpoint")  # resumes each time
    sink = spark.read.parquet(f"{tmp_path}/sink").cache()
    arrived = sink.where("kind = 'predicted'").collect()
    assert len(arrived) == len(want)
    for r in arrived:
        w = want[(r.flow_id, r.t)]
        assert (r.prediction, r.model_id, r.p_ok) == (w.model_pred, "tree", w.p_ok)
        assert [r[c] for c in MODEL_COLUMNS] == [w[c] for c in MODEL_COLUMNS]
    verified = sink.where("kind = 'verified'").collect()
    assert verified and all(r.prediction is None for r in verified)
    board = live.live_scoreboard(sink).first()
    assert (board.verified, board.hits) == (len(verified), sum(want[(r.flow_id, r.t)].model_pred == r.status for r in verified))
