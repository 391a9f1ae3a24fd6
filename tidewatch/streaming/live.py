"""The live job: predict each measurement on arrival, verify it when its future has come.

Bursts arrive as JSON files; late rows within the watermark take their place in
time, later ones are dropped; repeats are dropped; rows at or before the fence,
and of flows without a card, take no part.  The only Python step is the keyed
state of ``flows.py``: a flow's last rows and the predictions that wait for their
future.  A fitted model scores each micro-batch on its way to the sink; what it said at
arrival stands there on the row of kind 'predicted' and is never changed.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.window import Window

from ..functions.params import BASELINE_COLUMNS, MODEL_COLUMNS, Params
from ..operators.baseline import cards as frozen_cards
from ..operators.features import relative_metrics
from ..operators.joins import compare_tables
from ..operators.models import assemble, score
from .flows import KEPT, OUTPUT_SCHEMA, RECENT_SCHEMA, FlowProcessor, RecentProcessor

MEASUREMENT_SCHEMA = "flow_id string, t timestamp, rtt double, jitter double, loss_pct double, is_timeout int"


def read_bursts(spark: SparkSession, path: str, schema: str = MEASUREMENT_SCHEMA, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def with_lateness(df: DataFrame, delay: str = "30 minutes") -> DataFrame:
    """The watermark follows the newest row of all flows."""
    return df.withWatermark("t", delay)


def dedup_stream(df: DataFrame) -> DataFrame:
    return df.dropDuplicatesWithinWatermark(["flow_id", "t"])


def after_fence(df: DataFrame, t0: str) -> DataFrame:
    """Only rows after the start."""
    return df.where(F.col("t") > F.to_timestamp(F.lit(t0)))


def freeze_baseline(history: DataFrame, t0: str, p: Params, path: str, model_id: str) -> None:
    """The cards of the hours before the start, kept with the start and the model's id."""
    start = F.to_timestamp(F.lit(t0))
    rows = history.where((F.col("t") <= start) & (F.col("t") > start - F.expr(f"INTERVAL {p.baseline_hours} HOURS")))
    cards = frozen_cards(rows, p).withColumn("t0", F.lit(t0)).withColumn("model_id", F.lit(model_id))
    cards.write.mode("overwrite").parquet(path)


def start_or_resume(spark: SparkSession, path: str, model_id: str) -> DataFrame:
    """The frozen cards; another model's id is refused."""
    cards = spark.read.parquet(path)
    if not cards.where(F.col("model_id") != model_id).isEmpty():
        raise ValueError("the frozen baseline belongs to another model")
    return cards


def enrich(stream: DataFrame, cards: DataFrame, p: Params) -> DataFrame:
    usable = cards.where("NOT insufficient").select("flow_id", *BASELINE_COLUMNS)
    return relative_metrics(stream.join(usable, "flow_id"), p)


def keyed_store(spark: SparkSession) -> None:
    """Map state and timers need a store that keeps keys apart on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def live(stream: DataFrame, cards: DataFrame, p: Params, t0: str, delay: str = "30 minutes") -> DataFrame:
    """The whole job, up to its sink."""
    rows = enrich(after_fence(dedup_stream(with_lateness(stream, delay)), t0), cards, p)
    keyed_store(stream.sparkSession)
    keyed = rows.select("flow_id", "t", *KEPT).groupBy("flow_id")
    return keyed.transformWithStateInPandas(FlowProcessor(p), OUTPUT_SCHEMA, "Append", "EventTime")


def run_available(out: DataFrame, sink: str, checkpoint: str) -> None:
    """Works off what has arrived and ends; the checkpoint lets a later call go on from there."""
    out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def claim_checkpoint(spark: SparkSession, checkpoint: str, model_id: str, t0: str) -> None:
    """Notes model and start beside a checkpoint at its first use; later, another model or start is refused.

    So a query never goes on with state that belongs to other cards or predictions.
    """
    path, schema = f"{checkpoint}-owner", "model_id string, t0 string"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        held = spark.read.json(path, schema=schema).first()
        if (held.model_id, held.t0) != (model_id, t0):
            raise ValueError(f"the checkpoint belongs to model {held.model_id} started at {held.t0}")
    else:
        spark.createDataFrame([(model_id, t0)], schema).coalesce(1).write.mode("overwrite").json(path)


def run_live(out: DataFrame, sink: str, checkpoint: str, model_id: str, t0: str, cadence: str = "60 seconds") -> StreamingQuery:
    """Starts the job for good: a batch each cadence; the checkpoint is claimed first."""
    claim_checkpoint(out.sparkSession, checkpoint, model_id, t0)
    return out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=cadence).start()


def backfill(measured: DataFrame, newest: datetime, hours: int, p: Params, work: str, model_id: str, step_hours: int = 24, delay: str = "30 minutes") -> DataFrame:
    """A retroactive run: the job starts some hours before ``newest`` and takes the rows since as if they arrived, step by step.

    Cards are frozen from the rows before the start; each step's rows land in the
    source folder and are worked off by the same query, which resumes from its checkpoint.
    """
    spark, t0 = measured.sparkSession, newest - timedelta(hours=hours)
    freeze_baseline(measured, str(t0), p, f"{work}/cards", model_id)
    cards = start_or_resume(spark, f"{work}/cards", model_id)
    columns = [c.split()[0] for c in MEASUREMENT_SCHEMA.split(", ")]
    rows = measured.select(*(F.col(c).cast("timestamp").alias(c) if c == "t" else c for c in columns))
    for begin in range(0, hours, step_hours):
        since, until = (F.lit(str(t0 + timedelta(hours=min(h, hours)))).cast("timestamp") for h in (begin, begin + step_hours))
        part = rows.where((F.col("t") > since) & (F.col("t") <= until))
        part.write.mode("append").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(f"{work}/source")
        run_available(live(read_bursts(spark, f"{work}/source", files_per_batch=10_000), cards, p, str(t0), delay), f"{work}/sink", f"{work}/checkpoint")
    return spark.read.parquet(f"{work}/sink")


def sink_account(sink: DataFrame) -> DataFrame:
    """(kind, n, hits) of a reread sink: predicted rows by key, verified ones and their hits, to be held against the scoreboard."""
    hit = F.count_if((F.col("kind") == "verified") & (F.col("status") == F.col("prediction")))
    return sink.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("flow_id", "t").alias("keys"), hit.alias("hits"))


#: What the sink says at arrival, and the batch columns of the same meaning.
_PARITY = {"rule": "rule", "status": "status_now", "prediction": "rule_pred", **{c: c for c in ("n5_timeout", "n5_increase80", "n5_moderate", "min5_z", "mean5_z", "robust_z", "increase_pct", "jitter_ratio")}}


def stream_batch_parity(sink: DataFrame, batch: DataFrame, tol: float = 1e-9) -> DataFrame:
    """(flow_id, t, why): rows that only the stream or only batch has, that repeat, or that the two judge differently."""
    at = F.col("t").cast("timestamp_ntz").alias("t")
    streamed = sink.where("kind = 'predicted'").select("flow_id", at, *_PARITY)
    return compare_tables(streamed, batch.select("flow_id", at, *(F.col(b).alias(a) for a, b in _PARITY.items())), ["flow_id", "t"], list(_PARITY), tol)


def predict_on_arrival(df: DataFrame, model: Model, model_id: str, cols: tuple[str, ...] = MODEL_COLUMNS) -> DataFrame:
    """A micro-batch with the fitted model's class as the prediction of the rows that arrived, its id and probabilities.

    Rows of other kinds get none: theirs is the one frozen at arrival.
    """
    keep = tuple(c for c in df.columns if c != "prediction")
    scored = score(model, assemble(df.select(*keep), cols), model_id, keep)
    arrived = F.col("kind") == "predicted"
    said = [c for c in scored.columns if c not in keep]
    return scored.select(*keep, *(F.when(arrived, F.col(c)).alias("prediction" if c == "model_pred" else c) for c in said))


def run_predicting(out: DataFrame, model: Model, model_id: str, sink: str, checkpoint: str, cols: tuple[str, ...] = MODEL_COLUMNS) -> None:
    """As run_available, with the predictions of a fitted model; a batch that is run again replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        predict_on_arrival(batch, model, model_id, cols).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    out.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def matched(out: DataFrame, delay: str = "30 minutes") -> DataFrame:
    """(flow_id, t, status, status_now, prediction): verified rows with what stood on their predicted row, both from a stream of the sink's rows.

    A stream-stream join: its state goes behind the watermark, which must lag by
    the longest time from a row to its verification.
    """
    rows = out.withWatermark("t", delay)
    now = rows.where("kind = 'predicted'").select("flow_id", "t", F.col("status").alias("status_now"), "prediction")
    return rows.where("kind = 'verified'").select("flow_id", "t", "status").join(now, ["flow_id", "t"])


def streaming_scoreboard(pairs: DataFrame, delay: str = "30 minutes") -> DataFrame:
    """(start of the day, verified, hits, persistence_hits) of a stream of matched rows, for output mode update."""
    hit = lambda c: F.sum(F.when(F.col(c) == F.col("status"), 1).otherwise(0))
    days = pairs.withWatermark("t", delay).groupBy(F.window("t", "1 day").alias("day"))
    return days.agg(F.count("*").alias("verified"), hit("prediction").alias("hits"), hit("status_now").alias("persistence_hits")).select("day.start", "verified", "hits", "persistence_hits")


def run_scoreboard(spark: SparkSession, sink: str, board: str, checkpoint: str, delay: str = "30 minutes", files_per_batch: int = 10_000) -> None:
    """Carries the scoreboard on over the sink's new files and ends.

    Two queries, as Spark joins streams in output mode append only: one writes
    matched rows, the other adds them up and writes a line for each day that a
    batch changes, in a folder of that batch, which a batch that is run again
    replaces.  ``latest_board`` reads the result.
    """
    keyed_store(spark)
    out = spark.readStream.schema(OUTPUT_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(sink)
    pairs = matched(out, delay)
    run_available(pairs, f"{board}/matched", f"{checkpoint}/matched")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{board}/days/batch={number}")

    found = spark.readStream.schema(pairs.schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{board}/matched")
    streaming_scoreboard(found, delay).writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/days").outputMode("update").trigger(availableNow=True).start().awaitTermination()


def latest_board(spark: SparkSession, board: str) -> DataFrame:
    """(verified, hits, persistence_hits) from the last line of each day."""
    last = spark.read.parquet(f"{board}/days").groupBy("start").agg(F.max_by(F.struct("verified", "hits", "persistence_hits"), "batch").alias("line"))
    return last.agg(*(F.coalesce(F.sum(f"line.{c}"), F.lit(0)).alias(c) for c in ("verified", "hits", "persistence_hits")))


def recent_view(stream: DataFrame, hours: int = 24) -> DataFrame:
    """(flow_id, newest_hour, n, timeouts, mean_rtt) over a flow's last hours up to its newest one, a row for each flow that a batch touches; for output mode update.

    State goes some time after the last row, by the clock, and costs no timer.
    """
    keyed_store(stream.sparkSession)
    return stream.select("flow_id", "t", "rtt", "is_timeout").groupBy("flow_id").transformWithStateInPandas(RecentProcessor(hours), RECENT_SCHEMA, "Update", "ProcessingTime")


def recent_by_flow(rows: DataFrame, hours: int = 24) -> DataFrame:
    """What ``recent_view`` says last of these rows."""
    hour = F.date_trunc("hour", F.col("t").cast("timestamp"))
    newest = F.max("hour").over(Window.partitionBy("flow_id"))
    kept = rows.withColumn("hour", hour).withColumn("newest_hour", newest).where(F.col("hour") > F.col("newest_hour") - F.expr(f"INTERVAL {hours} HOURS"))
    return kept.groupBy("flow_id", "newest_hour").agg(F.count("*").alias("n"), F.sum("is_timeout").alias("timeouts"), F.avg("rtt").alias("mean_rtt"))


def run_recent(stream: DataFrame, view: str, checkpoint: str, hours: int = 24) -> None:
    """Carries the view on over what has arrived and ends; ``latest_view`` reads it."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{view}/batch={number}")

    conf, key = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(key)
    conf.set(key, "false")  # state that follows the clock asks for one more batch without end; a query keeps what it starts with
    try:
        query = recent_view(stream, hours).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
    finally:
        conf.set(key, before)
    query.awaitTermination()


def latest_view(spark: SparkSession, view: str) -> DataFrame:
    """The last row of each flow."""
    last = spark.read.parquet(view).groupBy("flow_id").agg(F.max_by(F.struct("newest_hour", "n", "timeouts", "mean_rtt"), "batch").alias("line"))
    return last.select("flow_id", "line.*")


class ProgressTable(StreamingQueryListener):
    """Writes a line for each start, progress, idle trigger and end of a query, so that a stopped query is told from an idle source.

    Lines are kept by the driver up to ``every`` and then appended as one file; an end writes at once.
    """

    SCHEMA = "query string, run string, event string, at timestamp, batch long, rows long, watermark string, error string"

    def __init__(self, spark: SparkSession, path: str, every: int = 20) -> None:
        self.spark, self.path, self.every, self.lines = spark, path, every, []

    def _note(self, event: str, of: object, batch: int | None = None, rows: int | None = None, watermark: str | None = None, error: str | None = None) -> None:
        self.lines.append((str(of.id), str(of.runId), event, datetime.now(timezone.utc), batch, rows, watermark, error))
        if len(self.lines) >= self.every or event == "ended":
            self.flush()

    def flush(self) -> None:
        lines, self.lines = self.lines, []
        if lines:
            self.spark.createDataFrame(lines, self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryStarted(self, event: object) -> None:
        self._note("started", event)

    def onQueryProgress(self, event: object) -> None:
        p = event.progress
        self._note("progress", p, p.batchId, p.numInputRows, p.eventTime.get("watermark"))

    def onQueryIdle(self, event: object) -> None:
        self._note("idle", event)

    def onQueryTerminated(self, event: object) -> None:
        self._note("ended", event, error=event.exception)


def query_states(progress: DataFrame, now: str, cadence_s: int) -> DataFrame:
    """(query, last_event, last_at, last_rows_at, state): failed or ended; silent without any line for three cadences; idle without rows for as long; else running."""
    at, limit = F.lit(now).cast("timestamp").cast("long"), 3 * cadence_s
    last = progress.groupBy("query").agg(
        F.max_by(F.struct("event", "error"), F.struct("at", F.col("event") == "ended")).alias("last"), F.max("at").alias("last_at"), F.max(F.when(F.col("rows") > 0, F.col("at"))).alias("last_rows_at")
    )
    state = (
        F.when((F.col("last.event") == "ended") & F.col("last.error").isNotNull(), "failed")
        .when(F.col("last.event") == "ended", "ended")
        .when(at - F.col("last_at").cast("long") > limit, "silent")
        .when(F.col("last_rows_at").isNull() | (at - F.col("last_rows_at").cast("long") > limit), "idle")
        .otherwise("running")
    )
    return last.select("query", F.col("last.event").alias("last_event"), "last_at", "last_rows_at", state.alias("state"))


def live_scoreboard(sink: DataFrame) -> DataFrame:
    """Verified predictions and hits of the prediction frozen at arrival and of 'nothing changes'."""
    now = sink.where("kind = 'predicted'").select("flow_id", "t", F.col("status").alias("status_now"), "prediction")
    both = sink.where("kind = 'verified'").select("flow_id", "t", "status").join(now, ["flow_id", "t"])
    return both.agg(F.count("*").alias("verified"), F.count_if(F.col("prediction") == F.col("status")).alias("hits"), F.count_if(F.col("status_now") == F.col("status")).alias("persistence_hits"))


def freshness(sink: DataFrame, now: str, cadence_s: int) -> DataFrame:
    """Stopped: the newest row is older than three cadences."""
    age = F.lit(now).cast("timestamp").cast("long") - F.max("t").cast("long")
    return sink.agg(F.max("t").alias("newest"), (age > 3 * cadence_s).alias("stopped"))
