"""Structured Streaming jobs: ingest, detection, alerts, and their progress."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from pulsegauge.config import GaugeConfig
from pulsegauge.operators import alerts as alert_ops
from pulsegauge.operators.detectors import Detector, ZScoreDetector, records
from pulsegauge.operators.joins import join_summary
from pulsegauge.operators.reports import live_feed
from pulsegauge.operators.validate import checked_messages, quarantine, valid
from pulsegauge.sources import sinks
from pulsegauge.sources.sinks import append_events, upsert_results
from pulsegauge.streaming.stateful import score_stream, use_rocksdb

QUARANTINE_SCHEMA = "source STRING, row_num BIGINT, raw STRING, reason STRING"
ALERT_LOG_SCHEMA = "anomaly_id STRING, published BOOLEAN, emailed BOOLEAN, errors INT, success BOOLEAN"


def message_files(spark: SparkSession, path: str, config: GaugeConfig, pattern: str = "*.jsonl") -> DataFrame:
    """Stream of JSON-lines messages from files as they land in a folder."""
    lines = (
        spark.readStream.format("text")
        .option("maxFilesPerTrigger", config.max_files_per_trigger)
        .option("pathGlobFilter", pattern)
        .load(path)
    )
    return lines.select(
        F.col("_metadata.file_path").alias("source"), F.lit(None).cast("bigint").alias("row_num"), F.trim("value").alias("raw")
    ).filter(F.col("raw") != "")


def table_stream(spark: SparkSession, folder: str, name: str, config: GaugeConfig | None = None) -> DataFrame:
    """Stream of the parquet files of one name in a folder; the schema is read from the files."""
    schema = spark.read.option("pathGlobFilter", name).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if config:
        reader = reader.option("maxFilesPerTrigger", config.max_files_per_trigger)
    return reader.parquet(folder)


def checked_stream(messages: DataFrame, name: str = "ingest") -> DataFrame:
    """Validated messages; the counters of each micro-batch appear in the query progress."""
    checked = checked_messages(messages)
    good = F.col("reason").isNull()
    return checked.observe(
        name,
        F.count(F.lit(1)).alias("consumed"),
        F.count_if(good).alias("valid"),
        F.count_if(~good).alias("invalid"),
    )


def start(
    df: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    config: GaugeConfig | None = None,
    available_now: bool = False,
    name: str | None = None,
) -> StreamingQuery:
    """Run ``handle`` on each micro-batch; stopping and starting again resumes at the checkpoint."""
    writer = df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    if available_now:
        return writer.trigger(availableNow=True).start()
    seconds = (config or GaugeConfig()).trigger_seconds
    return writer.trigger(processingTime=f"{seconds} seconds").start()


def ingest_handler(events_path: str, quarantine_path: str) -> Callable[[DataFrame, int], None]:
    """Split each batch into events and quarantine; a repeated batch replaces what it wrote."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        # both sides come from one validation pass over the batch
        batch.persist()
        try:
            append_events(valid(batch), events_path, batch_id)
            (
                quarantine(batch)
                .withColumn("batch_id", F.lit(batch_id))
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy("batch_id")
                .parquet(quarantine_path)
            )
        finally:
            batch.unpersist()

    return handle


def detect_stream(events: DataFrame, detector: Detector, window_us: int, mode: str = "event_time", delay: str = "10 minutes") -> DataFrame:
    """Stream of flagged events, with the columns of the batch detector."""
    use_rocksdb(events.sparkSession)
    bounds = None if isinstance(detector, ZScoreDetector) else (detector.lower_percentile, detector.upper_percentile)
    return detector.verdict(score_stream(events, window_us, mode, delay, bounds))


def anomaly_handler(path: str, detector: Detector, detected_at: datetime | None = None) -> Callable[[DataFrame, int], None]:
    """Save the flagged events of each batch as records under their stable ids."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        upsert_results(records(batch.filter("is_anomaly"), detector, detected_at), path, batch_id)

    return handle


def fan_out_handler(
    channels: dict[str, Callable[[DataFrame, int], None]], log_path: str
) -> Callable[[DataFrame, int], None]:
    """Hand each batch of alerts to every channel and log the outcome.

    A channel that fails is counted and does not stop the others; an alert counts as delivered when
    at least one channel took it. A channel named ``email`` gets only the alerts the limiter passed.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            took = {}
            for name, send in channels.items():
                try:
                    send(batch.filter("sent") if name == "email" else batch, batch_id)
                    took[name] = True
                except Exception:  # noqa: BLE001 - any failure of a channel is an outcome to log
                    took[name] = False
            published = F.lit(any(ok for n, ok in took.items() if n != "email"))
            emailed = F.col("sent") & F.lit(took.get("email", False))
            log = batch.select(
                "anomaly_id",
                published.alias("published"),
                emailed.alias("emailed"),
                F.lit(sum(not ok for ok in took.values())).alias("errors"),
                (published | emailed).alias("success"),
            )
            (
                log.withColumn("batch_id", F.lit(batch_id))
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy("batch_id")
                .parquet(log_path)
            )
        finally:
            batch.unpersist()

    return handle


def channel_writer(path: str, channel: str) -> Callable[[DataFrame, int], None]:
    """Channel that writes one JSON message per alert below ``path``."""

    def send(batch: DataFrame, batch_id: int) -> None:
        messages = alert_ops.channel_messages(batch, channel).withColumn("batch_id", F.lit(batch_id))
        (
            messages.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("channel", "batch_id")
            .parquet(path)
        )

    return send


def micro_batch_handler(
    events_path: str, results_path: str, detector: Detector, window_us: int, detected_at: datetime | None = None
) -> Callable[[DataFrame, int], None]:
    """Detection without keyed state, for metrics too busy for one task.

    The batch is added to the raw table, and its events are then scored by the batch operators
    against the stored events of the last window; of the raw table only the days and metrics that the
    batch's windows touch are read, and of those only the stretch from the first window's start to the last
    event, so one event of a far-off time adds no more than its own days. A metric's work is thereby split over time slices
    and not tied to the one task that owns its key. An event is judged with everything that had
    arrived by the end of its batch.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            if batch.isEmpty():
                return
            append_events(batch, events_path, batch_id)
            day = lambda us: F.to_date(F.timestamp_micros(us))
            days = F.sequence(day(F.col("event_us") - window_us), day(F.col("event_us")))
            dated = batch.select("metric", "event_us", F.explode(days).alias("event_date"))
            span = F.min(F.col("event_us") - window_us).alias("from_us"), F.max("event_us").alias("to_us")
            touched = dated.groupBy("metric", "event_date").agg(*span)
            stored = batch.sparkSession.read.parquet(events_path).filter(F.col("batch_id") <= batch_id)
            stored = join_summary(stored, touched, ["metric", "event_date"], salt=["event_us"])
            # of a touched day, only what lies in some window of the batch
            stored = stored.filter(F.col("event_us").between(F.col("from_us"), F.col("to_us"))).drop("from_us", "to_us")
            fresh = detector.anomalies(stored, window_us).filter(F.col("batch_id") == batch_id)
            upsert_results(records(fresh, detector, detected_at), results_path, batch_id)
        finally:
            batch.unpersist()

    return handle


def feed_handler(path: str, keep: int = 100) -> Callable[[DataFrame, int], None]:
    """Keep the newest records of a stream: each batch writes the feed as it stands after it.

    A batch starts from the feed of the newest batch before it, so a repeated one gives the same feed.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        previous = read_feed(batch.sparkSession, path, batch.schema, before=batch_id)
        feed = live_feed(previous, batch, keep).withColumn("batch_id", F.lit(batch_id))
        feed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    return handle


def read_feed(spark: SparkSession, path: str, schema: StructType, before: int = 1 << 62) -> DataFrame:
    """The feed of the newest batch, or of the newest one before a given batch; empty when there is none."""
    sinks.ensure_store(spark, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema))
    stored = spark.read.schema(StructType([*schema, StructField("batch_id", LongType())])).parquet(path)
    earlier = stored.filter(F.col("batch_id") < before)
    newest = earlier.agg(F.max("batch_id")).first()[0]
    return earlier.filter(F.col("batch_id") == (-1 if newest is None else newest)).drop("batch_id")


def progress_rows(query: StreamingQuery) -> list[dict]:
    """Per micro-batch: rows, duration, late rows and observed counters, of the batches that the query remembers.

    Those are the last hundred of this run; ``progress.ProgressLog`` keeps all.
    """
    rows = []
    for p in query.recentProgress:
        observed = {
            f"{name}_{field}": value
            for name, row in (p.observedMetrics or {}).items()
            for field, value in row.asDict().items()
        }
        late = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        rows.append(
            {"batch_id": p.batchId, "rows": p.numInputRows, "duration_ms": float(p.batchDuration), "late_rows": late, **observed}
        )
    return rows
