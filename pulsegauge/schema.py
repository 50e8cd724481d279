"""Column layouts shared by the batch and the streaming jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegauge.functions.identity import event_id

EVENT_COLUMNS = (
    "event_id",
    "event_us",
    "event_ts",
    "metric",
    "value",
    "meta_json",
    "source",
    "row_num",
)

EVENT_SCHEMA = (
    "event_id STRING, event_us BIGINT, event_ts TIMESTAMP, metric STRING, value DOUBLE, "
    "meta_json STRING, source STRING, row_num BIGINT"
)

ANOMALY_COLUMNS = (
    "anomaly_id",
    "event_id",
    "metric",
    "value",
    "mean",
    "stddev",
    "variance",
    "z_score",
    "threshold",
    "lower_bound",
    "upper_bound",
    "lower_percentile",
    "upper_percentile",
    "event_us",
    "timestamp",
    "is_anomaly",
    "detection_method",
    "window_count",
    "detected_at",
    "event_meta",
)

ANOMALY_SCHEMA = (
    "anomaly_id STRING, event_id STRING, metric STRING, value DOUBLE, mean DOUBLE, stddev DOUBLE, variance DOUBLE, "
    "z_score DOUBLE, threshold DOUBLE, lower_bound DOUBLE, upper_bound DOUBLE, lower_percentile DOUBLE, "
    "upper_percentile DOUBLE, event_us BIGINT, timestamp TIMESTAMP, is_anomaly BOOLEAN, detection_method STRING, "
    "window_count BIGINT, detected_at TIMESTAMP, event_meta STRING"
)


def events_from_table(
    df: DataFrame,
    metric: str | Column,
    timestamp: str | Column,
    value: str | Column,
    meta: str | Column | None = None,
    source: str | None = None,
) -> DataFrame:
    """Read any table with a time, a name and a number as canonical events.

    Rows without a metric, a time or a finite value are no events and are left out, as the validators
    of messages and files do. Only columns a later step asks for survive column pruning, so the hash behind
    ``event_id`` costs nothing in a query that does not use it.
    """
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    ts = as_col(timestamp).cast("timestamp")
    base = df.select(
        F.unix_micros(ts).alias("event_us"),
        ts.alias("event_ts"),
        as_col(metric).cast("string").alias("metric"),
        as_col(value).cast("double").alias("value"),
        (as_col(meta) if meta is not None else F.lit(None)).cast("string").alias("meta_json"),
        F.lit(source).cast("string").alias("source"),
        F.lit(None).cast("bigint").alias("row_num"),
    )
    value = F.col("value")
    sound = F.col("metric").isNotNull() & F.col("event_us").isNotNull() & value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return base.filter(sound).withColumn("event_id", event_id("metric", "event_us", "value")).select(*EVENT_COLUMNS)
