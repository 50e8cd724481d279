"""Parquet tables for raw events and results, laid out for pruning and for safe repeats."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegauge.schema import ANOMALY_SCHEMA


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the one the cluster shares (``spark.checkpoint.dir``).

    Only a session of a single machine (``local[...]``, as in tests) may name none and gets a
    temporary folder; on several machines that would be a different folder on each.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    master = spark.conf.get("spark.master", "local")
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
    return os.path.join(tempfile.mkdtemp(prefix="pulsegauge-"), name)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to a new shared folder and read back, so that lost executors cost no recomputation."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumn("event_date", F.to_date(F.timestamp_micros("event_us")))


def append_events(events: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Add events to the raw table, partitioned by day.

    With a ``batch_id`` (a micro-batch) the batch owns its partition, and writing it again after a
    failure replaces it instead of adding the events a second time.
    """
    dated = _dated(events)
    if batch_id is None:
        dated.write.mode("append").partitionBy("event_date").parquet(path)
        return
    (
        dated.withColumn("batch_id", F.lit(batch_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("event_date", "batch_id")
        .parquet(path)
    )


def events_between(spark: SparkSession, path: str, from_us: int, to_us: int) -> DataFrame:
    """Events of a time range; the day predicate prunes folders, the time predicate row groups."""
    day = lambda us: F.to_date(F.timestamp_micros(F.lit(us)))
    table = spark.read.parquet(path)
    return table.filter(
        F.col("event_date").between(day(from_us), day(to_us)) & F.col("event_us").between(from_us, to_us)
    )


def upsert_results(results: DataFrame, path: str, batch_id: int) -> None:
    """Save results under their id. Each batch replaces its own partition; reads keep the newest.

    Record ids are derived from the event, so a repeated batch gives the same rows, and a later
    batch that scores the same event again takes over without rewriting older partitions.
    """
    latest = _newest(results, "detected_at")
    (
        latest.withColumns({"batch_id": F.lit(batch_id), "id_part": _id_part(F.col("anomaly_id"))})
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id", "id_part")
        .parquet(path)
    )


def _id_part(anomaly_id: Column) -> Column:
    """The first digit of the hash in an id: ids are spread evenly over sixteen folders of a batch."""
    return F.substring(anomaly_id, 9, 1)


def _newest(results: DataFrame, order: str) -> DataFrame:
    rest = [c for c in results.columns if c != "anomaly_id"]
    # versions of one age are told apart by their contents, so every read keeps the same one
    kept = F.max_by(F.struct(*rest), F.struct(F.col(order), F.xxhash64(*rest)))
    return results.groupBy("anomaly_id").agg(kept.alias("kept")).select("anomaly_id", "kept.*").select(*results.columns)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    # the schema is given, as a store that has seen only empty batches holds no file to read it from
    return read_store(spark, path, f"{ANOMALY_SCHEMA}, id_part STRING")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """All results, the newest version of each id."""
    return _newest(_stored(spark, path), "batch_id").drop("batch_id", "id_part")


def result_by_id(spark: SparkSession, path: str, anomaly_id: str) -> DataFrame:
    """One result or none; only the folders of its id's part are read, and the predicate reaches their scan."""
    part = _id_part(F.lit(anomaly_id))
    found = _stored(spark, path).filter((F.col("id_part") == part) & (F.col("anomaly_id") == anomaly_id))
    return _newest(found, "batch_id").drop("batch_id", "id_part")


def compact_results(spark: SparkSession, path: str, new_path: str, batch_id: int) -> None:
    """The newest version of every result as one batch at a new place, so that reads list few folders again."""
    upsert_results(read_results(spark, path), new_path, batch_id)


def only_anomalies(results: DataFrame) -> DataFrame:
    """Results that are anomaly records, by id prefix and flag."""
    return results.filter(F.col("anomaly_id").startswith("anomaly-") & F.col("is_anomaly"))


def rewrite_retained(spark: SparkSession, path: str, new_path: str, keep_from_us: int) -> None:
    """Write the raw table without events older than ``keep_from_us`` to a new place.

    Readers of the old table are not disturbed; whole days before the limit are never read.
    """
    day = F.to_date(F.timestamp_micros(F.lit(keep_from_us)))
    kept = spark.read.parquet(path).filter((F.col("event_date") >= day) & (F.col("event_us") >= keep_from_us))
    kept.drop("batch_id").write.mode("errorifexists").partitionBy("event_date").parquet(new_path)


def ensure_store(spark: SparkSession, path: str, schema: str) -> None:
    """Make sure a batch-partitioned store exists, so that it can be read before its first batch."""
    spark.createDataFrame([], f"{schema}, batch_id BIGINT").write.mode("ignore").partitionBy("batch_id").parquet(path)


def read_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, batch_id BIGINT").parquet(path)


def clear(spark: SparkSession, path: str, new_path: str) -> None:
    """An empty table of the same layout at a new place."""
    spark.read.parquet(path).limit(0).drop("batch_id").write.mode("errorifexists").parquet(new_path)
