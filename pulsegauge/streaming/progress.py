"""A table of what every micro-batch did: rows, duration, late rows and counters.

A query object remembers its last hundred batches only, and none after a restart. The listener here
appends each finished batch to a table in the shared folder instead, so figures over any number of
batches, and over restarts, come from Spark queries.
"""

from __future__ import annotations

import threading
import time
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

PROGRESS_SCHEMA = (
    "query_id STRING, run_id STRING, name STRING, batch_id BIGINT, at BIGINT, rows BIGINT, duration_ms DOUBLE, "
    "late_rows BIGINT, observed MAP<STRING, DOUBLE>"
)
_KINDS = (int, float, bool)


def progress_row(progress) -> dict:
    """One batch's figures; ``at`` is the batch's start in microseconds, ``observed`` holds its numeric counters."""
    observed = {
        f"{name}_{field}": float(value)
        for name, row in (progress.observedMetrics or {}).items()
        for field, value in row.asDict().items()
        if isinstance(value, _KINDS)
    }
    started = datetime.fromisoformat(progress.timestamp.replace("Z", "+00:00"))
    return {
        "query_id": str(progress.id), "run_id": str(progress.runId), "name": progress.name, "batch_id": progress.batchId,
        "at": round(started.timestamp() * 1_000_000), "rows": progress.numInputRows,
        "duration_ms": float(progress.batchDuration),
        "late_rows": sum(s.numRowsDroppedByWatermark for s in progress.stateOperators), "observed": observed,
    }


def _ensure(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], PROGRESS_SCHEMA).write.mode("ignore").parquet(path)


class ProgressLog(StreamingQueryListener):
    """Appends the progress of the session's queries to the table at ``path``.

    Rows are written ``every`` so many batches, and when a query ends; at a crash of the driver up to
    ``every`` - 1 rows are lost, none of the data. Use as ``with ProgressLog(spark, path) as log: ...``;
    ``wait`` returns once a finished query's last rows are in the table. A write that fails keeps its rows
    for the next one, as an error in a listener must not end a query; ``wait`` and the end of the block raise it.
    """

    def __init__(self, spark: SparkSession, path: str, every: int = 50) -> None:
        if every < 1:
            raise ValueError("every must be at least 1")
        self._spark, self._path, self._every = spark, path, every
        self._pending: list[dict] = []
        self._ended: set[str] = set()
        self._failure: Exception | None = None
        self._changed = threading.Condition(threading.RLock())
        _ensure(spark, path)

    def __enter__(self) -> ProgressLog:
        self._spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self._spark.streams.removeListener(self)
        self.flush()
        self._raise()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        with self._changed:
            self._pending.append(progress_row(event.progress))
            if len(self._pending) >= self._every:
                self.flush()

    def onQueryTerminated(self, event) -> None:
        with self._changed:
            self.flush()
            self._ended.add(str(event.runId))
            self._changed.notify_all()

    def flush(self) -> None:
        """Write the rows that wait; at most ``every`` of them, unless a write failed before."""
        with self._changed:
            if not self._pending:
                return
            try:
                rows = self._spark.createDataFrame(self._pending, PROGRESS_SCHEMA)
                rows.coalesce(1).write.mode("append").parquet(self._path)
                self._pending, self._failure = [], None
            except Exception as failure:  # noqa: BLE001 - kept and raised where the caller can see it
                self._failure = failure

    def wait(self, query: StreamingQuery, seconds: float = 60.0) -> None:
        """Until the end of ``query``, which has stopped, was written; listeners hear of it a little later."""
        until = time.monotonic() + seconds
        with self._changed:
            while str(query.runId) not in self._ended:
                left = until - time.monotonic()
                if left <= 0 or not self._changed.wait(left):
                    raise TimeoutError(f"no end of query {query.runId} was reported in {seconds} seconds")
        self._raise()

    def _raise(self) -> None:
        if self._failure:
            raise self._failure


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """One row per query and batch: a batch that was run again after a restart counts as its last run did."""
    _ensure(spark, path)
    newest = Window.partitionBy("query_id", "batch_id").orderBy(F.desc("at"), F.desc("run_id"))
    rows = spark.read.schema(PROGRESS_SCHEMA).parquet(path)
    return rows.withColumn("__n", F.row_number().over(newest)).filter("__n = 1").drop("__n")


def batch_durations(progress: DataFrame) -> DataFrame:
    """``at``, ``duration_ms`` of every batch, as the summary of a run takes them."""
    return progress.select("at", "duration_ms")


def progress_totals(progress: DataFrame) -> DataFrame:
    """Per query: batches, rows, late rows and the sum of every observed counter as a map."""
    counters = progress.select("query_id", F.explode("observed").alias("counter", "value"))
    summed = counters.groupBy("query_id", "counter").agg(F.sum("value").alias("value"))
    maps = summed.groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("counter", "value")))).alias("observed"))
    totals = progress.groupBy("query_id").agg(
        F.max("name").alias("name"), F.count(F.lit(1)).alias("batches"), F.sum("rows").alias("rows"),
        F.sum("late_rows").alias("late_rows"),
    )
    return totals.join(maps, "query_id", "left")
