"""Summaries, counters and recent-record queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegauge.operators.joins import join_summary

ERROR_LIST_LIMIT = 10
#: Processing times that a summary's mean covers.
NEWEST_DURATIONS = 1000
RECENT_COLUMNS = ("event_id", "metric", "value", "timestamp", "z_score", "detected_at")


def distinct_metrics(events: DataFrame) -> DataFrame:
    """Metric names, sorted."""
    return events.select("metric").distinct().orderBy("metric")


def batch_metrics(events: DataFrame) -> DataFrame:
    """Per batch, its size and the sorted list of its metric names."""
    per_metric = events.groupBy("batch_id", "metric").agg(F.count(F.lit(1)).alias("n"))
    return per_metric.groupBy("batch_id").agg(
        F.sum("n").alias("event_count"), F.array_sort(F.collect_list("metric")).alias("metrics")
    )


def tracked_metric_count(events: DataFrame) -> DataFrame:
    return events.agg(F.count_distinct("metric").alias("metrics_tracked"))


def ingest_tally(checked: DataFrame, accepted: Column | None = None) -> DataFrame:
    """One row of ingest counters over validated input.

    ``accepted`` says which valid events the queue took; without it all of them were taken.
    """
    good = F.col("reason").isNull()
    taken = good & (F.lit(True) if accepted is None else accepted)
    return checked.agg(
        F.count(F.lit(1)).alias("consumed"),
        F.count_if(good).alias("valid"),
        F.count_if(~good).alias("invalid"),
        F.count_if(taken).alias("pushed"),
        F.count_if(good & ~taken).alias("failed"),
    )


def reject_counts(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def processor_summary(
    checked: DataFrame, anomalies: DataFrame, raw: DataFrame | None = None, durations: DataFrame | None = None,
    log: DataFrame | None = None, params: dict[str, float] | None = None, newest: int = NEWEST_DURATIONS,
) -> DataFrame:
    """One row over a processing run, put together from counts that each run in parallel.

    ``durations`` (``at``, ``duration_ms``) give the mean of the ``newest`` ones, ``log`` (see ``alert_tally``) the
    alert counters, and ``params`` are the detector's. Pass ``checked`` stored or persisted: it is counted,
    scored and compared with the backlog.

    Every part yields the same columns with zeros where it has nothing to say, and one last
    aggregate adds them up; no join is needed to set single rows side by side.
    """
    zero = F.lit(0).cast("bigint")
    names = (
        "total_processed", "total_errors", "metrics_tracked", "total_anomalies", "queue_size", "detector_total_checked",
        "detector_total_anomalies", "alert_total_broadcasted", "alert_total_emails_sent", "alert_total_errors",
    )

    def part(df: DataFrame, **counts: Column) -> DataFrame:
        columns = [counts.get(n, zero).alias(n) for n in names]
        return df.agg(*columns, counts.get("avg", F.lit(None).cast("double")).alias("avg_processing_time_ms"))

    good = F.col("reason").isNull()
    parts = [
        part(
            checked,
            total_processed=F.count_if(good),
            total_errors=F.count_if(~good),
            metrics_tracked=F.count_distinct(F.when(good, F.col("metric"))),
            detector_total_checked=F.count_if(good),
        ),
        part(anomalies, total_anomalies=F.count(F.lit(1)), detector_total_anomalies=F.count(F.lit(1))),
    ]
    if raw is not None:
        parts.append(part(raw, queue_size=F.count(F.lit(1))))
    if durations is not None:
        last = durations.orderBy(F.desc("at"), F.desc("duration_ms")).limit(newest)
        parts.append(part(last, avg=F.avg("duration_ms")))
    if log is not None:
        parts.append(part(alert_tally(log), **{f"alert_{n}": F.sum(n) for n in ("total_broadcasted", "total_emails_sent", "total_errors")}))
    total, *rest = parts
    for more in rest:
        total = total.unionByName(more)
    return total.agg(
        *[F.sum(n).alias(n) for n in names],
        F.coalesce(F.max("avg_processing_time_ms"), F.lit(0.0)).alias("avg_processing_time_ms"),
        *[F.lit(v).alias(f"detector_{k}") for k, v in (params or {}).items()],
    )


def upload_summary(checked: DataFrame, files: DataFrame) -> DataFrame:
    """Per file: rows, good, bad; the errors themselves only where there are at most ten.

    Errors are counted first, and lists are built just for the files within the limit, so a file
    with a billion bad rows never gathers them anywhere.
    """
    counts = checked.groupBy("source").agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col("reason").isNull()).alias("success_count"),
        F.count_if(F.col("reason").isNotNull()).alias("error_count"),
    )
    few = counts.filter(F.col("error_count").between(1, ERROR_LIST_LIMIT)).select("source")
    listed = (
        join_summary(checked.filter(F.col("reason").isNotNull()), few, ["source"], salt=["row_num"])
        .groupBy("source")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("row_num").alias("row"), F.col("reason").alias("error")))).alias("errors"))
    )
    note = F.when(
        F.col("error_count") > ERROR_LIST_LIMIT,
        F.format_string("Too many errors to display (%d total)", F.col("error_count")),
    )
    return (
        files.join(counts, "source", "left")
        .join(listed, "source", "left")
        .fillna(0, ["total_rows", "success_count", "error_count"])
        .select(
            "source",
            F.col("error").isNull().alias("success"),
            "total_rows", "success_count", "error_count", "errors",
            note.alias("errors_note"),
            F.col("error").alias("file_error"),
        )
    )


def bulk_summary(per_file: DataFrame) -> DataFrame:
    """The files of ``upload_summary`` plus one total row (``source`` NULL, ``level`` 'total').

    A rollup: each file stays a row of its own, so the report grows with the files instead of
    packing them into one array.
    """
    rolled = per_file.rollup("source").agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(F.col("success")).alias("files_ok"),
        F.sum("success_count").alias("total_success_count"),
        F.sum("error_count").alias("total_error_count"),
        F.grouping("source").alias("g"),
    )
    return rolled.select(
        F.when(F.col("g") == 1, F.lit("total")).otherwise(F.lit("file")).alias("level"),
        "source", "total_files", "files_ok", "total_success_count", "total_error_count",
    )


def backlog_size(raw: DataFrame, processed: DataFrame) -> DataFrame:
    from pulsegauge.operators.validate import backlog

    return backlog(raw, processed).agg(F.count(F.lit(1)).alias("queue_size"))


def alert_tally(log: DataFrame) -> DataFrame:
    """Counters over an alert log with ``published, emailed, errors`` per alert."""
    return log.agg(
        F.count_if("published").alias("total_broadcasted"),
        F.count_if("emailed").alias("total_emails_sent"),
        F.coalesce(F.sum("errors"), F.lit(0)).cast("bigint").alias("total_errors"),
    )


def dashboard_counters(anomalies: DataFrame, now: Column, seconds: float = 60) -> DataFrame:
    """All anomalies, and those detected less than ``seconds`` ago."""
    age = (F.unix_micros(now) - F.unix_micros("detected_at")) / 1e6
    return anomalies.agg(
        F.count(F.lit(1)).alias("total_anomalies"), F.count_if(age < seconds).alias("recent_anomalies")
    )


def run_summary(events: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Per run: events, anomalies, start, end and status; ``anomalies`` carry ``run_id``.

    A run is failed when one of its events failed, running while one is pending, else completed.
    """
    status = (
        F.when(F.bool_or(F.col("status") == "failed"), F.lit("failed"))
        .when(F.bool_or(F.col("status") == "pending"), F.lit("running"))
        .otherwise(F.lit("completed"))
    )
    per_run = events.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.min("event_us").alias("started_us"),
        F.max("event_us").alias("completed_us"),
        status.alias("status"),
    )
    flagged = anomalies.groupBy("run_id").agg(F.count(F.lit(1)).alias("anomaly_count"))
    return (
        per_run.join(flagged, "run_id", "left")
        .fillna(0, ["anomaly_count"])
        .withColumn("completed_us", F.when(F.col("status") != "running", F.col("completed_us")))
        .select("run_id", "event_count", "anomaly_count", "started_us", "completed_us", "status")
    )


def recent_anomalies(anomalies: DataFrame, limit: int = 100) -> DataFrame:
    """Newest anomaly records first; equal detection times are ordered by record id."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    return (
        anomalies.filter("is_anomaly")
        .orderBy(F.desc("detected_at"), "anomaly_id")
        .limit(limit)
        .select(F.col("anomaly_id").alias("event_id"), *RECENT_COLUMNS[1:])
    )


def live_feed(previous: DataFrame | None, arrived: DataFrame, keep: int = 100) -> DataFrame:
    """The feed after new records came in: the newest ``keep``, newest first."""
    both = arrived if previous is None else previous.unionByName(arrived)
    rest = [c for c in both.columns if c != "anomaly_id"]
    # a record that arrives again replaces itself; versions of one time are told apart by their contents
    latest = both.groupBy("anomaly_id").agg(
        F.max_by(F.struct(*rest), F.struct(F.col("detected_at"), F.xxhash64(*rest))).alias("kept")
    )
    return (
        latest.select("anomaly_id", "kept.*")
        .select(*both.columns)
        .orderBy(F.desc("detected_at"), "anomaly_id")
        .limit(keep)
    )


def fifo(events: DataFrame) -> DataFrame:
    """Events in queue order of each metric: time, then id. Sorts by range, so no task holds a metric."""
    return events.orderBy("metric", "event_us", "event_id")


def rolling_mean(df: DataFrame, key: str, order: list[str], column: str, rows: int = 1000, out: str = "rolling_mean") -> DataFrame:
    """Mean of the last ``rows`` rows of each key in the given order, exact and without a key per task.

    Rows get their rank in the key first. ``order[0]`` must be a number; it cuts each key into
    cells whose counts give the rank of a cell's first row. Ranks then form blocks of ``rows``: the
    frame of a row is the tail of one block and the head of the next.
    """
    lead = order[0]
    spans = df.groupBy(key).agg(F.min(lead).alias("lo"), F.max(lead).alias("hi"), F.count(F.lit(1)).alias("n"))
    cells = F.greatest(F.lit(1), F.ceil(F.col("n") / (4 * rows)))
    cut = join_summary(df, spans, [key], salt=order).withColumn(
        "cell", F.floor((F.col(lead) - F.col("lo")) * cells / (F.col("hi") - F.col("lo") + 1)).cast("bigint")
    )
    per_cell = cut.groupBy(key, "cell").agg(F.count(F.lit(1)).alias("held"))
    earlier = Window.partitionBy(key).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_cell.select(key, "cell", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("start"))
    in_cell = Window.partitionBy(key, "cell").orderBy(*order)
    ranked = (
        cut.join(starts, [key, "cell"])
        .withColumn("rank", F.col("start") + F.row_number().over(in_cell) - 1)
        .drop("lo", "hi", "n", "cell", "start")
    )
    block = F.expr(f"rank div {rows}")
    copies = F.array(
        F.struct(block.alias("block"), F.lit(True).alias("core")),
        F.struct((block + 1).alias("block"), F.lit(False).alias("core")),
    )
    frame = Window.partitionBy(key, "block").orderBy("rank").rowsBetween(1 - rows, 0)
    return (
        ranked.select("*", F.inline(copies))
        .withColumn(out, F.avg(column).over(frame))
        .filter("core")
        .drop("rank", "block", "core")
    )
