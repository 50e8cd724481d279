"""The registered queries: each reads whole tables of a data folder and returns one DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegauge.config import MICROS, GaugeConfig
from pulsegauge.functions.timestamps import micros_to_iso
from pulsegauge.operators import alerts, detectors, reports, validate, windows
from pulsegauge.operators.detectors import PercentileDetector, ZScoreDetector
from pulsegauge.operators.percentiles import percentile_bounds
from pulsegauge.plans.detection import newest_anomalies
from pulsegauge.schema import ANOMALY_SCHEMA, events_from_table
from pulsegauge.sources import files, kafka, sinks
from pulsegauge.sources.tables import event_series, order_series, shipment_series, table
from pulsegauge.streaming import jobs, progress, stateful

HOUR_US = 3600 * MICROS
DAY_US = 24 * HOUR_US
WINDOW_US = 6 * HOUR_US
WEEK_US = 7 * DAY_US
AS_OF_US = 1_705_320_000 * MICROS  # 2024-01-15 12:00 UTC, the middle of the events table
ALERT_US = 12 * HOUR_US
BAND = PercentileDetector(5.0, 95.0, 20)
ZSCORE = ZScoreDetector()
ADDRESSES = " ops@example.org, ,lead@example.org "

def _settle(df: DataFrame, *names: str) -> DataFrame:
    """Computed numbers in single precision: engines differ in the last bits of a double."""
    return df.withColumns({n: F.round(n, 9).cast("float") for n in names})


def _for_text(df: DataFrame, *names: str) -> DataFrame:
    """The same numbers as doubles, so that texts show what the columns hold."""
    return _settle(df, *names).withColumns({n: F.col(n).cast("double") for n in names})


def _stats_columns(df: DataFrame, *first: str) -> DataFrame:
    return _settle(df.select(*first, *windows.STATS), "mean", "variance", "stddev")


# --- windows -----------------------------------------------------------------------------------


def window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats_columns(windows.window_stats(event_series(spark, sf_dir), WINDOW_US), "metric", "event_us", "value")


def window_stats_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = windows.window_stats(event_series(spark, sf_dir), WINDOW_US, slices=8)
    return _stats_columns(scored, "metric", "event_us", "value")


def window_stats_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = windows.window_stats(event_series(spark, sf_dir), WINDOW_US, "halo", bucket_us=10 * HOUR_US)
    return _stats_columns(scored, "metric", "event_us", "value")


def window_stats_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats_columns(windows.window_stats(event_series(spark, sf_dir), WINDOW_US, "frame"), "metric", "event_us", "value")


def window_stats_tied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many events share an instant here; each of them sees all of them."""
    scored = windows.window_stats(shipment_series(spark, sf_dir), WEEK_US, slices=7)
    return _settle(
        scored.select("metric", "event_us", "value", "window_count", "mean", "stddev"), "mean", "stddev"
    )


def snapshot_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats_columns(windows.snapshot_stats(event_series(spark, sf_dir), AS_OF_US, WINDOW_US), "metric")


def snapshot_stats_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported for all order priorities as well, which have no events and so count 0."""
    events = event_series(spark, sf_dir)
    metrics = events.select("metric").unionByName(order_series(spark, sf_dir).select("metric"))
    return _stats_columns(windows.snapshot_stats(events, AS_OF_US, WINDOW_US, metrics), "metric")


def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats_columns(windows.latest_state(event_series(spark, sf_dir), WINDOW_US), "metric", "event_us")


def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = windows.retain(event_series(spark, sf_dir), AS_OF_US, WINDOW_US)
    return kept.select("metric", "event_us", "value")


def retention_one_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = windows.retain(event_series(spark, sf_dir), AS_OF_US, WINDOW_US, ["error"])
    return kept.select("metric", "event_us", "value")


def rolling_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = reports.rolling_mean(event_series(spark, sf_dir), "metric", ["event_us", "event_id"], "value")
    return _settle(rolled.select("metric", "event_us", "value", "rolling_mean"), "rolling_mean")


# --- detectors ---------------------------------------------------------------------------------


def _flagged_z(df: DataFrame) -> DataFrame:
    columns = ("metric", "event_us", "value", "window_count", "mean", "stddev", "z_score")
    return _settle(df.select(*columns), "mean", "stddev", "z_score")


def zscore_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flagged_z(ZSCORE.anomalies(event_series(spark, sf_dir), WINDOW_US))


def zscore_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with its verdict and the reason where there is none."""
    scored = ZSCORE.score(event_series(spark, sf_dir), WINDOW_US)
    return _settle(scored.select("metric", "event_us", "value", "z_score", "is_anomaly", "skip_reason"), "z_score")


def zscore_anomalies_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = ZScoreDetector(2.0, 5).anomalies(order_series(spark, sf_dir), 30 * DAY_US)
    return _settle(
        flagged.select("metric", "event_us", "value", "window_count", "mean", "stddev", "z_score"),
        "mean", "stddev", "z_score",
    )


def percentile_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = BAND.anomalies(event_series(spark, sf_dir), WINDOW_US)
    return _settle(
        flagged.select("metric", "event_us", "value", "window_count", "mean", "stddev", "lower_bound", "upper_bound"),
        "mean", "stddev",
    )


def percentile_anomalies_thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way for overfull buckets, forced by a small limit; a window of five days."""
    band = PercentileDetector(5.0, 95.0, 20, limit=100)
    flagged = band.anomalies(event_series(spark, sf_dir), 5 * DAY_US)
    return flagged.select("metric", "event_us", "value", "window_count", "lower_bound", "upper_bound")


def window_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = event_series(spark, sf_dir)
    stats = windows.instant_stats(events, WINDOW_US)
    return percentile_bounds(events, stats, WINDOW_US, 5.0, 95.0, 20)


def percentile_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third event has no value; it counts in no window and moves no bound."""
    value = F.when(F.col("event_id") % 3 != 0, F.col("value"))
    events = events_from_table(table(spark, sf_dir, "events"), "event_type", "ts", value, "props", "events")
    return BAND.anomalies(events, WINDOW_US).select("metric", "event_us", "value", "window_count", "lower_bound", "upper_bound")


def detector_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = event_series(spark, sf_dir)
    columns = ("detection_method", "total_checked", "total_anomalies")
    z = detectors.tally(events, ZSCORE, WINDOW_US).select(*columns)
    return z.unionByName(detectors.tally(events, BAND, WINDOW_US).select(*columns))


def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twice each value, judged as a candidate against the recorded history at its time."""
    events = event_series(spark, sf_dir)
    doubled = events.select("metric", "event_us", (F.col("value") * 2).alias("value"))
    scored = detectors.score_candidates(events, doubled, ZScoreDetector(2.5, 5), WINDOW_US)
    return _settle(scored.select("metric", "event_us", "value", "window_count", "z_score", "is_anomaly"), "z_score")


def candidate_snapshot_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = event_series(spark, sf_dir)
    snapshot = windows.snapshot_stats(events, AS_OF_US, 10 * DAY_US)
    scored = detectors.score_against_snapshot(snapshot, events, ZSCORE)
    return _settle(scored.select("metric", "event_us", "value", "window_count", "z_score", "is_anomaly"), "z_score")


def anomaly_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detectors.detect_all(event_series(spark, sf_dir), [ZSCORE, BAND], WINDOW_US, F.timestamp_micros("event_us"))
    plain = found.select(
        "anomaly_id", "event_id", "metric", "value", "mean", "stddev", "variance", "z_score", "threshold",
        "lower_bound", "upper_bound", "lower_percentile", "upper_percentile", "event_us", "is_anomaly",
        "detection_method", "window_count", F.unix_micros("detected_at").alias("detected_us"), "event_meta",
    )
    return _settle(plain, "mean", "stddev", "variance", "z_score")


def recent_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = GaugeConfig(window_seconds=WINDOW_US / MICROS)
    newest = newest_anomalies(event_series(spark, sf_dir), config, F.timestamp_micros("event_us"))
    columns = newest.select(
        "event_id", "metric", "value", F.unix_micros("timestamp").alias("event_us"), "z_score",
        F.unix_micros("detected_at").alias("detected_us"),
    )
    return _settle(columns, "z_score")


def live_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed holding the first half of the records, after all records arrive."""
    found = _records(spark, sf_dir)
    shown = reports.live_feed(found.filter(F.col("event_us") < AS_OF_US), found)
    return shown.select("anomaly_id", "metric", "value", "event_us")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.detect(event_series(spark, sf_dir), ZSCORE, WINDOW_US, F.timestamp_micros("event_us"))


# --- validation --------------------------------------------------------------------------------


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as JSON messages in mixed shape; properties of the rows decide what is wrong.

    The user picks the form of the timestamp, the value its own form; none of it is sampled.
    """
    events = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    iso = micros_to_iso(us)
    form = F.col("user_id") % 8
    seconds = (us.cast("decimal(20,0)") / 1000000).cast("decimal(20,6)").cast("string")
    stamp = (
        F.when(form == 0, F.concat(F.lit('"'), iso, F.lit('Z"')))
        .when(form == 1, seconds)
        .when(form == 2, F.concat(F.lit('"'), seconds, F.lit('"')))
        .when(form == 3, F.concat(F.lit('"'), F.substring(iso, 1, 7), F.lit('"')))
        .when(form == 4, F.concat(F.lit('"'), iso, F.lit('+02:00"')))
        .when(form == 5, F.lit("100.0"))
        .otherwise(F.concat(F.lit('"'), iso, F.lit('"')))
    )
    value = (
        F.when(F.col("value") > 200, F.lit('"high"'))
        .when(F.col("value") > 150, F.lit("1e309"))
        .when(F.col("value") > 120, F.concat(F.lit('"'), F.col("value").cast("string"), F.lit('"')))
        .otherwise(F.col("value").cast("string"))
    )
    metric = F.when(F.col("value") < 2, F.lit("")).otherwise(F.col("event_type"))
    whole = F.concat(
        F.lit('{"timestamp": '), stamp, F.lit(', "metric": "'), metric, F.lit('", "value": '), value,
        F.lit(', "meta": '), F.when(form == 6, F.lit("[1]")).otherwise(F.col("props")), F.lit("}"),
    )
    text = (
        F.when(F.col("value").between(2, 4), F.substring(whole, 1, 20))
        .when(F.col("value").between(5, 6), F.concat(F.lit('{"timestamp": '), stamp, F.lit("}")))
        .when(F.col("value").between(7, 7.5), F.concat(F.lit("["), whole, F.lit("]")))
        .otherwise(whole)
    )
    return events.select(F.lit("events").alias("source"), F.col("event_id").alias("row_num"), text.alias("raw"))


def validated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = validate.valid(validate.checked_messages(raw_messages(spark, sf_dir)))
    return good.select("row_num", "metric", "event_us", "value", "meta_json")


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = validate.quarantine(validate.checked_messages(raw_messages(spark, sf_dir)))
    return bad.select("source", "row_num", "reason", "raw")


def quarantine_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.reject_counts(validate.checked_messages(raw_messages(spark, sf_dir)))


def validate_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest counters where the queue refuses signups."""
    checked = validate.checked_messages(raw_messages(spark, sf_dir))
    return reports.ingest_tally(checked, F.col("metric") != "signup")


def event_id_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_series(spark, sf_dir).select("event_id", "metric", "event_us", "value")


def dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both copies of a doubly ingested table; each event stays once."""
    events = event_series(spark, sf_dir).select("event_id", "metric", "event_us", "value", "meta_json")
    return validate.deduplicate(events.unionByName(events))


def dedupe_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments of equal flag, day and price share an id."""
    events = shipment_series(spark, sf_dir).select("event_id", "metric", "event_us", "value")
    return validate.deduplicate(events).select("metric", "event_us", "value")


def backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = event_series(spark, sf_dir)
    return reports.backlog_size(raw, raw.filter(F.col("event_us") < AS_OF_US))


def run_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs: status from the order status, counts from line items."""
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.sum(F.col("l_quantity")).cast("bigint").alias("anomaly_count"),
    )
    status = (
        F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "running").otherwise("parked")
    )
    runs = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").fillna(0, ["event_count", "anomaly_count"]).select(
        F.col("o_orderkey").alias("run_id"), "event_count", (F.col("anomaly_count") - 20).alias("anomaly_count"),
        status.alias("status"),
    )
    return validate.run_violations(runs)


def status_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("event_id"),
        F.when(F.col("o_orderstatus") == "F", "processed").when(F.col("o_orderstatus") == "O", "pending").otherwise("lost").alias("status"),
    )
    return validate.status_violations(stored, ("pending", "processed", "failed"), "event_id")


def result_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("event_id"), F.round(F.col("l_tax") * 20 - 0.1, 2).alias("anomaly_score")
    )
    return validate.result_violations(results)


def empty_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as announced batches, their orders as the events."""
    batches = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("batch_id"))
    events = table(spark, sf_dir, "orders")
    return validate.empty_batches(batches, events.select(F.col("o_custkey").alias("batch_id")))


# --- summaries ---------------------------------------------------------------------------------


def distinct_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.distinct_metrics(event_series(spark, sf_dir))


def batch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch per day of orders."""
    batches = order_series(spark, sf_dir).withColumn("batch_id", F.date_format("event_ts", "yyyy-MM-dd"))
    return reports.batch_metrics(batches).withColumn("metrics", F.array_join("metrics", ","))


def tracked_metric_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.tracked_metric_count(event_series(spark, sf_dir))


def dashboard_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.dashboard_counters(_records(spark, sf_dir), F.timestamp_micros(F.lit(AS_OF_US)), 5 * 86400)


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per day; a very high value fails its run, the newest day is still pending."""
    day = F.date_format(F.timestamp_micros("event_us"), "yyyy-MM-dd")
    events = event_series(spark, sf_dir).withColumn("run_id", day)
    status = F.when(F.col("value") > 350, "failed").when(F.col("run_id") == "2024-01-30", "pending").otherwise("processed")
    return reports.run_summary(events.withColumn("status", status), _records(spark, sf_dir).withColumn("run_id", day))


def processor_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over the mixed messages, which are checked once and stored."""
    checked = sinks.stored(validate.checked_messages(raw_messages(spark, sf_dir)), "checked")
    good = validate.valid(checked)
    waiting = validate.backlog(good, good.filter(F.col("event_us") < AS_OF_US))
    durations = table(spark, sf_dir, "events").select(F.col("event_id").alias("at"), F.col("value").alias("duration_ms"))
    detector = ZScoreDetector(2.0, 5)
    found = detectors.detect(good, detector, WINDOW_US, F.timestamp_micros("event_us")).select("anomaly_id", "event_us")
    found = sinks.stored(found, "found")
    log = alerts.alert_log(alerts.rate_limit(found, ALERT_US, "event_us"))
    summary = reports.processor_summary(checked, found, waiting, durations, log, detector.params())
    return _settle(summary, "avg_processing_time_ms")


def fifo_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.fifo(event_series(spark, sf_dir)).select("metric", "event_us", "value")


# --- alerts ------------------------------------------------------------------------------------


def _limited(spark: SparkSession, sf_dir: str, key: str | None = None) -> DataFrame:
    found = _records(spark, sf_dir).select("anomaly_id", "metric", "value", "event_us")
    return alerts.rate_limit(found, ALERT_US, "event_us", key)


def alert_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _limited(spark, sf_dir).select("metric", "event_us", "value", "sent")


def alert_rate_limit_by_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _limited(spark, sf_dir, "metric").select("metric", "event_us", "value", "sent")


def alert_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.alert_tally(alerts.alert_log(_limited(spark, sf_dir)))


def alert_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.alert_text(_for_text(_records(spark, sf_dir), "mean", "stddev", "z_score"))


def alert_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = alerts.alert_details(_for_text(_records(spark, sf_dir), "mean", "stddev", "z_score"))
    return _settle(shown, "deviation")


def alert_recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.fan_out(_records(spark, sf_dir).select("anomaly_id"), ADDRESSES)


def display_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of both methods; percentile records have no z-score to show."""
    found = detectors.detect_all(event_series(spark, sf_dir), [ZSCORE, BAND], WINDOW_US, F.timestamp_micros("event_us"))
    return alerts.display_rows(_for_text(found, "mean", "stddev", "z_score"))


def alert_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _records(spark, sf_dir).select("anomaly_id", "metric", "value", "event_us", "window_count")
    return alerts.channel_messages(found)


# --- sources and sinks -------------------------------------------------------------------------


def topic_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = kafka.keyed_messages(event_series(spark, sf_dir))
    return keyed.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def _written_files(spark: SparkSession, sf_dir: str) -> str:
    """The events table as files below one folder: CSV, tab-separated text, and JSON lines."""
    root = sinks.scratch_dir(spark, "files")
    rows = event_series(spark, sf_dir).select(
        "metric", F.when(F.col("value") > 300, "n/a").otherwise(F.col("value").cast("string")).alias("value"),
        F.concat(micros_to_iso("event_us"), F.lit("Z")).alias("timestamp"), F.col("meta_json").alias("meta"),
    )
    by_format = lambda *names: rows.filter(F.col("metric").isin(*names))
    by_format("click", "view").select("timestamp", "meta", "value", "metric").write.option("header", "true").option(
        "escape", '"'
    ).csv(f"{root}/a")
    by_format("error").select(F.concat_ws("\t", "metric", "value", "timestamp", "meta")).write.text(f"{root}/b")
    message = F.to_json(F.struct("timestamp", "metric", "value", F.try_parse_json("meta").alias("meta")))
    by_format("purchase", "signup").select(message).write.text(f"{root}/c")
    return root


def _file_scan(spark: SparkSession, sf_dir: str) -> tuple[files.FileScan, DataFrame]:
    root = _written_files(spark, sf_dir)
    scan = files.read_csv(spark, [f"{root}/a"]).union(files.read_txt(spark, [f"{root}/b"]))
    # Spark names files it writes as text .txt, also those that hold JSON lines
    return scan, files.read_jsonl(spark, [f"{root}/c"], "*.txt")


def file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan, lines = _file_scan(spark, sf_dir)
    checked = scan.checked().unionByName(lines)
    return validate.valid(checked).select("metric", "event_us", "value", "meta_json")


def csv_quoted_newlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV records whose quoted metadata run over several lines."""
    root = sinks.scratch_dir(spark, "quoted")
    meta = F.concat(F.lit('{\n"p":\n'), F.col("meta_json"), F.lit("\n}"))
    rows = event_series(spark, sf_dir).select(
        meta.alias("meta"), "metric", F.col("value").cast("string").alias("value"), F.concat(micros_to_iso("event_us"), F.lit("Z")).alias("timestamp")
    )
    rows.repartition(8).write.option("header", "true").option("escape", '"').csv(root)
    return validate.valid(files.read_csv(spark, [root]).checked()).select("metric", "event_us", "value", "meta_json")


def json_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON array of events per file, a file per hour."""
    root = sinks.scratch_dir(spark, "json")
    item = F.struct(
        F.concat(micros_to_iso("event_us"), F.lit("Z")).alias("timestamp"), "metric", "value", F.try_parse_json("meta_json").alias("meta")
    )
    hours = event_series(spark, sf_dir).groupBy(F.floor(F.col("event_us") / HOUR_US).alias("hour")).agg(F.collect_list(item).alias("items"))
    hours.select(F.to_json("items")).write.option("maxRecordsPerFile", 1).text(root)
    scan = files.read_json(spark, [root], "*.txt")
    return validate.valid(scan.checked()).select("metric", "event_us", "value", "meta_json")


def upload_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome of every uploaded file: one per metric and day, and two paths that cannot be read."""
    root = sinks.scratch_dir(spark, "uploads")
    rows = event_series(spark, sf_dir).select(
        F.col("metric").alias("kind"), F.date_format("event_ts", "yyyy-MM-dd").alias("day"), "metric",
        F.when(F.col("value") > 150, "n/a").otherwise(F.col("value").cast("string")).alias("value"),
        F.concat(micros_to_iso("event_us"), F.lit("Z")).alias("timestamp"),
    )
    rows.repartition("kind", "day").write.partitionBy("kind", "day").option("header", "true").csv(root)
    scan = files.read_files(spark, [root, f"{root}/absent.csv", f"{root}.v1/data.xml"])
    report = reports.upload_summary(scan.checked(), scan.files)
    name = F.regexp_extract("source", r"(kind=[^/]+/day=[^/]+|absent\.csv|data\.xml)", 1)
    return report.select(
        name.alias("file"), "success", "total_rows", "success_count", "error_count",
        F.coalesce(F.size("errors"), F.lit(0)).alias("errors_listed"), "errors_note", "file_error",
    )


def upload_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan, lines = _file_scan(spark, sf_dir)
    listed = scan.files.unionByName(
        lines.select("source").distinct().withColumn("error", F.lit(None).cast("string"))
    )
    bulk = reports.bulk_summary(reports.upload_summary(scan.checked().unionByName(lines), listed))
    return bulk.filter("level = 'total'").select("total_success_count", "total_error_count")


def result_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records saved, then all saved again by a later batch; one row per id comes back."""
    path = sinks.scratch_dir(spark, "results")
    found = _records(spark, sf_dir)
    sinks.upsert_results(found, path, 0)
    sinks.upsert_results(found.withColumn("window_count", F.col("window_count") + 1000), path, 1)
    stored = sinks.only_anomalies(sinks.read_results(spark, path))
    return stored.select("anomaly_id", "metric", "event_us", "value", "window_count")


def result_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record with the smallest id, looked up in a store of two batches that was compacted."""
    path = sinks.scratch_dir(spark, "results")
    found = _records(spark, sf_dir)
    sinks.upsert_results(found, path, 0)
    sinks.upsert_results(found.withColumn("window_count", F.col("window_count") + 1000), path, 1)
    sinks.compact_results(spark, path, f"{path}-compact", 2)
    wanted = sinks.read_results(spark, path).agg(F.min("anomaly_id")).first()[0]
    stored = sinks.result_by_id(spark, f"{path}-compact", wanted or "anomaly-")
    return stored.select("anomaly_id", "metric", "event_us", "value", "window_count")


def retention_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw table rewritten without old events, a cleared copy of it, and that copy filled again."""
    path = sinks.scratch_dir(spark, "raw")
    sinks.append_events(event_series(spark, sf_dir), path)
    sinks.rewrite_retained(spark, path, f"{path}-kept", AS_OF_US - WINDOW_US)
    sinks.clear(spark, path, f"{path}-cleared")
    kept = spark.read.parquet(f"{path}-kept")
    both = kept.select("metric", "event_us", "value").unionByName(spark.read.parquet(f"{path}-cleared").select("metric", "event_us", "value"))
    return both


def event_store_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw table written by day, then ten days of it read back."""
    path = sinks.scratch_dir(spark, "raw")
    sinks.append_events(event_series(spark, sf_dir), path)
    stored = sinks.events_between(spark, path, AS_OF_US - 5 * DAY_US, AS_OF_US + 5 * DAY_US)
    return stored.select("metric", "event_us", "value")


# --- streams -----------------------------------------------------------------------------------


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs.table_stream(spark, sf_dir, "events.parquet")
    return events_from_table(rows, "event_type", "ts", "value", "props", "events")


def _run(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    query = (
        df.writeStream.format("parquet")
        .option("path", f"{path}/out")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")


def stream_window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-time stream; events after the last watermark (one hour before the newest) still wait."""
    stateful.use_rocksdb(spark)
    scored = stateful.score_stream(_event_stream(spark, sf_dir), WINDOW_US, "event_time", "1 hour")
    return _stats_columns(_run(scored, sinks.scratch_dir(spark, "stream")), "metric", "event_us", "value")


def _in_turns(spark: SparkSession, sf_dir: str, path: str, turns: range, of: int) -> None:
    """Add stretches of the events table to a folder, one file and one later write each."""
    span = table(spark, sf_dir, "events").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    if span["lo"] is None:
        return
    lo, hi = (F.unix_micros(F.lit(t).cast("timestamp")) for t in span)
    turn = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - lo) * of / (hi - lo + 1))
    for n in turns:
        table(spark, sf_dir, "events").filter(turn == n).coalesce(1).sortWithinPartitions("ts").write.mode("append").parquet(path)


def stream_restarted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window statistics over six batches: three, a stop, three more and a closing event from the same checkpoint.

    The closing event, two days later and of a metric of its own, moves the watermark past all waiting ones.
    """
    stateful.use_rocksdb(spark)
    path = sinks.scratch_dir(spark, "stream")
    schema = table(spark, sf_dir, "events").schema
    for turns in (range(0, 3), range(3, 6)):
        _in_turns(spark, sf_dir, f"{path}/in", turns, 6)
        if turns.stop == 6:
            newest = table(spark, sf_dir, "events").agg((F.max("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts"))
            closing = [F.lit("closing") if f.name == "event_type" else F.col("ts") if f.name == "ts" else F.lit(0) if f.name == "value" else F.lit(None) for f in schema]
            newest.select(*(c.cast(f.dataType).alias(f.name) for c, f in zip(closing, schema))).write.mode("append").parquet(f"{path}/in")
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        events = events_from_table(rows, "event_type", "ts", "value", "props", "events")
        scored = _run(stateful.score_stream(events, WINDOW_US, "event_time", "1 hour"), path)
    return _stats_columns(scored.filter("metric <> 'closing'"), "metric", "event_us", "value")


def stream_arrival_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrival-order stream; the table is in time order, so every window is the event-time one."""
    found = jobs.detect_stream(_event_stream(spark, sf_dir), ZSCORE, WINDOW_US, "arrival")
    return _flagged_z(_run(found, sinks.scratch_dir(spark, "stream")).filter("is_anomaly"))


def stream_percentile_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jobs.detect_stream(_event_stream(spark, sf_dir), BAND, WINDOW_US, "event_time", "1 hour")
    flagged = _run(found, sinks.scratch_dir(spark, "stream")).filter("is_anomaly")
    return flagged.select("metric", "event_us", "value", "window_count", "lower_bound", "upper_bound")


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages land as files, are checked in a stream, and are read back from the raw table."""
    root = sinks.scratch_dir(spark, "ingest")
    raw_messages(spark, sf_dir).select("raw").write.text(f"{root}/in")
    stream = jobs.checked_stream(jobs.message_files(spark, f"{root}/in", GaugeConfig(), "*.txt"))
    jobs.start(
        stream, jobs.ingest_handler(f"{root}/events", f"{root}/bad"), f"{root}/checkpoint", available_now=True
    ).awaitTermination()
    good = spark.read.parquet(f"{root}/events").groupBy("metric").agg(F.count(F.lit(1)).alias("rows"))
    rejected = sinks.read_store(spark, f"{root}/bad", jobs.QUARANTINE_SCHEMA)
    bad = rejected.groupBy(F.col("reason").alias("metric")).agg(F.count(F.lit(1)).alias("rows"))
    return good.unionByName(bad)


def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the table of batch progress says of an ingest in many small batches, however many there are."""
    root = sinks.scratch_dir(spark, "progress")
    raw_messages(spark, sf_dir).select("raw").write.option("maxRecordsPerFile", 1_000_000).text(f"{root}/in")
    stream = jobs.checked_stream(jobs.message_files(spark, f"{root}/in", GaugeConfig(max_files_per_trigger=1), "*.txt"))
    with progress.ProgressLog(spark, f"{root}/log") as log:
        handle = jobs.ingest_handler(f"{root}/events", f"{root}/bad")
        query = jobs.start(stream, handle, f"{root}/checkpoint", available_now=True)
        query.awaitTermination()
        log.wait(query)
    mine = progress.read_progress(spark, f"{root}/log").filter(F.col("query_id") == str(query.id))
    counted = [F.coalesce(F.sum(F.col("observed")[f"ingest_{c}"]), F.lit(0)).cast("bigint").alias(c) for c in ("consumed", "valid", "invalid")]
    return mine.agg(F.coalesce(F.sum("late_rows"), F.lit(0)).alias("late_rows"), *counted)


def stream_micro_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection by micro-batch against the stored window, without keyed state."""
    root = sinks.scratch_dir(spark, "micro")
    sinks.ensure_store(spark, f"{root}/results", ANOMALY_SCHEMA)
    handler = jobs.micro_batch_handler(f"{root}/events", f"{root}/results", ZSCORE, WINDOW_US)
    jobs.start(_event_stream(spark, sf_dir), handler, f"{root}/checkpoint", available_now=True).awaitTermination()
    return _flagged_z(sinks.read_results(spark, f"{root}/results"))


def stream_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records arrive in three batches, oldest first; the feed of the last one is the newest hundred."""
    root = sinks.scratch_dir(spark, "feed")
    found = _records(spark, sf_dir).select("anomaly_id", "metric", "value", "event_us", "detected_at")
    for low, high in ((None, AS_OF_US - 5 * DAY_US), (AS_OF_US - 5 * DAY_US, AS_OF_US + 5 * DAY_US), (AS_OF_US + 5 * DAY_US, None)):
        part = F.lit(True) if low is None else F.col("event_us") >= low
        part = part if high is None else part & (F.col("event_us") < high)
        found.filter(part).coalesce(1).write.mode("append").parquet(f"{root}/in")
    arriving = spark.readStream.schema(found.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    jobs.start(arriving, jobs.feed_handler(f"{root}/feed"), f"{root}/checkpoint", available_now=True).awaitTermination()
    return jobs.read_feed(spark, f"{root}/feed", found.schema).select("anomaly_id", "metric", "value", "event_us")


def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records flow through the limiter and out to two channels; the log is tallied."""
    root = sinks.scratch_dir(spark, "alerts")
    _records(spark, sf_dir).select("anomaly_id", F.col("event_us").alias("at")).write.parquet(f"{root}/in")
    stateful.use_rocksdb(spark)
    arriving = spark.readStream.schema("anomaly_id string, at bigint").parquet(f"{root}/in")
    limited = stateful.rate_limit_stream(arriving, ALERT_US)
    channels = {n: jobs.channel_writer(f"{root}/{n}", n) for n in ("anomalies", "email")}
    sinks.ensure_store(spark, f"{root}/log", jobs.ALERT_LOG_SCHEMA)
    handler = jobs.fan_out_handler(channels, f"{root}/log")
    jobs.start(limited, handler, f"{root}/checkpoint", available_now=True).awaitTermination()
    return reports.alert_tally(sinks.read_store(spark, f"{root}/log", jobs.ALERT_LOG_SCHEMA))


def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event twice in the stream, kept once."""
    stateful.use_rocksdb(spark)
    events = _event_stream(spark, sf_dir)
    once = validate.deduplicate_stream(events.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))), "1 hour")
    stored = _run(once.select("metric", "event_us", "value"), sinks.scratch_dir(spark, "dedupe"))
    return stored.select("metric", "event_us", "value")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        window_stats, window_stats_sliced, window_stats_bucketed, window_stats_frame, window_stats_tied,
        snapshot_stats, snapshot_stats_listed, latest_state, retention, retention_one_metric, rolling_mean,
        zscore_anomalies, zscore_scores, zscore_anomalies_orders, percentile_anomalies,
        percentile_anomalies_thinned, percentile_with_nulls, window_percentiles, detector_tally, candidate_scores,
        candidate_snapshot_scores, anomaly_records, recent_anomalies, live_feed, validated_events, quarantine,
        quarantine_reasons, validate_tally, event_id_hash, dedupe, dedupe_shipments, backlog, run_rules,
        status_rules, result_rules, empty_batches, distinct_metrics, batch_metrics, tracked_metric_count,
        dashboard_counters, run_summary, processor_summary, fifo_order, alert_rate_limit,
        alert_rate_limit_by_metric, alert_tally, alert_text, alert_details, alert_recipients, display_rows,
        alert_messages, topic_messages, file_events, csv_quoted_newlines, json_files, upload_report, upload_totals,
        result_store, result_by_id, retention_rewrite, event_store_range, stream_restarted,
        stream_window_stats, stream_arrival_scores, stream_percentile_anomalies, stream_ingest,
        stream_progress, stream_micro_batches, stream_feed, stream_alerts, stream_dedupe,
    )
}
