from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from pulsegauge.config import MICROS, GaugeConfig
from pulsegauge.operators import alerts, reports
from pulsegauge.operators.detectors import ZScoreDetector, detect
from pulsegauge.operators.validate import backlog
from pulsegauge.sources import kafka, sinks
from tests import brute

BASE = 1_700_000_000 * MICROS


@pytest.mark.parametrize(
    ("interval", "span", "n"), [(50, 20_000, 1500), (50, 200_000, 1500), (7, 1000, 600), (1000, 500_000, 150), (1, 50, 80), (3000, 2000, 40)]
)
def test_rate_limit_equals_greedy(spark, interval, span, n):
    rng = random.Random(interval * n)
    rows = [(rng.randrange(span), f"a{i:05d}", rng.choice("xyz")) for i in range(n)]
    df = spark.createDataFrame(rows, "at bigint, anomaly_id string, m string")
    sent = alerts.rate_limit(df, interval).filter("sent").collect()
    assert sorted(r.at for r in sent) == brute.greedy([r[0] for r in rows], interval)
    keyed = alerts.rate_limit(df, interval, key="m")
    assert keyed.count() == n
    for key in "xyz":
        mine = [r.at for r in keyed.filter((F.col("m") == key) & F.col("sent")).collect()]
        assert sorted(mine) == brute.greedy([r[0] for r in rows if r[2] == key], interval)


def test_blocked_past_the_first_entries(spark):
    """A send just before a chunk can block its first alerts and leave a later one to go out."""
    chunk = alerts.CHUNK_INTERVALS * 50
    times = [chunk - 20, chunk + 0, chunk + 5, chunk + 200, chunk + 240]
    df = spark.createDataFrame([(t, f"a{t}") for t in times], "at bigint, anomaly_id string")
    sent = sorted(r.at for r in alerts.rate_limit(df, 50).filter("sent").collect())
    assert sent == brute.greedy(times, 50) == [chunk - 20, chunk + 200]


def test_fixed_cadence_over_many_levels(spark, monkeypatch):
    """Alerts at a fixed distance: chains never meet, and every level above composes chunks."""
    monkeypatch.setattr(alerts, "FAN_IN", 3)
    monkeypatch.setattr(alerts, "CHUNK_INTERVALS", 4)
    for step, interval in ((3, 50), (7, 50), (50, 50), (13, 40)):
        times = [1_000 + step * i for i in range(1500)] + [90_000, 90_020, 90_051]
        df = spark.createDataFrame([(t, f"a{t:06d}") for t in times], "at bigint, anomaly_id string")
        assert sorted(r.at for r in alerts.rate_limit(df, interval).filter("sent").collect()) == brute.greedy(times, interval)
    empty = df.filter("at < 0")
    assert alerts.rate_limit(empty, 50).count() == 0


def test_interval_bounds(spark):
    df = spark.createDataFrame([(0, "a"), (0, "b"), (2_000_000, "c"), (2_100_000, "d")], "at bigint, anomaly_id string")
    assert {r.anomaly_id for r in alerts.rate_limit(df, 2_000_000).filter("sent").collect()} == {"a", "c"}
    assert alerts.rate_limit(df, 0).filter("sent").count() == 4
    with pytest.raises(ValueError):
        alerts.rate_limit(df, -1)


@pytest.fixture
def records(make_events):
    values = [*range(50, 60), 200]
    events = make_events([("cpu", BASE + i * MICROS, float(v)) for i, v in enumerate(values)])
    return detect(events, ZScoreDetector(2.5), 300 * MICROS, F.timestamp_micros(F.lit(BASE)))


def test_alert_texts(records):
    text = alerts.alert_text(records).first()
    assert text.subject == "Anomaly Alert: cpu"
    lines = text.body.split("\n")
    assert "Value: 200.00" in lines and "Z-Score: 3.01" in lines and "Threshold: 2.50" in lines
    assert "Detection Method: z-score" in lines and "Timestamp: 2023-11-14T22:13:30" in lines and any(x.startswith("Detected At: 2") for x in lines)
    detail = alerts.alert_details(records).first()
    assert detail.detected == "2023-11-14 22:13:30"
    assert detail.deviation_label == "132.27 (3.0σ)"
    shown = alerts.display_rows(records.withColumn("z_score", F.lit(None).cast("double")).withColumn("metric", F.lit(None).cast("string"))).first()
    assert (shown.metric_text, shown.value_text, shown.z_score_text) == ("Unknown", "200.00", "N/A")


def test_two_decimals_round_the_binary_value(spark):
    from pulsegauge.functions.formatting import two_decimals

    numbers = [1.005, 0.125, 12.345, 12.335, 2.675, -0.5, 1234567.891, 0.0]
    rows = spark.createDataFrame([(n,) for n in numbers], "v double").select("v", two_decimals("v").alias("t")).collect()
    assert [r.t for r in rows] == [f"{r.v:.2f}" for r in rows]


def test_recipients_messages_and_log(records):
    sent = alerts.fan_out(records.select("anomaly_id"), " a@x.org, ,b@x.org,").collect()
    assert [r.recipient for r in sent] == ["a@x.org", "b@x.org"]
    message = alerts.channel_messages(records).first()
    assert message.channel == "anomalies" and json.loads(message.value)["value"] == 200.0
    log = alerts.alert_log(records.withColumn("sent", F.lit(False)))
    assert reports.alert_tally(log).first().asDict() == {"total_broadcasted": 1, "total_emails_sent": 0, "total_errors": 0}


def test_recent_order_and_limit(spark):
    rows = [(f"anomaly-{i:02d}", "m", 1.0, 3.0, i // 2, i != 5) for i in range(20)]
    df = spark.createDataFrame(rows, "anomaly_id string, metric string, value double, z_score double, s bigint, is_anomaly boolean")
    df = df.withColumn("detected_at", F.timestamp_seconds("s")).withColumn("timestamp", F.col("detected_at"))
    got = [r.event_id for r in reports.recent_anomalies(df, 4).collect()]
    assert got == ["anomaly-18", "anomaly-19", "anomaly-16", "anomaly-17"]
    assert reports.recent_anomalies(df).count() == 19
    plan = reports.recent_anomalies(df, 4)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_live_feed_keeps_the_newest(spark):
    rows = [(f"a{i:02d}", i) for i in range(30)]
    df = spark.createDataFrame(rows, "anomaly_id string, s bigint").withColumn("detected_at", F.timestamp_seconds("s"))
    feed = reports.live_feed(df.filter("s < 20"), df.filter("s >= 15"), keep=10)
    assert [r.anomaly_id for r in feed.collect()] == [f"a{i:02d}" for i in range(29, 19, -1)]


def test_dashboard_counter_is_strict(spark):
    df = spark.createDataFrame([(0,), (1,), (30,)], "s bigint").withColumn("detected_at", F.timestamp_seconds("s"))
    got = reports.dashboard_counters(df, F.timestamp_seconds(F.lit(61)))
    assert got.first().asDict() == {"total_anomalies": 3, "recent_anomalies": 1}


def test_rolling_mean_equals_frame(make_events):
    rng = random.Random(6)
    rows = [("ab"[i % 2], BASE + rng.randrange(5000), float(i)) for i in range(400)]
    got = reports.rolling_mean(make_events(rows), "metric", ["event_us", "event_id"], "value", rows=25).collect()
    for metric in "ab":
        mine = sorted((r.event_us, r.event_id, r.value, r.rolling_mean) for r in got if r.metric == metric)
        for i, (_, _, _, mean) in enumerate(mine):
            part = [v for _, _, v, _ in mine[max(0, i - 24) : i + 1]]
            assert mean == pytest.approx(sum(part) / len(part))


def test_result_store(spark, records, tmp_path):
    path = str(tmp_path / "results")
    sinks.upsert_results(records, path, 0)
    sinks.upsert_results(records, path, 0)
    sinks.upsert_results(records.withColumn("value", F.lit(-1.0)), path, 1)
    stored = sinks.read_results(spark, path)
    assert [r.value for r in stored.collect()] == [-1.0]
    found = sinks.result_by_id(spark, path, stored.first().anomaly_id)
    assert found.count() == 1
    assert "PushedFilters: [IsNotNull(anomaly_id), EqualTo(anomaly_id" in found._jdf.queryExecution().executedPlan().toString()
    assert sinks.result_by_id(spark, path, "nope").count() == 0
    assert sinks.only_anomalies(stored).count() == 1


def test_result_store_without_results(spark, records, tmp_path):
    path = str(tmp_path / "results")
    sinks.upsert_results(records.filter("false"), path, 0)
    assert sinks.read_results(spark, path).count() == 0
    assert sinks.result_by_id(spark, path, "x").count() == 0
    sinks.upsert_results(records, path, 1)
    assert sinks.read_results(spark, path).count() == 1


def test_event_store(spark, make_events, tmp_path):
    path, day = str(tmp_path / "raw"), 86400 * MICROS
    events = make_events([("m", BASE + i * day, float(i)) for i in range(10)])
    sinks.append_events(events, path, batch_id=7)
    sinks.append_events(events, path, batch_id=7)
    assert spark.read.parquet(path).count() == 10
    some = sinks.events_between(spark, path, BASE + 2 * day, BASE + 4 * day)
    assert sorted(r.value for r in some.collect()) == [2.0, 3.0, 4.0]
    assert "PartitionFilters: [isnotnull(event_date" in some._jdf.queryExecution().executedPlan().toString()
    assert backlog(events, some).count() == 7
    sinks.rewrite_retained(spark, path, str(tmp_path / "kept"), BASE + 6 * day)
    assert sorted(r.value for r in spark.read.parquet(str(tmp_path / "kept")).collect()) == [6.0, 7.0, 8.0, 9.0]
    sinks.clear(spark, path, str(tmp_path / "empty"))
    assert spark.read.parquet(str(tmp_path / "empty")).count() == 0


def test_topic_mapping(make_events):
    config = GaugeConfig(kafka_bootstrap_servers="b:1", kafka_topic="t", kafka_starting_offsets="latest", max_offsets_per_trigger=5)
    assert kafka.source_options(config) == {
        "kafka.bootstrap.servers": "b:1", "subscribe": "t", "startingOffsets": "latest", "maxOffsetsPerTrigger": "5", "failOnDataLoss": "true",
    }
    assert "maxOffsetsPerTrigger" not in kafka.source_options(GaugeConfig())
    assert kafka.source_options(config.with_(fail_on_data_loss=False))["failOnDataLoss"] == "false"
    assert kafka.sink_options(config, "out") == {"kafka.bootstrap.servers": "b:1", "topic": "out"}
    row = kafka.keyed_messages(make_events([("cpu", BASE, 1.0)])).first()
    assert bytes(row.key) == b"cpu" and json.loads(bytes(row.value)) == {"timestamp": "2023-11-14T22:13:20", "metric": "cpu", "value": 1.0}


def test_topic_rows_become_messages(spark):
    from pulsegauge.operators.validate import checked_messages

    rows = spark.createDataFrame(
        [("t", 0, 5, bytearray(b'{"timestamp": 1700478600, "metric": "cpu", "value": 1}')), ("t", 1, 9, bytearray(b"{bad"))],
        "topic string, partition int, offset bigint, value binary",
    )
    got = {(r.source, r.row_num): r.reason for r in checked_messages(kafka.messages(rows)).collect()}
    assert got == {("t/0", 5): None, ("t/1", 9): "invalid_json"}


def test_run_and_batch_summaries(spark):
    events = spark.createDataFrame(
        [("r1", 1, "processed", "b"), ("r1", 5, "processed", "a"), ("r2", 2, "pending", "a"), ("r3", 3, "failed", "c")],
        "run_id string, event_us bigint, status string, metric string",
    )
    found = spark.createDataFrame([("r1",)], "run_id string")
    got = {r.run_id: (r.event_count, r.anomaly_count, r.started_us, r.completed_us, r.status) for r in reports.run_summary(events, found).collect()}
    assert got == {"r1": (2, 1, 1, 5, "completed"), "r2": (1, 0, 2, None, "running"), "r3": (1, 0, 3, 3, "failed")}
    batches = reports.batch_metrics(events.withColumnRenamed("run_id", "batch_id")).collect()
    assert {r.batch_id: r.metrics for r in batches}["r1"] == ["a", "b"]
