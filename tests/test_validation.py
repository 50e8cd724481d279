from __future__ import annotations

import hashlib
import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from pulsegauge.functions.identity import number_text
from pulsegauge.functions.timestamps import add_event_micros, micros_to_iso
from pulsegauge.operators import reports, validate

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)

ISO_TEXTS = [
    "2024", "2024-01", "2024-01-15", "20240115", "20240115T101112", "2024-01-15T10", "2024-01-15 10:11",
    "2024-01-15T10:11:12", "2024-01-15T10:11:12.5", "2024-01-15T10:11:12.123456789", "2024-01-15T10:11:12,25",
    "2024-01-15T10:11:12+05:30", "2024-01-15T10:11:12-0800", "2024-01-15T10:11:12Z", "2024-01-15T10:11:12+05",
    "2024-13-15", "2024-02-30", "2024-02-29", "2023-02-29", "2024-01-15T24:00:00", "2024-01-15T10:60",
    "2024-01-15T10:11:60", "2024-W03-2", "2024-W03", "2024W032T1011", "2020-W53-1", "2024-W53-1", "2024-01-15T",
    "2024-01-15T10:11:12+25:00", "2024-01-15T1011:12", "0001-01-01", "0000-01-01", "2024-01-15Z", "abc", "",
    "1969-12-31T23:59:59.5", "2024-01-15T10:11:12+05:30:15", "1999-06-01T00:00:00", "1700478600", "1700478600.0",
]


def _python_micros(text):
    try:
        parsed = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        return None
    parsed = parsed if parsed.tzinfo else parsed.replace(tzinfo=timezone.utc)
    return (parsed - EPOCH) // timedelta(microseconds=1)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_iso_text_in_every_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = add_event_micros(spark.createDataFrame([(t,) for t in ISO_TEXTS], "s string"), "s", F.lit(False), "us")
        got = {r.s: (r.us, r.iso) for r in df.withColumn("iso", micros_to_iso("us")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    for text in ISO_TEXTS:
        micros = _python_micros(text)
        assert got[text][0] == micros, text
        if micros is not None:
            assert got[text][1] == (EPOCH + timedelta(microseconds=micros)).replace(tzinfo=None).isoformat()


def test_number_text_and_event_id(spark):
    numbers = [0.0, 1.0, -1.5, 0.001, 0.0001, 0.00012345, 1e-5, 1.5e-7, 1e7, 123456789.125, 1e15, 1e16, 1.5e22, -2.5e-10, 1e100, -1e7]
    rows = spark.createDataFrame([(n,) for n in numbers], "v double").select("v", number_text("v").alias("t")).collect()
    assert [(r.t) for r in rows] == [repr(r.v) for r in rows]
    from pulsegauge.functions.identity import event_id

    df = spark.createDataFrame([("cpu", 1700478600250000, 75.5), ("m", 1700478600000000, 1e7)], "metric string, event_us bigint, value double")
    for r in df.select("*", event_id("metric", "event_us", "value").alias("id")).collect():
        assert r.id == hashlib.sha256(f"{r.metric}:{r.event_us / 1e6}:{r.value}".encode()).hexdigest()[:16]


OK = '{"timestamp": "2023-11-20T10:30:00", "metric": "cpu", "value": %s}'
MESSAGES = [
    (OK % 75.5, None),
    ('{"timestamp": 1700478600.0, "metric": "cpu", "value": 7}', None),
    ('{"timestamp": 1700478600, "metric": "cpu", "value": "7"}', None),
    ('{"timestamp": "2023-11-20T10:30:00Z", "metric": 5, "value": true, "meta": null}', None),
    ('{"value": "x", "timestamp": 1, "metric": "cpu", "timestamp": 1700478600, "value": 7}', None),
    ('{"value": 7, "timestamp": 1700478600, "metric": "cpu", "value": "x"}', "value_type"),
    ("{invalid json", "invalid_json"),
    ("", "invalid_json"),
    ("[1]", "not_an_object"),
    ('"text"', "not_an_object"),
    ('{"timestamp": "2023-11-20T10:30:00"}', "missing_field"),
    ('{"timestamp": null, "metric": "cpu", "value": 1}', "missing_field"),
    ('{"timestamp": "2023-11-20T10:30:00", "metric": "", "value": 1}', "metric_length"),
    ('{"timestamp": "2023-11-20T10:30:00", "metric": "%s", "value": 1}' % ("x" * 256), "metric_length"),
    ('{"timestamp": "2023-11-20T10:30:00", "metric": "%s", "value": 1}' % ("x" * 255), None),
    ('{"timestamp": "2023-11-20T10:30:00", "metric": {"a": 1}, "value": 1}', "metric_type"),
    ('{"timestamp": "invalid-timestamp", "metric": "cpu", "value": 1}', "timestamp_format"),
    ('{"timestamp": "1700478600.0", "metric": "cpu", "value": 1}', "timestamp_format"),
    ('{"timestamp": 100.0, "metric": "cpu", "value": 1}', "timestamp_range"),
    ('{"timestamp": 4102444801, "metric": "cpu", "value": 1}', "timestamp_range"),
    ('{"timestamp": 946684800, "metric": "cpu", "value": 1}', None),
    ('{"timestamp": true, "metric": "cpu", "value": 1}', "timestamp_type"),
    (OK % '"abc"', "value_type"),
    (OK % '"1d"', "value_type"),
    (OK % "[1]", "value_type"),
    (OK % '"nan"', "value_not_finite"),
    (OK % '"-inf"', "value_not_finite"),
    (OK % "1e309", "value_not_finite"),
    (OK % "1.5e308", "value_not_finite"),
    (OK % "1e308", None),
    (OK % "-1000000.0", None),
    (OK % "1e-6", None),
    ('{"timestamp": "2023-11-20T10:30:00", "metric": "cpu", "value": 1, "meta": [1]}', "meta_not_object"),
    ('{"timestamp": "2023-11-20T10:30:00", "metric": "cpu", "value": 1, "meta": "x"}', "meta_not_object"),
    (json.dumps({"timestamp": "2023-11-20T10:30:00", "metric": "cpu", "value": 1, "meta": {f"k{i}": i for i in range(100)}}), None),
]


def test_message_checks(spark):
    df = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(MESSAGES)], "row_num bigint, raw string")
    checked = validate.checked_messages(df)
    got = {r.row_num: r.reason for r in checked.collect()}
    for i, (message, reason) in enumerate(MESSAGES):
        assert got[i] == reason, message
    tally = reports.ingest_tally(checked).first()
    good = sum(reason is None for _, reason in MESSAGES)
    assert (tally.consumed, tally.valid, tally.invalid, tally.pushed, tally.failed) == (len(MESSAGES), good, len(MESSAGES) - good, good, 0)
    assert validate.valid(checked).count() == good
    assert validate.quarantine(checked).count() == len(MESSAGES) - good


def test_meta_is_carried_and_round_trips(spark):
    meta = {"host": "a", "tags": [1, {"z": None}], "text": 'q"uote'}
    raw = json.dumps({"timestamp": "2023-11-20T10:30:00.25Z", "metric": "cpu", "value": 1.5, "meta": meta})
    events = validate.valid(validate.checked_messages(spark.createDataFrame([(raw,)], "raw string")))
    assert json.loads(events.first().meta_json) == meta
    sent = validate.serialize(events)
    assert json.loads(sent.first().raw) == {"timestamp": "2023-11-20T10:30:00.250000", "metric": "cpu", "value": 1.5, "meta": meta}
    again = validate.valid(validate.checked_messages(sent)).first()
    assert (again.event_id, again.event_us) == (events.first().event_id, events.first().event_us)


def test_volume_messages(spark):
    rows = [(json.dumps({"timestamp": 1_900_000_000 + 7 * i, "metric": "buoy" + "abcdefg"[i % 7], "value": i * i / 4}),) for i in range(630)]
    checked = validate.checked_messages(spark.createDataFrame(rows, "raw string"))
    assert reports.ingest_tally(checked).first().valid == 630
    assert [r.metric for r in reports.distinct_metrics(validate.valid(checked)).collect()] == ["buoy" + x for x in "abcdefg"]


def test_deduplicate_keeps_one_of_each(make_events):
    events = make_events([("a", 10**15, 1.0), ("a", 10**15, 1.0), ("a", 10**15, 2.0)])
    assert validate.deduplicate(events).count() == 2


def test_contract_checks(spark):
    runs = spark.createDataFrame(
        [("a", 5, 2, "running"), ("b", 1, 2, "completed"), ("c", 1, 0, "odd"), ("d", -1, -2, "failed")],
        "run_id string, event_count bigint, anomaly_count bigint, status string",
    )
    found = {(r.key, r.rule) for r in validate.run_violations(runs).collect()}
    assert found == {("b", "anomaly_count_exceeds"), ("c", "status"), ("d", "event_count"), ("d", "anomaly_count")}
    scores = spark.createDataFrame([("x", 0.0), ("y", 1.0), ("z", 1.01), ("n", float("nan")), ("m", None)], "event_id string, anomaly_score double")
    assert {r.key for r in validate.result_violations(scores).collect()} == {"z", "n", "m"}
    states = spark.createDataFrame([("x", "pending"), ("y", "done"), ("n", None)], "event_id string, status string")
    assert {r.key for r in validate.status_violations(states, ("pending", "processed", "failed"), "event_id").collect()} == {"y", "n"}
