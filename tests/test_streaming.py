from __future__ import annotations

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegauge.config import MICROS, GaugeConfig
from pulsegauge.operators.detectors import PercentileDetector, ZScoreDetector
from pulsegauge.operators.windows import window_stats
from pulsegauge.sources import sinks
from pulsegauge.operators import reports
from pulsegauge.streaming import jobs, progress, stateful
from tests import brute

BASE = 1_700_000_000 * MICROS
WINDOW_US = 20 * MICROS
COLUMNS = ("event_id", "event_us", "metric", "value", "window_count", "mean", "variance")


@pytest.fixture
def source(spark, tmp_path, make_events):
    """Writes batches of rows as parquet files that a stream picks up one by one."""
    folder = str(tmp_path / "in")
    state = {"n": 0}

    def add(rows):
        make_events(rows).coalesce(1).write.mode("append").parquet(f"{folder}/b={state['n']}")
        state["n"] += 1

    def read():
        schema = make_events([("m", BASE, 1.0)]).schema
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")

    add.read = read
    return add


def _drain(df, tmp_path, name="out"):
    query = (
        df.writeStream.format("parquet").option("path", str(tmp_path / name))
        .option("checkpointLocation", str(tmp_path / f"{name}-checkpoint")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query, df.sparkSession.read.schema(df.schema).parquet(str(tmp_path / name))


def _rows(seed, start, end, n=60):
    rng = random.Random(seed)
    return [(rng.choice("ab"), BASE + rng.randrange(start * 10, end * 10) * 100_000, round(rng.gauss(50, 9), 2)) for _ in range(n)]


def _compare(got, expected):
    key = lambda r: (r.event_id, r.event_us)
    got, expected = sorted(got, key=key), sorted(expected, key=key)
    assert [(key(r), r.window_count) for r in got] == [(key(r), r.window_count) for r in expected]
    for a, b in zip(got, expected):
        assert (a.mean, a.variance) == (pytest.approx(b.mean, abs=1e-9), pytest.approx(b.variance, abs=1e-7))


def test_event_time_equals_batch_and_survives_a_restart(spark, tmp_path, make_events, source):
    """Files out of order within the delay; the stream stops after two of them and goes on later."""
    stateful.use_rocksdb(spark)
    parts = [_rows(1, 0, 30), _rows(2, 20, 60), _rows(3, 50, 90), _rows(4, 80, 120)]
    for part in parts[:2]:
        source(part)
    scored = stateful.score_stream(source.read(), WINDOW_US, "event_time", "15 seconds")
    _, first = _drain(scored, tmp_path)
    held = first.count()
    assert 0 < held < 120
    for part in parts[2:]:
        source(part)
    scored = stateful.score_stream(source.read(), WINDOW_US, "event_time", "15 seconds")
    query, out = _drain(scored, tmp_path)
    rows = [r for part in parts for r in part]
    limit = (max(t for _, t, _ in rows) - 15 * MICROS) // 1000 * 1000
    expected = window_stats(make_events(rows), WINDOW_US, "frame").filter(F.col("event_us") <= limit)
    _compare(out.select(*COLUMNS).collect(), expected.select(*COLUMNS).collect())
    assert out.count() > held
    assert sum(p["late_rows"] for p in jobs.progress_rows(query)) == 0


def test_late_rows_are_dropped_and_counted(spark, tmp_path, source):
    stateful.use_rocksdb(spark)
    source([("m", BASE + 100 * MICROS, 1.0)])
    source([("m", BASE + 200 * MICROS, 2.0)])
    source([("m", BASE, 3.0), ("m", BASE + 300 * MICROS, 4.0)])
    query, out = _drain(stateful.score_stream(source.read(), WINDOW_US, "event_time", "5 seconds"), tmp_path)
    assert sorted(r.value for r in out.collect()) == [1.0, 2.0]
    assert sum(p["late_rows"] for p in jobs.progress_rows(query)) == 1


def test_arrival_order(spark, tmp_path, source):
    """A late event joins at the end of the window and is judged against newer ones."""
    stateful.use_rocksdb(spark)
    arrivals = [(0, 1.0), (15, 2.0), (30, 4.0), (12, 8.0), (33, 16.0), (60, 32.0), (61, 64.0)]
    for part in (arrivals[:3], arrivals[3:5], arrivals[5:]):
        source([("m", BASE + s * MICROS, v) for s, v in part])
    _, out = _drain(stateful.score_stream(source.read(), WINDOW_US, "arrival"), tmp_path)
    window, expected = [], {}
    for s, v in arrivals:
        window.append((s, v))
        while window[0][0] < s - 20:
            window.pop(0)
        expected[v] = brute.stats([x for _, x in window])
    got = {r.value: (r.window_count, r.mean, r.variance) for r in out.collect()}
    assert set(got) == set(expected)
    for v, (n, mean, variance) in expected.items():
        assert got[v] == (n, pytest.approx(mean), pytest.approx(variance))


def test_percentile_detector_on_a_stream(spark, tmp_path, make_events, source):
    rows = [("m", BASE + i * MICROS // 2, float((i * 37) % 40)) for i in range(200)]
    source(rows[:100])
    source(rows[100:])
    detector = PercentileDetector(10, 90, 20)
    _, out = _drain(jobs.detect_stream(source.read(), detector, WINDOW_US, "arrival"), tmp_path)
    got = out.filter("is_anomaly").select("event_us", "lower_bound", "upper_bound").collect()
    expected = detector.anomalies(make_events(rows), WINDOW_US).select("event_us", "lower_bound", "upper_bound").collect()
    assert sorted(got) == sorted(expected) and got


def test_ingest_counts_and_quarantine(spark, tmp_path):
    folder = tmp_path / "messages"
    folder.mkdir()
    good = [json.dumps({"timestamp": "2023-11-20T10:30:00", "metric": "cpu", "value": i}) for i in range(3)]
    (folder / "a.jsonl").write_text("\n".join([*good, "{bad", '{"metric": "cpu"}']) + "\n")
    stream = jobs.checked_stream(jobs.message_files(spark, str(folder), GaugeConfig()))
    handler = jobs.ingest_handler(str(tmp_path / "events"), str(tmp_path / "bad"))
    query = jobs.start(stream, handler, str(tmp_path / "checkpoint"), available_now=True, name="ingest")
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "events")).count() == 3
    bad = spark.read.parquet(str(tmp_path / "bad")).collect()
    assert sorted(r.reason for r in bad) == ["invalid_json", "missing_field"]
    progress = jobs.progress_rows(query)[0]
    assert (progress["ingest_consumed"], progress["ingest_valid"], progress["ingest_invalid"]) == (5, 3, 2)


def test_micro_batches_and_keyed_state_find_the_same(spark, tmp_path, make_events, source):
    calm = [("m", BASE + i * MICROS, 50.0 + i % 5) for i in range(40)]
    rows = sorted([*calm, ("m", BASE + 25 * MICROS + 1, 500.0), ("m", BASE + 38 * MICROS + 1, -400.0)], key=lambda r: r[1])
    source(rows[:20])
    source(rows[20:])
    detector = ZScoreDetector(3.0)
    root = str(tmp_path / "micro")
    handler = jobs.micro_batch_handler(f"{root}/events", f"{root}/results", detector, WINDOW_US)
    jobs.start(source.read(), handler, f"{root}/checkpoint", available_now=True).awaitTermination()
    stored = sinks.read_results(spark, f"{root}/results").collect()
    _, out = _drain(jobs.detect_stream(source.read(), detector, WINDOW_US, "arrival"), tmp_path)
    batch = detector.anomalies(make_events(rows), WINDOW_US).collect()
    assert {r.event_id for r in stored} == {r.event_id for r in batch} == {r.event_id for r in out.filter("is_anomaly").collect()}
    assert len(batch) == 2


def test_alert_stream_with_a_failing_channel(spark, tmp_path, source):
    stateful.use_rocksdb(spark)
    times = [0, 1, 2, 5, 6, 7, 11]
    for part in (times[:4], times[4:]):
        source([("m", BASE + t * MICROS, float(t)) for t in part])
    alerts = source.read().select(F.concat(F.lit("anomaly-"), "event_id").alias("anomaly_id"), F.col("event_us").alias("at"))

    def broken(batch, batch_id):
        raise OSError("channel is down")

    channels = {"anomalies": jobs.channel_writer(str(tmp_path / "messages"), "anomalies"), "pager": broken, "email": jobs.channel_writer(str(tmp_path / "mail"), "email")}
    handler = jobs.fan_out_handler(channels, str(tmp_path / "log"))
    jobs.start(stateful.rate_limit_stream(alerts, 5 * MICROS), handler, str(tmp_path / "checkpoint"), available_now=True).awaitTermination()
    log = spark.read.parquet(str(tmp_path / "log")).collect()
    assert len(log) == 7 and all(r.success and r.published and r.errors == 1 for r in log)
    mailed = [json.loads(r.value)["at"] for r in spark.read.parquet(str(tmp_path / "mail")).collect()]
    assert sorted((t - BASE) // MICROS for t in mailed) == brute.greedy(times, 5)


def test_mode_is_checked(source):
    source([("m", BASE, 1.0)])
    with pytest.raises(ValueError):
        stateful.score_stream(source.read(), WINDOW_US, "sideways")


def test_arrival_order_inside_a_micro_batch(spark, tmp_path, make_events):
    """One batch from many files: rows are judged in the order of their numbers, not in that of the shuffle."""
    stateful.use_rocksdb(spark)
    rows = sorted({(m, t) for m, t, _ in _rows(8, 0, 90, 150)}, key=lambda r: r[1])
    numbered = [(m, t, float(i % 7), i) for i, (m, t) in enumerate(rows)]
    frame = spark.createDataFrame(numbered, "metric string, event_us bigint, value double, n bigint")
    events = make_events([r[:3] for r in numbered]).join(frame.select("metric", "event_us", "n"), ["metric", "event_us"])
    events = events.withColumn("row_num", F.col("n")).drop("n").select(make_events([("m", BASE, 1.0)]).columns)
    events.repartition(7).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    _, out = _drain(stateful.score_stream(stream, WINDOW_US, "arrival"), tmp_path)
    _compare(out.collect(), window_stats(events, WINDOW_US).collect())


def test_micro_batches_of_far_times_read_their_own_days(spark, tmp_path, source, make_events):
    """An event decades ahead is stored and scored, and the others find their windows as before."""
    day = 86_400 * MICROS
    for rows in (_rows(11, 0, 60), [*_rows(12, 50, 110), ("a", BASE + 9_000 * day, 5.0)]):
        source(rows)
    sinks.ensure_store(spark, str(tmp_path / "results"), "anomaly_id string")
    detector = ZScoreDetector(1.5, 5)
    handler = jobs.micro_batch_handler(str(tmp_path / "events"), str(tmp_path / "results"), detector, WINDOW_US)
    jobs.start(source.read(), handler, str(tmp_path / "checkpoint"), available_now=True).awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "events"))
    assert stored.count() == 121
    second = stored.filter("batch_id = 1").select("event_id")
    want = {r.event_id for r in detector.anomalies(stored.drop("batch_id"), WINDOW_US).join(second, "event_id", "left_semi").collect()}
    got = sinks.read_results(spark, str(tmp_path / "results"))
    assert {r.event_id for r in got.join(second, "event_id", "left_semi").collect()} == want


def test_progress_log_keeps_every_batch_over_restarts(spark, tmp_path):
    """More batches than a query remembers, in two runs from one checkpoint."""
    folder, table = str(tmp_path / "in"), str(tmp_path / "progress")
    good = '{"metric": "m", "timestamp": "2024-01-01T00:00:00Z", "value": 1}'
    (tmp_path / "in").mkdir()
    with progress.ProgressLog(spark, table, every=40) as log:
        for start, stop in ((0, 70), (70, 115)):
            for i in range(start, stop):
                (tmp_path / "in" / f"{i:03d}.jsonl").write_text(f"{good}\n" * (1 + i % 3) + ("{bad\n" if i % 5 == 0 else ""))
            checked = jobs.checked_stream(jobs.message_files(spark, folder, GaugeConfig(max_files_per_trigger=1)))
            query = jobs.start(checked, lambda batch, _: batch.count(), str(tmp_path / "checkpoint"), available_now=True, name="ingest")
            query.awaitTermination()
            log.wait(query)
    rows = progress.read_progress(spark, table)
    assert sorted(r.batch_id for r in rows.collect()) == list(range(115))
    total = progress.progress_totals(rows).collect()
    sent, bad = sum(1 + i % 3 for i in range(115)), len(range(0, 115, 5))
    assert [(r.name, r.batches, r.late_rows) for r in total] == [("ingest", 115, 0)]
    assert (total[0].observed["ingest_valid"], total[0].observed["ingest_invalid"]) == (sent, bad)
    newest = sorted(((r["at"], r.duration_ms) for r in rows.collect()), reverse=True)[:110]
    empty = spark.createDataFrame([], "reason string, metric string")
    summary = reports.processor_summary(empty, spark.createDataFrame([], "anomaly_id string"), durations=progress.batch_durations(rows), newest=110)
    assert summary.first()["avg_processing_time_ms"] == pytest.approx(sum(d for _, d in newest) / 110, rel=0.02)


def test_progress_log_repeated_batches_and_faults(spark, tmp_path):
    path = str(tmp_path / "progress")
    row = lambda run, batch, at, n: ("q", run, None, batch, at, n, 1.0, 0, {"c": float(n)})
    spark.createDataFrame([row("a", 0, 1, 5), row("a", 1, 2, 6), row("b", 1, 3, 7)], progress.PROGRESS_SCHEMA).write.parquet(path)
    got = progress.progress_totals(progress.read_progress(spark, path)).first()
    assert (got.batches, got["rows"], got.observed) == (2, 12, {"c": 12.0})
    assert progress.read_progress(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError):
        progress.ProgressLog(spark, path, every=0)


class _Map(dict):
    """The parts of keyed map state the windows use; counts what is unpacked at once."""

    def iterator(self):
        return iter(list(self.items()))

    def getValue(self, key):
        return self[key]

    def updateValue(self, key, value):
        self[key] = value

    removeKey = dict.__delitem__


class _Handle:
    def __init__(self):
        self.timers, self.maps, self.lists, self.value = set(), {}, [], None
        self.registerTimer, self.deleteTimer, self.listTimers = self.timers.add, self.timers.discard, lambda: sorted(self.timers)

    def getMapState(self, name, *_):
        return self.maps.setdefault(name, _Map())

    def getListState(self, name, *_):
        return type("L", (), {"appendValue": self.lists.append, "get": lambda _: list(self.lists), "put": lambda _, v: self.lists.__setitem__(slice(None), v), "clear": lambda _: self.lists.clear()})()

    def getValueState(self, *_):
        return type("V", (), {"get": lambda _: self.value, "update": lambda _, v: setattr(self, "value", v), "clear": lambda _: setattr(self, "value", None)})()


def _batches(rows, size=500):
    frame = pd.DataFrame([{"arrival": a, "event_us": t, "value": v, "event_id": i, "meta_json": None} for a, t, v, i in rows])
    return (frame[n : n + size] for n in range(0, len(frame), size))


def _watermark(us):
    return type("T", (), {"getCurrentWatermarkInMs": lambda _: us // 1000})()


@pytest.mark.parametrize("percentiles", [None, (10.0, 90.0)])
def test_event_time_rows_of_a_busy_metric_are_scored_in_stretches(percentiles):
    """8,000 rows of one micro-batch, in no order, over 50 windows; a fifth of them at one instant."""
    rng = random.Random(3)
    span = 50 * WINDOW_US
    rows = [(0, BASE + (rng.randrange(0, span, 1000) if i % 5 else span // 2), float(rng.randrange(90)), f"{i:05d}") for i in range(8000)]
    processor, handle = stateful.EventTimeWindow(WINDOW_US, percentiles), _Handle()
    processor.pack_rows = 500
    processor.init(handle)
    half = BASE + 3 * span // 4
    out = list(processor.handleInputRows(("m",), _batches(rows), _watermark(0)))
    assert not out and handle.timers == {-(-min(r[1] for r in rows) // 1000)}
    for passed in (half, BASE + 2 * span):
        part = list(processor.handleExpiredTimer(("m",), _watermark(passed), None))
        out += part
        ahead = [r[1] for r in rows if r[1] > passed]
        assert handle.timers == ({-(-min(ahead) // 1000)} if ahead else set())
    assert max(len(f) for f in out) <= 500
    assert not handle.maps["pending"] and handle.value is None
    got = pd.concat(out).set_index("event_id")
    assert sorted(got.index) == [r[3] for r in rows]
    plain = [("m", r[1], r[2]) for r in rows]
    for r in rng.sample(rows, 60):
        values = brute.window_values(plain, "m", r[1], WINDOW_US)
        n, mean, variance = brute.stats(values)
        seen = got.loc[r[3]]
        assert (seen["window_count"], seen["mean"], seen["variance"]) == (n, pytest.approx(mean), pytest.approx(variance))
        if percentiles:
            assert (seen["lower_bound"], seen["upper_bound"]) == brute.bounds(values, *percentiles)


def test_rows_in_arrival_order_are_scored_in_stretches():
    """Three micro-batches of 4,000 rows, dealt in no order, with ties and late events, against a plain list."""
    rng = random.Random(4)
    processor, handle = stateful.ArrivalWindow(WINDOW_US), _Handle()
    processor.run_rows, processor.piece_rows = 1000, 50
    processor.init(handle)
    window, base = [], BASE
    for batch in range(3):
        rows = [(i // 3, base + i * 20_000 - rng.choice((0, 0, 0, 30 * MICROS)), float(rng.randrange(90)), f"{batch}-{i:05d}") for i in range(4000)]
        base += 4000 * 20_000
        expected = {}
        for r in sorted(rows, key=lambda r: (r[0], r[1], r[3])):
            window.append(r)
            while window[0][1] < max(x[1] for x in window) - WINDOW_US:
                window.pop(0)
            expected[r[3]] = (len(window), sum(x[2] for x in window) / len(window))
        rng.shuffle(rows)
        out = list(processor.handleInputRows(("m",), _batches(rows), None))
        assert max(len(f) for f in out) <= 1000
        got = pd.concat(out)
        assert list(got["event_id"]) == list(expected)
        for r, (n, mean) in zip(got.itertuples(), expected.values()):
            assert (r.window_count, r.mean) == (n, pytest.approx(mean))
        chunks = handle.maps["chunks"]
        assert len(window) <= sum(len(t) // 8 for t, _ in chunks.values()) < 4000 + len(window)


def test_event_time_goes_on_after_a_restart_in_stretches():
    """Six micro-batches that each bring a stretch and some rows of the next, with a new processor for each."""
    rng = random.Random(5)
    handle, out, rows, passed = _Handle(), [], [], 0
    for batch in range(6):
        start = BASE + batch * 10 * WINDOW_US
        fresh = [(0, max(passed + 1, start + rng.randrange(12 * WINDOW_US)), float(rng.randrange(90)), f"{batch}-{i:04d}") for i in range(2000)]
        rows += fresh
        processor = stateful.EventTimeWindow(WINDOW_US)
        processor.pack_rows = 300
        processor.init(handle)
        out += processor.handleInputRows(("m",), _batches(fresh, 100), _watermark(passed))
        passed = (max(r[1] for r in rows) - 3 * WINDOW_US) // 1000 * 1000 if batch < 5 else start + 20 * WINDOW_US
        out += processor.handleExpiredTimer(("m",), _watermark(passed), None)
    assert max(len(f) for f in out) <= 300 and not handle.maps["pending"] and not handle.timers
    got = pd.concat(out).set_index("event_id")
    assert sorted(got.index) == sorted(r[3] for r in rows)
    plain = [("m", r[1], r[2]) for r in rows]
    for r in rng.sample(rows, 60):
        n, mean, variance = brute.stats(brute.window_values(plain, "m", r[1], WINDOW_US))
        seen = got.loc[r[3]]
        assert (seen["window_count"], seen["mean"], seen["variance"]) == (n, pytest.approx(mean), pytest.approx(variance))
