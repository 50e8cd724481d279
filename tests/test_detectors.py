from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegauge.config import MICROS, GaugeConfig
from pulsegauge.functions.ranges import range_moments
from pulsegauge.operators import detectors
from pulsegauge.operators.detectors import PercentileDetector, ZScoreDetector
from pulsegauge.operators.percentiles import percentile_bounds, select_kth
from pulsegauge.operators.windows import instant_stats, snapshot_stats
from pulsegauge.schema import ANOMALY_COLUMNS
from tests import brute

BASE = 1_700_000_000 * MICROS
MINUTE = 60 * MICROS


def series(values, metric="m", step=MICROS):
    return [(metric, BASE + i * step, float(v)) for i, v in enumerate(values)]


def test_spike_in_the_stream(make_events):
    events = make_events(series([*range(50, 60), 200]))
    found = ZScoreDetector(2.5).anomalies(events, 5 * MINUTE).collect()
    assert [(r.value, round(r.z_score, 4)) for r in found] == [(200.0, 3.0087)]


def test_low_value_after_the_spike_is_not_far_enough(make_events):
    events = make_events(series([*range(50, 60), 200, 5]))
    scored = {r.value: r for r in ZScoreDetector(2.5).score(events, 5 * MINUTE).collect()}
    assert not scored[5.0].is_anomaly
    assert scored[5.0].z_score == pytest.approx(-1.259, abs=1e-3)


def test_guards_in_order(make_events):
    few = ZScoreDetector().score(make_events(series([1, 2, 3])), 5 * MINUTE).collect()
    assert {r.skip_reason for r in few} == {"insufficient_data"}
    flat = ZScoreDetector().score(make_events(series([50] * 10)), 5 * MINUTE).collect()
    assert [r.skip_reason for r in sorted(flat, key=lambda r: r.event_us)] == ["insufficient_data"] * 4 + ["zero_stddev"] * 6
    assert not any(r.is_anomaly for r in few + flat)
    assert all(r.z_score is None for r in few + flat)


def test_threshold_is_inclusive(spark):
    rows = [(8.0, 10, 2.0, 1.0), (-4.0, 10, 2.0, 2.0), (7.9, 10, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "value double, window_count bigint, mean double, stddev double")
    got = [r.is_anomaly for r in ZScoreDetector(3.0).verdict(df).orderBy("value").collect()]
    assert got == [True, False, True]


def test_nothing_fires_below_eleven_points(make_events):
    for n in (10, 11):
        found = ZScoreDetector(3.0).anomalies(make_events(series([0] * (n - 1) + [1])), 5 * MINUTE).count()
        assert found == (1 if n == 11 else 0)
        assert (n - 1) / math.sqrt(n) >= 3.0 or found == 0


def test_candidates_against_history(make_events):
    history = make_events(series([30, 40, 50, 60, 70]))
    candidates = make_events([("m", BASE + 10 * MICROS, 100.0), ("m", BASE + 10 * MICROS, 0.0), ("m", BASE + 10 * MICROS, 50.0)])
    scored = detectors.score_candidates(history, candidates, ZScoreDetector(2.5), 5 * MINUTE).collect()
    assert {r.value: (r.is_anomaly, r.window_count) for r in scored} == {100.0: (True, 5), 0.0: (True, 5), 50.0: (False, 5)}


def test_candidates_equal_brute_force(make_events):
    rng = random.Random(4)
    history = [("ab"[rng.randrange(2)], BASE + rng.randrange(500) * 1000, rng.gauss(0, 1)) for _ in range(200)]
    asked = [("abc"[rng.randrange(3)], BASE + rng.randrange(600) * 1000, rng.gauss(0, 5)) for _ in range(60)]
    for slices in (None, 5):
        scored = detectors.score_candidates(make_events(history), make_events(asked), ZScoreDetector(2.0, slices=slices), 50_000).collect()
        assert len(scored) == len(asked)
        for r in scored:
            n, mean, variance = brute.stats(brute.window_values(history, r.metric, r.event_us, 50_000))
            assert (r.window_count, r.mean) == (n, pytest.approx(mean, abs=1e-9))
            assert r.variance == pytest.approx(variance, abs=1e-9)


def test_candidates_against_snapshot(make_events):
    history = make_events(series([40, 50, 60, 70, 80]))
    snapshot = snapshot_stats(history, BASE + 10 * MICROS, 5 * MINUTE)
    asked = make_events([("m", BASE, 100.0), ("m", BASE, 60.0), ("other", BASE, 1.0)])
    scored = {r.value: r for r in detectors.score_against_snapshot(snapshot, asked, ZScoreDetector(3.0)).collect()}
    assert not any(r.is_anomaly for r in scored.values())
    assert scored[100.0].z_score == pytest.approx(2.5298, abs=1e-4)
    assert scored[1.0].skip_reason == "insufficient_data"


def test_percentile_high_and_low(make_events):
    high = PercentileDetector(5, 95).anomalies(make_events(series([*range(30), 100])), 5 * MINUTE).collect()
    assert 100.0 in {r.value for r in high}
    low = PercentileDetector(5, 95).anomalies(make_events(series([*range(10, 40), 0])), 5 * MINUTE).collect()
    assert 0.0 in {r.value for r in low}


@pytest.mark.parametrize(("n", "low_fires", "high_fires"), [(99, False, False), (100, True, False), (101, True, True)])
def test_default_band_needs_a_hundred_points(make_events, n, low_fires, high_fires):
    values = [10.0 + (i % 5) for i in range(n - 1)]
    for extreme, fires in ((0.0, low_fires), (99.0, high_fires)):
        events = make_events(series([*values, extreme]))
        found = PercentileDetector().anomalies(events, 5 * MINUTE).filter(F.col("value") == extreme).count()
        assert found == (1 if fires else 0)


@pytest.mark.parametrize("limit", [2_000_000, 20])
def test_percentiles_equal_brute_force(make_events, limit):
    rng = random.Random(9)
    rows = [("ab"[rng.random() < 0.3], BASE + rng.randrange(3000) * 1000, round(rng.expovariate(0.02), 1)) for _ in range(600)]
    window_us = 600_000
    got = PercentileDetector(5, 95, 20, limit=limit).anomalies(make_events(rows), window_us).collect()
    expected = []
    for m, t, v in rows:
        values = brute.window_values(rows, m, t, window_us)
        if len(values) >= 20:
            low, high = brute.bounds(values, 5, 95)
            if v < low or v > high:
                expected.append((m, t, v, low, high))
    assert sorted((r.metric, r.event_us, r.value, r.lower_bound, r.upper_bound) for r in got) == sorted(expected)


def test_thinning_drops_rows_and_keeps_the_flags(make_events):
    rng = random.Random(10)
    rows = [("m", BASE + i * 1000, rng.gauss(0, 1)) for i in range(3000)]
    events = make_events(rows)
    stats = instant_stats(events, 1_000_000, 1)
    full = percentile_bounds(events, stats, 1_000_000, 5, 95, 20)
    thin = percentile_bounds(events, stats, 1_000_000, 5, 95, 20, flagged_only=True, limit=500)
    assert thin.count() < full.count() * 0.7
    assert thin.join(full, thin.columns).count() == thin.count()


def test_select_kth_and_range_moments():
    rng = np.random.default_rng(1)
    values, weights = rng.integers(0, 12, 80).astype(float), rng.integers(1, 4, 80)
    left = rng.integers(0, 79, 60)
    right = left + 1 + rng.integers(0, 80, 60) % (80 - left)
    total = np.array([weights[a:b].sum() for a, b in zip(left, right)])
    kth = (total * 0.37).astype(np.int64)
    expected = [np.sort(np.repeat(values[a:b], weights[a:b]))[k] for a, b, k in zip(left, right, kth)]
    assert select_kth(values, weights, left, right, kth).tolist() == expected
    n, mean, variance = range_moments(values, left, right)
    assert n.tolist() == (right - left).tolist()
    assert np.allclose(mean, [values[a:b].mean() for a, b in zip(left, right)])
    assert np.allclose(variance, [values[a:b].var(ddof=1) if b - a > 1 else 0 for a, b in zip(left, right)])


def test_records_of_both_methods(make_events):
    events = make_events(series([*range(50, 60), *range(50, 60), 400])).withColumn("meta_json", F.lit('{"host":"a"}'))
    found = detectors.detect_all(events, [ZScoreDetector(), PercentileDetector(5, 95)], 5 * MINUTE, F.timestamp_micros(F.lit(BASE)))
    assert tuple(found.columns) == ANOMALY_COLUMNS
    rows = {r.detection_method: r for r in found.collect() if r.value == 400.0}
    assert set(rows) == {"z-score", "percentile"}
    assert rows["z-score"].lower_bound is None and rows["z-score"].threshold == 3.0
    assert rows["percentile"].z_score is None and rows["percentile"].upper_percentile == 95.0
    assert {r.event_meta for r in rows.values()} == {'{"host":"a"}'}
    assert all(r.anomaly_id.startswith("anomaly-") and len(r.anomaly_id) == 24 for r in rows.values())
    again = detectors.detect_all(events, [ZScoreDetector(), PercentileDetector(5, 95)], 5 * MINUTE, F.timestamp_micros(F.lit(BASE)))
    assert {r.anomaly_id for r in again.collect()} == {r.anomaly_id for r in found.collect()}


def test_tally(make_events):
    r = detectors.tally(make_events(series([*range(50, 60), 200])), ZScoreDetector(2.5), 5 * MINUTE).first()
    assert (r.total_checked, r.total_anomalies, r.threshold, r.min_count) == (11, 1, 2.5, 5)


@pytest.mark.parametrize(
    "make",
    [
        lambda: ZScoreDetector(0), lambda: ZScoreDetector(-1), lambda: ZScoreDetector(3, 1),
        lambda: PercentileDetector(5, 5), lambda: PercentileDetector(-1, 50), lambda: PercentileDetector(1, 101),
        lambda: PercentileDetector(1, 99, 9), lambda: GaugeConfig(window_seconds=0), lambda: GaugeConfig(recent_limit=0),
        lambda: GaugeConfig(kafka_starting_offsets="middle"),
    ],
)
def test_parameters_are_checked(make):
    with pytest.raises(ValueError):
        make()


def test_config_from_session(spark):
    spark.conf.set("spark.pulsegauge.window_seconds", "60")
    spark.conf.set("spark.pulsegauge.min_count", "7")
    try:
        config = GaugeConfig.from_conf(spark, threshold=2.0)
        assert (config.window_us, config.min_count, config.threshold) == (60 * MICROS, 7, 2.0)
    finally:
        spark.conf.unset("spark.pulsegauge.window_seconds")
        spark.conf.unset("spark.pulsegauge.min_count")
