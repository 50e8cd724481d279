from __future__ import annotations

import math
import random
import statistics

import pytest

from pulsegauge.config import MICROS, window_micros
from pulsegauge.operators import windows
from tests import brute

BASE = 1_700_000_000 * MICROS


def _random_rows(seed, n=300, metrics="ab", span=400, ties=True):
    rng = random.Random(seed)
    step = 1 if ties else 0
    return [
        (rng.choice(metrics), BASE + (rng.randrange(span) if step else i * 3) * 1000, round(rng.gauss(50, 10), 2))
        for i in range(n)
    ]


def _check(rows, scored, window_us):
    got = scored.select("metric", "event_us", "window_count", "mean", "variance", "stddev").collect()
    assert len(got) == len(rows)
    for r in got:
        n, mean, variance = brute.stats(brute.window_values(rows, r.metric, r.event_us, window_us))
        assert r.window_count == n
        assert r.mean == pytest.approx(mean, rel=1e-12, abs=1e-9)
        assert r.variance == pytest.approx(variance, rel=1e-9, abs=1e-9)
        assert r.stddev == pytest.approx(math.sqrt(variance), rel=1e-9, abs=1e-9)


@pytest.mark.parametrize(
    "options",
    [
        {"strategy": "frame"},
        {"strategy": "halo"},
        {"strategy": "halo", "bucket_us": 77_000},
        {"slices": 1},
        {"slices": 2},
        {"slices": 8},
        {"slices": 60},
        {"slices": 1000},
    ],
)
def test_every_way_equals_brute_force(make_events, options):
    rows = _random_rows(seed=3)
    window_us = 60_000
    _check(rows, windows.window_stats(make_events(rows), window_us, **options), window_us)


def test_automatic_slices(make_events):
    rows = _random_rows(seed=5)
    events = make_events(rows)
    assert windows.choose_slices(events, 60_000) == 1
    assert windows.choose_slices(events, 60_000, limit=5) > 1
    _check(rows, windows.window_stats(events, 60_000), 60_000)


@pytest.mark.parametrize("slices", [2, 3, 7, 50])
def test_slices_of_a_prime_window(make_events, slices):
    rows = _random_rows(seed=slices)
    _check(rows, windows.window_stats(make_events(rows), 60_013, slices=slices), 60_013)


def test_a_prime_window_is_split(make_events):
    events = make_events(_random_rows(seed=6))
    assert windows.choose_slices(events, 60_013, limit=1) > 10


def test_row_order_does_not_matter(make_events):
    rows = _random_rows(seed=8, n=120)
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    key = lambda r: (r.metric, r.event_us, r.value, r.window_count, round(r.mean, 9))
    a, b = (sorted(key(r) for r in windows.window_stats(make_events(x), 60_000, slices=4).collect()) for x in (rows, shuffled))
    assert a == b


def test_lower_edge_is_inside(make_events):
    rows = [("m", BASE, 1.0), ("m", BASE + 100, 2.0), ("m", BASE + 101, 4.0)]
    for options in ({"strategy": "frame"}, {"strategy": "halo"}, {"slices": 1}, {"slices": 10}):
        scored = windows.window_stats(make_events(rows), 100, **options)
        assert {r.event_us - BASE: r.window_count for r in scored.collect()} == {0: 1, 100: 2, 101: 2}


def test_events_of_one_instant_see_each_other(make_events):
    rows = [("m", BASE, 1.0), ("m", BASE, 2.0), ("m", BASE, 6.0)]
    scored = windows.window_stats(make_events(rows), 1000, slices=4).collect()
    assert [(r.window_count, r.mean) for r in scored] == [(3, 3.0)] * 3


def test_metrics_are_separate_and_snapshot(make_events):
    rows = [("cpu", BASE + i * MICROS, 70.0 + i) for i in range(5)]
    rows += [("memory", BASE + i * MICROS, 80.0 + 2 * i) for i in range(3)]
    got = {r.metric: (r.window_count, r.mean) for r in windows.snapshot_stats(make_events(rows), BASE + 10 * MICROS, 60 * MICROS).collect()}
    assert got == {"cpu": (5, 72.0), "memory": (3, 82.0)}


def test_snapshot_after_purge(make_events):
    rows = [("m", BASE + i * MICROS, float(i)) for i in range(20)]
    r = windows.snapshot_stats(make_events(rows), BASE + 20 * MICROS, 10 * MICROS).first()
    assert (r.window_count, r.mean) == (10, 14.5)
    assert r.variance == pytest.approx(statistics.variance(range(10, 20)))


def test_gap_in_time(make_events):
    rows = [("m", BASE + s * MICROS, v) for s, v in ((0, 10.0), (1, 20.0), (10, 30.0), (11, 40.0))]
    r = windows.snapshot_stats(make_events(rows), BASE + 12 * MICROS, 5 * MICROS).first()
    assert (r.window_count, r.mean) == (2, 35.0)


def test_snapshot_of_a_metric_without_events(spark, make_events):
    names = spark.createDataFrame([("m",), ("never",)], "metric string")
    got = windows.snapshot_stats(make_events([("m", BASE, 3.0)]), BASE, MICROS, names).collect()
    assert {r.metric: (r.window_count, r.mean, r.variance) for r in got} == {"m": (1, 3.0, 0.0), "never": (0, 0.0, 0.0)}


def test_single_and_constant_values(make_events):
    rows = [("one", BASE, 5.0)] + [("same", BASE + i, 0.1) for i in range(200)]
    for r in windows.window_stats(make_events(rows), 1000, slices=10).collect():
        assert r.variance == 0.0 and r.stddev == 0.0
        assert r.mean in (5.0, 0.1)


def test_a_spike_leaves_no_trace(make_events):
    """Statistics after a huge spike has left the window are as exact as without it."""
    calm = [("m", BASE + i * 10, 100.0 + (i % 7)) for i in range(200)]
    rows = calm[:50] + [("m", BASE + 505, 1e12)] + calm[60:]
    _check(rows, windows.window_stats(make_events(rows), 200, slices=4), 200)


def test_shift_and_scale(make_events):
    rows = _random_rows(seed=11, n=150)
    moved = [(m, t, 3 * v + 1000) for m, t, v in rows]
    z = lambda data: sorted(
        (r.metric, r.event_us, round((r.value - r.mean) / r.stddev, 6))
        for r in windows.window_stats(make_events(data), 60_000, slices=4).collect()
        if r.stddev > 0
    )
    assert z(rows) == z(moved)


def test_retention(make_events):
    rows = [("a", BASE, 1.0), ("a", BASE + 50, 2.0), ("b", BASE, 3.0)]
    kept = windows.retain(make_events(rows), BASE + 100, 50).collect()
    assert [(r.metric, r.value) for r in kept] == [("a", 2.0)]
    one = windows.retain(make_events(rows), BASE + 100, 50, ["a"]).collect()
    assert sorted((r.metric, r.value) for r in one) == [("a", 2.0), ("b", 3.0)]


def test_latest_state(make_events):
    rows = _random_rows(seed=2, n=80)
    for r in windows.latest_state(make_events(rows), 60_000).collect():
        newest = max(t for m, t, _ in rows if m == r.metric)
        n, mean, _ = brute.stats(brute.window_values(rows, r.metric, newest, 60_000))
        assert (r.event_us, r.window_count) == (newest, n)
        assert r.mean == pytest.approx(mean)


def test_window_length_is_checked():
    assert window_micros(300) == 300 * MICROS
    for bad in (0, -1, float("nan")):
        with pytest.raises(ValueError):
            window_micros(bad)


def test_slices_split_a_hot_metric(make_events):
    """The windows of one metric are grouped by (metric, slice), never by metric alone."""
    plan = windows.window_stats(make_events([("m", BASE, 1.0)]), 60_000, slices=6)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [" in plan
    for line in plan.splitlines():
        if "Window [" in line:
            assert "slice" in line or "run" in line


def test_summary_joins_do_not_shuffle_the_rows(spark):
    """A small summary is broadcast, so the rows stay where they are; a large one is split by a salt."""
    from pyspark.sql import functions as F

    from pulsegauge.operators.joins import join_summary

    rows = spark.range(1000).selectExpr("id", "CASE WHEN id < 900 THEN 'hot' ELSE CAST(id AS STRING) END AS k")
    summary = rows.groupBy("k").agg(F.count("*").alias("n"))
    small = join_summary(rows, summary, ["k"], salt=["id"])
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    split = join_summary(rows, summary, ["k"], salt=["id"], limit=5)
    assert "_salt" in split._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, split.collect()))


@pytest.mark.parametrize("options", [{"strategy": "frame"}, {"strategy": "halo"}])
def test_work_of_a_frame_does_not_grow_with_its_events(spark, make_events, options):
    """20,000 events in one window: a frame added up anew for each event would visit 200 million."""
    n, window_us = 20_000, 10_000_000
    rows = [("m", BASE + i * 7, float(i % 11)) for i in range(n)]
    scored = windows.window_stats(make_events(rows), window_us, **options)
    frames = [line for line in scored._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RangeFrame, -" in line]
    assert not frames
    got = {r.event_us: r for r in scored.collect()}
    assert len(got) == n
    for i in (0, 1, 9_999, n - 1):
        mean, variance = statistics.fmean(r[2] for r in rows[: i + 1]), statistics.variance([r[2] for r in rows[: i + 1]]) if i else 0.0
        r = got[rows[i][1]]
        assert (r.window_count, r.mean, r.variance) == (i + 1, pytest.approx(mean), pytest.approx(variance))


def test_frame_keeps_rows_without_name_or_time(spark):
    rows = [(None, BASE, 1.0, "a"), (None, BASE + 5, 3.0, "b"), ("m", None, 2.0, "c"), ("m", None, 6.0, "d"), ("m", BASE, 9.0, "e"), ("m", BASE, None, "f")]
    events = spark.createDataFrame(rows, "metric string, event_us bigint, value double, tag string")
    got = {r.tag: (r.window_count, r.mean) for r in windows.window_stats(events, 100, "frame").collect()}
    assert got == {"a": (1, 1.0), "b": (2, 2.0), "c": (2, 4.0), "d": (2, 4.0), "e": (1, 9.0), "f": (1, 9.0)}


@pytest.mark.parametrize("bucket_us", [60_000, 60_001, 100_000, 119_999, 120_000, 150_000, 600_000])
def test_buckets_of_any_length_equal_brute_force(make_events, bucket_us):
    rows = [(m, t - BASE - 200_000, v) for m, t, v in _random_rows(seed=bucket_us)]  # also before 1970
    rows += [("a", e, 1.0) for b in (-1, 0, 1) for e in (b * bucket_us, b * bucket_us - 1, b * bucket_us - 60_000, b * bucket_us - 60_001)]
    _check(rows, windows.window_stats(make_events(rows), 60_000, "halo", bucket_us=bucket_us), 60_000)


def test_buckets_keep_rows_without_name_or_time(spark):
    rows = [(None, BASE, 1.0, "a"), (None, BASE + 5, 3.0, "b"), ("m", None, 2.0, "c"), ("m", None, 6.0, "d"), ("m", BASE, 9.0, "e"), ("m", BASE, None, "f")]
    events = spark.createDataFrame(rows, "metric string, event_us bigint, value double, tag string")
    got = {r.tag: (r.window_count, r.mean) for r in windows.window_stats(events, 100, "halo").collect()}
    assert got == {"a": (1, 1.0), "b": (2, 2.0), "c": (2, 4.0), "d": (2, 4.0), "e": (1, 9.0), "f": (1, 9.0)}


@pytest.mark.parametrize("options", [{"strategy": "frame"}, {"strategy": "halo"}, {"slices": 1}])
def test_a_group_is_sorted_once_for_each_direction(make_events, options):
    rows = _random_rows(seed=4, n=50)
    plan = windows.window_stats(make_events(rows), 60_000, **options)._jdf.queryExecution().executedPlan().toString().splitlines()
    plan = plan[: next((i for i, line in enumerate(plan) if "Initial Plan" in line), len(plan))]
    assert sum("Sort [" in line and "slice" in line for line in plan) == 2


def test_buckets_copy_instants_and_not_events(spark, make_events):
    """500 events at one instant near a bucket's end are two or three rows of the copies, not a thousand."""
    rows = [("m", BASE - BASE % 100_000 + 99_000, float(i)) for i in range(500)]
    scored = windows.window_stats(make_events(rows), 60_000, "halo", bucket_us=100_000)
    copies = [line for line in scored._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate inline" in line or "Aggregate [" in line]
    assert copies and "Aggregate [" in copies[-1]
    assert {r.window_count for r in scored.collect()} == {500}
