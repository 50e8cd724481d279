"""Sliding-window statistics per metric over event time.

The window of an event at time ``t`` is ``[t - W, t]`` with both ends included; the event itself
and all events of the same instant belong to it. Three ways give the same numbers:

``sliced``  the default. Events are first combined per instant. Time is cut into slices of equal
            width, and a window is then put together from three parts: the head of the slice where
            it ends, the instants that leave it during that slice, and all others in between. Work is O(n log n) however many events a window
            holds, and no group is larger than the instants of two slices, so a metric with a
            third of all rows is spread over as many tasks as it has slices.
``halo``    time buckets of at least ``W``; each instant is also shown to the next bucket when it
            can be in a window there. Inside a bucket, stretches of length ``W`` count from its start, so
            what comes from the bucket before is only ever the end of a frame.
``frame``   the moving frame over any partition, cut at every whole window: a frame is the end of
            one stretch of length ``W`` and the start of the next, so it is not added up anew for
            each event. Its groups are the stretches, whatever size the partition has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegauge.operators.joins import join_summary

MAX_INSTANTS_PER_SLICE = 500_000
STRATEGIES = ("sliced", "halo", "frame")
STATS = ("window_count", "mean", "variance", "stddev")


def int_div(us: str, width: int) -> Column:
    """Floor of microseconds over a width in whole-number arithmetic, also before 1970."""
    return F.expr(f"({us} - pmod({us}, {width}L)) div {width}L")


def settle(count: Column, mean: Column, variance: Column, low: Column, high: Column) -> list[Column]:
    """Final window columns: an empty window has mean 0, and spread 0 means spread exactly 0.

    When the smallest and the largest value agree, the window is constant whatever rounding
    left in the sums, so the test for a zero deviation never rests on a rounding error.
    """
    constant = (count < 2) | (low == high)
    var = F.when(constant, F.lit(0.0)).otherwise(F.greatest(F.coalesce(variance, F.lit(0.0)), F.lit(0.0)))
    return [
        count.cast("bigint").alias("window_count"),
        F.when(count == 0, F.lit(0.0)).when(low == high, low).otherwise(mean).alias("mean"),
        var.alias("variance"),
        F.sqrt(var).alias("stddev"),
    ]


def frame_stats(events: DataFrame, window_us: int, partition: tuple[str, ...] = ("metric",), weight: Column | None = None) -> DataFrame:
    """``events`` plus window statistics from a moving RANGE frame inside each partition.

    As in a frame, rows without a time see each other, and a missing name is a partition of its own.
    """
    return _beside(events, instant_stats(events, window_us, 1, weight, partition), (*partition, "event_us"))


def _beside(events: DataFrame, stats: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``events`` plus the statistics of their instant; a missing key is a key like others."""
    stats = stats.select(*[F.col(k).alias(f"of_{k}") for k in keys], *STATS)
    same = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys]
    return events.join(stats, same).drop(*[f"of_{k}" for k in keys])


def with_halo(events: DataFrame, window_us: int, bucket_us: int, name: str = "bucket") -> DataFrame:
    """Each event in its own bucket (``core``) and, near the bucket's end, in the next one as well.

    Every window of a core event then lies inside its bucket; rows grow by at most ``1 + W/B``.
    """
    if bucket_us < window_us:
        raise ValueError("bucket must be at least as long as the window")
    own = int_div("event_us", bucket_us)
    reaches_next = F.col("event_us") >= (own + 1) * F.lit(bucket_us) - F.lit(window_us)
    copies = F.when(
        reaches_next,
        F.array(
            F.struct(own.alias(name), F.lit(True).alias("core")),
            F.struct((own + 1).alias(name), F.lit(False).alias("core")),
        ),
    ).otherwise(F.array(F.struct(own.alias(name), F.lit(True).alias("core"))))
    return events.select("*", F.inline(copies))


def halo_stats(events: DataFrame, window_us: int, bucket_us: int | None = None) -> DataFrame:
    """``events`` plus window statistics from buckets, over instants that are combined before they are copied."""
    bucket_us = bucket_us or 4 * window_us
    spread = with_halo(instants(events), window_us, bucket_us)
    place = lambda at: F.expr(f"({at} - bucket * {bucket_us}L) div {window_us}L")
    out = f"(event_us + {window_us}L)"
    # only the bucket's own instants ask for a window, and only stretches that begin in it hold one
    copies = F.array(
        F.when(F.col("core"), F.struct(place("event_us").alias("slice"), F.col("event_us").alias("at"), F.lit(False).alias("leaving"))),
        F.when(place(out) * window_us < bucket_us, F.struct(place(out).alias("slice"), F.expr(out).alias("at"), F.lit(True).alias("leaving"))),
    )
    doubled = spread.select("metric", "bucket", "n", "avg", "ssd", "low", "high", F.inline(F.filter(copies, lambda c: c.isNotNull())))
    return _beside(events, _swept(doubled, ("metric", "bucket")), ("metric", "event_us"))


def instants(events: DataFrame, weight: Column | None = None, partition: tuple[str, ...] = ("metric",)) -> DataFrame:
    """Count, mean, squared deviations, smallest and largest value per metric (or other partition) and microsecond.

    The built-in aggregates combine map-side, so a burst of events at one instant reaches the
    shuffle as one row per task. ``weight`` limits which events count; an instant whose events
    do not count stays as a row with ``n = 0`` and still gets a window.
    """
    v = F.col("value") if weight is None else F.when(weight, F.col("value"))
    return events.groupBy(*partition, "event_us").agg(*_moments(v))


def _moments(v: Column) -> list[Column]:
    n = F.count(v)
    return [
        n.alias("n"),
        F.coalesce(F.avg(v), F.lit(0.0)).alias("avg"),
        F.coalesce(F.var_pop(v) * n, F.lit(0.0)).alias("ssd"),
        F.min(v).alias("low"),
        F.max(v).alias("high"),
    ]


def choose_slices(events: DataFrame, window_us: int, limit: int = MAX_INSTANTS_PER_SLICE) -> int:
    """How many slices a window needs so that a slice stays below ``limit`` events.

    Runs one small aggregation over two columns and looks at its largest count. One slice means
    the window needs no middle part, which saves a pass when the data are thin.
    """
    fullest = (
        events.groupBy("metric", int_div("event_us", window_us).alias("w")).count().agg(F.max("count")).first()[0]
    )
    return min(window_us, max(1, -(-(fullest or 0) // limit)))


def _merge(parts: list[tuple[Column, Column, Column]]) -> tuple[Column, Column, Column]:
    """Combine (count, mean, squared deviations) of disjoint parts by pairwise updating."""
    n, avg, ssd = parts[0]
    for n2, avg2, ssd2 in parts[1:]:
        total = n + n2
        gap = avg2 - avg
        share = F.when(total > 0, n2 / total).otherwise(F.lit(0.0))
        n, avg, ssd = total, avg + gap * share, ssd + ssd2 + gap * gap * n * share
    return n, avg, ssd


def _middle(events: DataFrame, window_us: int, width: int, weight: Column | None) -> DataFrame:
    """Moments of the instants before each slice that are in all of its windows.

    With ``W = slices * width + rest``, these are the ``slices - 1`` whole slices before and, of the one
    before them, the instants that leave a window only after the slice: those in its last ``rest`` part.
    Works on totals of these two parts of each slice. Slices are grouped in runs of ``slices`` with a halo
    of one run, so a group holds at most two runs and the list of a frame at most ``2 * slices`` entries.
    """
    slices = window_us // width
    v = F.col("value") if weight is None else F.when(weight, F.col("value"))
    late = (int_div(f"(event_us + {window_us}L)", width) > int_div("event_us", width) + slices).alias("late")
    totals = events.groupBy("metric", int_div("event_us", width).alias("slice"), late).agg(*_moments(v))
    run = F.expr(f"(slice - pmod(slice, {slices}L)) div {slices}L")
    spread = totals.select("*", F.inline(F.array(F.struct(run.alias("run"), F.lit(True).alias("core")), F.struct((run + 1).alias("run"), F.lit(False).alias("core")))))
    by_slice = Window.partitionBy("metric", "run").orderBy("slice")
    edge, no_value = by_slice.rangeBetween(-slices, -slices), F.lit(None).cast("double")
    nothing = F.array().cast("array<struct<n: bigint, avg: double, ssd: double>>")
    # a window of less than two widths has no whole slice inside
    over_whole = lambda c, none: c.over(by_slice.rangeBetween(1 - slices, -1)) if slices > 1 else none
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("avg"), F.lit(0.0).alias("ssd"))

    def add(a: Column, b: Column) -> Column:
        n, avg, ssd = _merge([(a["n"], a["avg"], a["ssd"]), (b["n"], b["avg"], b["ssd"])])
        return F.struct(n.alias("n"), avg.alias("avg"), ssd.alias("ssd"))

    late_only = lambda c: F.when(F.col("late"), c)
    listed = spread.select(
        "metric", "slice", "core",
        F.concat(
            over_whole(F.collect_list(F.struct("n", "avg", "ssd")), nothing),
            F.collect_list(late_only(F.struct("n", "avg", "ssd"))).over(edge),
        ).alias("parts"),
        F.least(over_whole(F.min("low"), no_value), F.min(late_only(F.col("low"))).over(edge)).alias("mid_low"),
        F.greatest(over_whole(F.max("high"), no_value), F.max(late_only(F.col("high"))).over(edge)).alias("mid_high"),
    ).filter("core")
    # both parts of a slice see the same frames; one row per slice is left
    return listed.dropDuplicates(["metric", "slice"]).select(
        "metric", "slice", F.aggregate("parts", zero, add).alias("mid"), "mid_low", "mid_high"
    )


def instant_stats(
    events: DataFrame,
    window_us: int,
    slices: int | None = None,
    weight: Column | None = None,
    partition: tuple[str, ...] = ("metric",),
) -> DataFrame:
    """Window statistics for every distinct (metric, event_us), by the ``sliced`` way.

    With one slice, windows may be kept inside any ``partition``; more slices are for metrics only.
    """
    slices = slices or choose_slices(events, window_us)
    width = -(-window_us // slices)
    own = int_div("event_us", width)
    # each instant appears where it is, and once more one window later, where it drops out
    copies = F.array(
        F.struct(own.alias("slice"), F.col("event_us").alias("at"), F.lit(False).alias("leaving")),
        F.struct(int_div(f"(event_us + {window_us}L)", width).alias("slice"), (F.col("event_us") + window_us).alias("at"), F.lit(True).alias("leaving")),
    )
    doubled = instants(events, weight, partition).select(*partition, "n", "avg", "ssd", "low", "high", F.inline(copies))
    # what has no time never leaves
    doubled = doubled.filter(F.col("at").isNotNull() | ~F.col("leaving"))
    if slices > 1:
        doubled = doubled.join(_middle(events, window_us, width, weight), ["metric", "slice"], "left")
    return _swept(doubled, partition, middle=slices > 1)


def _swept(doubled: DataFrame, partition: tuple[str, ...], middle: bool = False) -> DataFrame:
    """Window statistics of the instants of each ``slice``, which stand ``at`` their time and again where they are ``leaving``."""
    group = Window.partitionBy(*partition, "slice")
    rows = (Window.unboundedPreceding, Window.currentRow)
    head = group.orderBy("at", "leaving").rowsBetween(*rows)
    # a leaving instant at exactly t is still inside the window of t, so it sorts before it here
    tail = group.orderBy(F.desc("at"), F.desc("leaving")).rowsBetween(*rows)
    # one direction after the other, so that a group is sorted once for each
    staged = doubled
    for part, w, counted in (("head", head, ~F.col("leaving")), ("tail", tail, F.col("leaving"))):
        n = F.when(counted, F.col("n")).otherwise(F.lit(0))
        running = {
            f"{part}_n": F.sum(n).over(w),
            f"{part}_sum": F.sum(n * F.col("avg")).over(w),
            f"{part}_low": F.min(F.when(counted, F.col("low"))).over(w),
            f"{part}_high": F.max(F.when(counted, F.col("high"))).over(w),
        }
        # squared deviations grow by a non-negative step per instant, so nothing cancels
        before_n = F.col(f"{part}_n") - n
        before_avg = (F.col(f"{part}_sum") - n * F.col("avg")) / before_n
        gap = F.col("avg") - before_avg
        step = F.when(
            n > 0,
            F.col("ssd") + F.when(before_n > 0, gap * gap * n * before_n / F.col(f"{part}_n")).otherwise(F.lit(0.0)),
        ).otherwise(F.lit(0.0))
        staged = staged.withColumns(running).withColumn(f"{part}_ssd", F.sum(step).over(w))

    own_rows = staged.filter(~F.col("leaving"))
    parts = [
        (F.col(f"{p}_n"), F.when(F.col(f"{p}_n") > 0, F.col(f"{p}_sum") / F.col(f"{p}_n")).otherwise(F.lit(0.0)), F.col(f"{p}_ssd"))
        for p in ("head", "tail")
    ]
    lows, highs = ["head_low", "tail_low"], ["head_high", "tail_high"]
    if middle:
        parts.append(tuple(F.coalesce(F.col(f"mid.{f}"), F.lit(0)) for f in ("n", "avg", "ssd")))
        lows, highs = [*lows, "mid_low"], [*highs, "mid_high"]
    merged = own_rows
    n, avg, ssd = parts[0]
    for i, part in enumerate(parts[1:]):
        # one projection per merge keeps the expressions from multiplying
        n2, avg2, ssd2 = _merge([(n, avg, ssd), part])
        merged = merged.withColumns({f"n{i}": n2, f"avg{i}": avg2, f"ssd{i}": ssd2})
        n, avg, ssd = F.col(f"n{i}"), F.col(f"avg{i}"), F.col(f"ssd{i}")
    return merged.select(
        *partition,
        F.col("at").alias("event_us"),
        F.col("low").alias("instant_low"),
        F.col("high").alias("instant_high"),
        *settle(n, avg, ssd / (n - 1), F.least(*lows), F.greatest(*highs)),
    )


def window_stats(
    events: DataFrame,
    window_us: int,
    strategy: str = "sliced",
    slices: int | None = None,
    bucket_us: int | None = None,
) -> DataFrame:
    """``events`` plus ``window_count, mean, variance, stddev`` of each event's own window."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}, got {strategy!r}")
    if strategy == "frame":
        return frame_stats(events, window_us)
    if strategy == "halo":
        return halo_stats(events, window_us, bucket_us)
    stats = instant_stats(events, window_us, slices).select("metric", "event_us", *STATS)
    return events.join(stats, ["metric", "event_us"])


def snapshot_stats(events: DataFrame, as_of_us: int, window_us: int, metrics: DataFrame | None = None) -> DataFrame:
    """Statistics of ``[T - W, T]`` per metric; a metric without events in it has count 0.

    ``metrics`` lists the metrics to report; by default those seen anywhere in ``events``.
    """
    inside = F.col("event_us").between(as_of_us - window_us, as_of_us)
    source = events
    v = F.when(inside, F.col("value"))
    if metrics is not None:
        source, v = events.filter(inside), F.col("value")
    grouped = source.groupBy("metric").agg(*_moments(v))
    if metrics is not None:
        grouped = metrics.select("metric").distinct().join(grouped, "metric", "left").fillna(0, ["n", "avg", "ssd"])
    n = F.col("n")
    return grouped.select("metric", *settle(n, F.col("avg"), F.col("ssd") / (n - 1), F.col("low"), F.col("high")))


def retain(events: DataFrame, as_of_us: int, window_us: int, metrics: list[str] | None = None) -> DataFrame:
    """Drop events older than ``T - W``, for all metrics or only the ones named."""
    fresh = F.col("event_us") >= as_of_us - window_us
    return events.filter(fresh if metrics is None else fresh | ~F.col("metric").isin(metrics))


def latest_state(events: DataFrame, window_us: int) -> DataFrame:
    """The window of each metric as it stands at the metric's newest event."""
    newest = events.groupBy("metric").agg(F.max("event_us").alias("event_us"))
    # one row per metric: only that metric's last window has to be read, not every window
    newest = newest.withColumnRenamed("event_us", "newest_us")
    recent = join_summary(events, newest, ["metric"], salt=["event_us", "value"]).filter(
        F.col("event_us") >= F.col("newest_us") - window_us
    )
    n = F.col("n")
    return (
        recent.groupBy("metric")
        .agg(F.max("event_us").alias("event_us"), *_moments(F.col("value")))
        .select("metric", "event_us", *settle(n, F.col("avg"), F.col("ssd") / (n - 1), F.col("low"), F.col("high")))
    )

