"""Exact floor-index percentile bounds of each event's sliding window.

The bound at ``p`` percent of a window with ``n`` values is the value at index ``floor(n*p/100)``
of the sorted window, without interpolation. No built-in percentile picks that element, and a
sorted list per row would take memory of rows times window size. Here events are first counted
per (metric, instant, value), spread over time buckets with a halo, and each bucket answers all
its windows with bitwise selection over value ranks in O(n log n).

A bucket whose rows pass ``limit`` is first thinned without changing the answer: the bounds only
depend on the values near both ends of the window. See ``_thin``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegauge.operators.windows import int_div, with_halo

MAX_ROWS_PER_BUCKET = 2_000_000
# How much further inwards than the wanted percentile the trial cuts lie.
CUT_FACTORS = (1.5, 3.0, 10.0)
CUT_SLICES = 16

BOUNDS_SCHEMA = "metric string, event_us bigint, lower_bound double, upper_bound double"


def select_kth(values: np.ndarray, weights: np.ndarray, left: np.ndarray, right: np.ndarray, kth: np.ndarray) -> np.ndarray:
    """For every query, the ``kth`` smallest (0-based, by weight) of ``values[left:right]``.

    Values become dense ranks, and the ranks are fixed bit by bit from the top for all queries at
    once: rows are split stably by the bit, and a query follows the side that holds its k-th row.
    """
    distinct, code = np.unique(values, return_inverse=True)
    left, right, kth = left.copy(), right.copy(), kth.copy()
    found = np.zeros(len(kth), dtype=np.int64)
    for bit in range(max(1, int(len(distinct) - 1).bit_length()) - 1, -1, -1):
        zero = (code >> bit) & 1 == 0
        rows_before = np.concatenate(([0], np.cumsum(zero)))
        weight_before = np.concatenate(([0], np.cumsum(np.where(zero, weights, 0))))
        in_zero = weight_before[right] - weight_before[left]
        down = kth < in_zero
        zl, zr, zeros = rows_before[left], rows_before[right], rows_before[-1]
        left = np.where(down, zl, zeros + left - zl)
        right = np.where(down, zr, zeros + right - zr)
        kth = np.where(down, kth, kth - in_zero)
        found = (found << 1) | ~down
        order = np.concatenate((np.flatnonzero(zero), np.flatnonzero(~zero)))
        code, weights = code[order], weights[order]
    return distinct[found]


def _bucket_bounds(window_us: int, lower: float, upper: float):
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("event_us", kind="stable")
        times = pdf["event_us"].to_numpy()
        weights = pdf["weight"].to_numpy()
        values = pdf["value"].to_numpy()
        asked = pdf[pdf["core"]].drop_duplicates("event_us")
        at = asked["event_us"].to_numpy()
        out = pd.DataFrame({"metric": asked["metric"].to_numpy(), "event_us": at})
        if not len(out):
            return out.assign(lower_bound=[], upper_bound=[])
        left = np.searchsorted(times, at - window_us, side="left")
        right = np.searchsorted(times, at, side="right")
        running = np.concatenate(([0], np.cumsum(weights)))
        held = running[right] - running[left]
        # rows thinned out of the window lie between the two tails: count them in, from the true size
        n = asked["window_count"].to_numpy()
        low = np.minimum(np.floor(n * lower / 100.0).astype(np.int64), n - 1)
        high = np.minimum(np.floor(n * upper / 100.0).astype(np.int64), n - 1)
        out["lower_bound"] = select_kth(values, weights, left, right, low)
        out["upper_bound"] = select_kth(values, weights, left, right, held - (n - high))
        return out

    return solve


def _thin(spread: DataFrame, hot: DataFrame, window_us: int, lower: float, upper: float) -> DataFrame:
    """Drop rows from overfull buckets that cannot be a bound of any window in the bucket.

    For a few trial cuts near each end (approximate percentiles of the bucket, so only a guess),
    rows at or beyond the cut are counted exactly per time slice. A cut is safe when, for every
    slice, the whole slices inside each of its windows already hold more such rows than the
    largest index any of these windows can ask for. The tightest safe cut on each side is used;
    with none, that bucket keeps all its rows. A dropped value lies strictly between the bounds of
    its own window, so no flagged row is lost, and the bounds of the kept rows stay exact.
    """
    # only as many rows as buckets over the limit; Spark sizes this side before it picks a join
    marked = spread.join(hot.withColumn("hot", F.lit(True)), ["metric", "bucket"], "left")
    rows = marked.filter("hot")
    low_ps = [min(1.0, f * max(lower, 0.1) / 100) for f in CUT_FACTORS]
    high_ps = [max(0.0, 1 - f * max(100 - upper, 0.1) / 100) for f in CUT_FACTORS]
    trial = rows.groupBy("metric", "bucket").agg(
        F.percentile_approx("value", low_ps, 10_000).alias("low_cuts"),
        F.percentile_approx("value", high_ps, 10_000).alias("high_cuts"),
    )
    width = -(-window_us // CUT_SLICES)
    inner = window_us // width - 1  # whole slices that every window ending in a slice contains
    k = range(len(CUT_FACTORS))
    weigh = lambda cond: F.sum(F.when(cond, F.col("weight")).otherwise(F.lit(0)))
    per_slice = (
        rows.join(trial, ["metric", "bucket"])
        .withColumn("slice", int_div("event_us", width))
        .groupBy("metric", "bucket", "slice")
        .agg(
            F.sum("weight").alias("all_rows"),
            F.max("core").alias("asked"),
            *[weigh(F.col("value") <= F.col("low_cuts")[i]).alias(f"low{i}") for i in k],
            *[weigh(F.col("value") >= F.col("high_cuts")[i]).alias(f"high{i}") for i in k],
        )
    )
    by_slice = Window.partitionBy("metric", "bucket").orderBy("slice")
    certain = by_slice.rangeBetween(-inner, -1)
    possible = by_slice.rangeBetween(-inner - 2, 0)
    most = F.sum("all_rows").over(possible)
    low_need = F.floor(most * lower / 100) + 1
    high_need = most - F.floor(most * upper / 100) + 1
    safe = per_slice.select(
        "metric", "bucket", "asked",
        *[(F.coalesce(F.sum(f"low{i}").over(certain), F.lit(0)) >= low_need).alias(f"low{i}") for i in k],
        *[(F.coalesce(F.sum(f"high{i}").over(certain), F.lit(0)) >= high_need).alias(f"high{i}") for i in k],
    ).filter("asked")
    cuts = (
        safe.groupBy("metric", "bucket")
        .agg(*[F.bool_and(f"{side}{i}").alias(f"{side}{i}") for side in ("low", "high") for i in k])
        .join(trial, ["metric", "bucket"])
        .select(
            "metric", "bucket",
            F.coalesce(*[F.when(F.col(f"low{i}"), F.col("low_cuts")[i]) for i in k]).alias("low_cut"),
            F.coalesce(*[F.when(F.col(f"high{i}"), F.col("high_cuts")[i]) for i in k]).alias("high_cut"),
        )
    )
    joined = marked.join(cuts, ["metric", "bucket"], "left")
    open_end = F.col("low_cut").isNull() | F.col("high_cut").isNull()
    near_end = (F.col("value") <= F.col("low_cut")) | (F.col("value") >= F.col("high_cut"))
    return joined.filter(open_end | near_end).drop("hot", "low_cut", "high_cut")


def percentile_bounds(
    events: DataFrame,
    stats: DataFrame,
    window_us: int,
    lower: float,
    upper: float,
    min_count: int,
    flagged_only: bool = False,
    limit: int = MAX_ROWS_PER_BUCKET,
) -> DataFrame:
    """Bounds per (metric, event_us) for windows of at least ``min_count`` events.

    ``stats`` holds ``metric, event_us, window_count``. With ``flagged_only`` overfull buckets are
    thinned, and instants that cannot hold an event outside its bounds may be missing. NULL and NaN
    values have no place in an order: they count neither here nor in ``window_count``.
    """
    events = events.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    per_window = events.groupBy("metric", int_div("event_us", window_us).alias("w")).count()
    fullest = per_window.agg(F.max("count")).first()[0] or 0
    bucket_us = window_us if 5 * fullest > limit else 4 * window_us

    counted = (
        events.groupBy("metric", "event_us", "value")
        .agg(F.count(F.lit(1)).alias("weight"))
        .join(stats.select("metric", "event_us", "window_count"), ["metric", "event_us"])
    )
    spread = with_halo(counted, window_us, bucket_us)
    if flagged_only and 2 * fullest > limit and window_us >= 2 * CUT_SLICES:
        # a bucket is one window long here, and its halo is the bucket before it
        both = per_window.select("metric", F.explode(F.array("w", F.col("w") + 1)).alias("bucket"), "count")
        sizes = both.groupBy("metric", "bucket").agg(F.sum("count").alias("bucket_rows"))
        hot = sizes.filter(F.col("bucket_rows") > limit).select("metric", "bucket")
        spread = _thin(spread, hot, window_us, lower, upper)
    asked = spread.withColumn("core", F.col("core") & (F.col("window_count") >= min_count))
    return asked.groupBy("metric", "bucket").applyInPandas(_bucket_bounds(window_us, lower, upper), BOUNDS_SCHEMA)
