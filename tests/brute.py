"""Plain quadratic definitions the operators are compared with."""

from __future__ import annotations

import statistics


def window_values(rows, metric, us, window_us):
    return [v for m, t, v in rows if m == metric and us - window_us <= t <= us]


def stats(values):
    n = len(values)
    if n == 0:
        return 0, 0.0, 0.0
    return n, statistics.fmean(values), statistics.variance(values) if n > 1 else 0.0


def bounds(values, lower, upper):
    ordered = sorted(values)
    n = len(ordered)
    return ordered[min(int(n * lower / 100), n - 1)], ordered[min(int(n * upper / 100), n - 1)]


def greedy(times, interval):
    sent, last = [], None
    for t in sorted(times):
        if last is None or t - last >= interval:
            sent.append(t)
            last = t
    return sent
