"""Statistics of many index ranges of one array at once, for use inside tasks."""

from __future__ import annotations

import numpy as np


def _merge(a: tuple, b: tuple) -> tuple:
    """Combine (count, mean, squared deviations, low, high) of disjoint parts, element by element."""
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros(len(n)), where=n > 0)
    gap = b[1] - a[1]
    return (
        n,
        a[1] + gap * share,
        a[2] + b[2] + gap * gap * a[0] * share,
        np.minimum(a[3], b[3]),
        np.maximum(a[4], b[4]),
    )


def range_moments(values: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, mean and sample variance of ``values[left:right]`` for every pair of bounds.

    Ranges are put together from runs of 1, 2, 4, ... values by pairwise merging. Nothing is ever
    subtracted, so a spike that has left a range leaves no rounding error behind.
    """
    m, size = len(values), right - left
    v = values.astype(float)
    run = (np.ones(m), v, np.zeros(m), v, v)
    q = len(left)
    total = (np.zeros(q), np.zeros(q), np.zeros(q), np.full(q, np.inf), np.full(q, -np.inf))
    at, length = left.copy(), 1
    longest = int(size.max()) if q else 0
    while length <= longest:
        use = (size & length) > 0
        if use.any():
            picked = tuple(part[at[use]] for part in run)
            for whole, part in zip(total, _merge(tuple(t[use] for t in total), picked)):
                whole[use] = part
            at[use] += length
        if 2 * length <= longest:
            run = _merge(tuple(part[:-length] for part in run), tuple(part[length:] for part in run))
        length *= 2
    n, mean, ssd, low, high = total
    spread = (n > 1) & (low < high)
    variance = np.divide(ssd, n - 1, out=np.zeros(q), where=spread)
    return n.astype(np.int64), np.where((n > 0) & ~(low < high), low, mean), variance
