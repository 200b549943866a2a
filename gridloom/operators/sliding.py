"""An ordered window that slides over a series: values are added and dropped one at a time, order statistics are read off."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np


class Sorted:
    """The values of a window in order; not-a-number is left out."""

    def __init__(self) -> None:
        self.values: list[float] = []

    def add(self, x: float) -> None:
        if x == x:
            insort(self.values, x)

    def drop(self, x: float) -> None:
        if x == x:
            del self.values[bisect_left(self.values, x)]

    def quantile(self, q: float) -> float:
        """By linear interpolation between the values around q (n - 1); not-a-number of none."""
        v = self.values
        if not v:
            return float("nan")
        at = q * (len(v) - 1)
        lo = int(at)
        return v[lo] if lo == at else v[lo] + (v[lo + 1] - v[lo]) * (at - lo)

    def _away(self, m: float, k: int) -> float:
        """The k-th smallest (from 0) absolute deviation from m: k + 1 values next to m in order are those nearest to it, and the first of them is
        found by bisection."""
        v = self.values
        lo, hi = 0, len(v) - k - 1
        while lo < hi:
            mid = (lo + hi) // 2
            if m - v[mid] > v[mid + k + 1] - m:
                lo = mid + 1
            else:
                hi = mid
        return max(abs(m - v[lo]), abs(v[lo + k] - m))

    def deviation(self) -> float:
        """Median of the absolute deviations from the median."""
        n = len(self.values)
        if not n:
            return float("nan")
        m = self.quantile(0.5)
        return self._away(m, n // 2) if n % 2 else (self._away(m, n // 2 - 1) + self._away(m, n // 2)) / 2


def centred_bounds(i: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First row and end of the adaptive centred window of each place in a series of n rows (see ``windows.centred``)."""
    h = width // 2
    if n <= width:
        return np.zeros(len(i), np.int64), np.full(len(i), n, np.int64)
    lo = np.where(i + h + 1 < width, 0, np.where(i - h > n - width, n - width, np.maximum(0, i - h)))
    hi = np.where(i + h + 1 < width, width, np.where(i - h > n - width, n, np.minimum(n, i + h + 1)))
    return lo, hi


def slide(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, reads: list[Callable[[Sorted], float]]) -> list[np.ndarray]:
    """What each of ``reads`` gives for the windows [lo, hi) of ``values``, whose edges never fall from one to the next."""
    w, out = Sorted(), [np.full(len(lo), np.nan) for _ in reads]
    a = b = int(lo[0]) if len(lo) else 0
    plain = values.tolist()
    for k, (x, y) in enumerate(zip(lo.tolist(), hi.tolist())):
        while b < y:
            w.add(plain[b])
            b += 1
        while a < x:
            w.drop(plain[a])
            a += 1
        for o, read in zip(out, reads):
            o[k] = read(w)
    return out
