"""Robust decomposition of a regular series into trend, season and rest by local regression."""

from __future__ import annotations

import functools

import numpy as np


#: Places that one product of a series with a band of weights smooths.
BAND = 64


@functools.lru_cache(maxsize=256)
def _bands(m: int, span: int, first: int, count: int) -> list[tuple[int, int, int, int, np.ndarray]]:
    """(place, runs, column, length, weights) of pieces of the places first, first + 1, ...: ``runs`` times ``BAND`` places from ``place`` on (or fewer
    in a single run), whose windows start at ``column`` and reach ``length`` values; the weights of each place times 1, x and x squared stand
    side by side. Places whose windows lie alike in the series share their weights."""
    at = np.arange(first, first + count)
    q = min(span, m)
    left = np.clip(at - q // 2, 0, m - q)
    reach = np.maximum(at - left, left + q - 1 - at) + max(0, (span - m) // 2)

    def weights(lo: int, hi: int) -> tuple[int, np.ndarray]:
        start, stop = left[lo], left[hi - 1] + q
        x = (np.arange(start, stop)[:, None] - at[lo:hi]).astype(float)
        far = np.abs(x) / np.maximum(reach[lo:hi], 1)
        t = np.where(far > 0.999, 0.0, np.clip(1 - far**3, 0, 1) ** 3)
        row = np.arange(start, stop)[:, None]
        t[(row < left[lo:hi]) | (row >= left[lo:hi] + q)] = 0.0
        return int(stop - start), np.concatenate([t, t * x, t * x * x], 1)

    inner = np.flatnonzero((at - q // 2 >= 0) & (at - q // 2 <= m - q))
    runs = len(inner) // BAND
    a, b = (int(inner[0]), int(inner[0]) + runs * BAND) if runs else (count, count)
    out = []
    if runs:
        length, w = weights(a, a + BAND)
        out.append((a, runs, int(left[a]), length, w))
    for lo, hi in ((0, a), (b, count)):
        for k in range(lo, hi, 2 * BAND):
            end = min(hi, k + 2 * BAND)
            length, w = weights(k, end)
            out.append((k, 1, int(left[k]), length, w))
    return out


def _sums(y: np.ndarray, bands: list, count: int, powers: int) -> np.ndarray:
    """Sums of each row's values times the weights about each place, for 1, x (and x squared): powers x rows x places."""
    out = np.empty((powers, len(y), count))
    for place, runs, column, length, w in bands:
        n = w.shape[1] // 3
        if runs > 1:
            part = np.lib.stride_tricks.sliding_window_view(y[:, column : column + (runs - 1) * BAND + length], length, 1)[:, ::BAND]
            got = (np.ascontiguousarray(part).reshape(-1, length) @ w[:, : powers * n]).reshape(len(y), runs, powers, n)
            out[:, :, place : place + runs * n] = got.transpose(2, 0, 1, 3).reshape(powers, len(y), runs * n)
        else:
            got = (y[:, column : column + length] @ w[:, : powers * n]).reshape(len(y), powers, n)
            out[:, :, place : place + n] = got.transpose(1, 0, 2)
    return out


class Lines:
    """Lines by least squares with given weights, for any values: rows of values smoothed at the successive places ``at`` (which may lie outside
    0..m-1) through the ``span`` nearest ones, with tricube weights of the distance times ``weight``. Where all weights are 0, the tricube ones
    alone count."""

    def __init__(self, weight: np.ndarray, span: int, at: np.ndarray) -> None:
        m, self.weight, self.count = weight.shape[1], weight, len(at)
        self.bands = _bands(m, span, int(at[0]), self.count)
        w0, w1, w2 = _sums(weight, self.bands, self.count, 3)
        self.none = w0 <= 0
        self.bare = bool(self.none.any())
        if self.bare:
            w0, w1, w2 = (np.where(self.none, t, w) for t, w in zip(_sums(np.ones((1, m)), self.bands, self.count, 3), (w0, w1, w2)))
        self.total = np.maximum(w0, 1e-300)
        self.mx = w1 / self.total
        spread = w2 - w1 * self.mx
        self.by = np.where(spread > 1e-9 * self.total, self.mx / np.maximum(spread, 1e-300), 0.0)

    def through(self, y: np.ndarray) -> np.ndarray:
        middle = y.mean(1, keepdims=True)
        v = y - middle
        v0, v1 = _sums(self.weight * v, self.bands, self.count, 2)
        if self.bare:
            u0, u1 = _sums(v, self.bands, self.count, 2)
            v0, v1 = np.where(self.none, u0, v0), np.where(self.none, u1, v1)
        return v0 / self.total - (v1 - self.mx * v0) * self.by + middle


def local_lines(y: np.ndarray, weight: np.ndarray, span: int, at: np.ndarray) -> np.ndarray:
    """Rows of ``y`` smoothed at the places ``at`` by ``Lines`` with these weights."""
    return Lines(np.broadcast_to(weight, y.shape), span, at).through(y)


def moving_mean(y: np.ndarray, n: int) -> np.ndarray:
    """Means of n neighbours; n - 1 values fewer."""
    return np.convolve(y, np.full(n, 1 / n), "valid")


def decompose(y: np.ndarray, period: int, season_span: int = 7, rounds: int = 15, inner: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(trend, season) of at least two periods of known values.

    The season is smoothed over the same places of successive periods and freed of what moving means of a period leave of it, the trend over
    about one and a half periods on what remains, in turns; after each round, values with a large rest count less (bisquare of the rest over
    six times its median), and rounds end when the weights settle.
    """
    n = len(y)
    trend_span = int(np.ceil(1.5 * period / (1 - 1.5 / season_span)))
    trend_span += 1 - trend_span % 2
    low_span = period + 1 - period % 2
    trend, season, weight = np.zeros(n), np.zeros(n), np.ones(n)
    everywhere = np.arange(n)
    lengths = -(-(n - np.arange(period)) // period)
    phases = {int(m): np.flatnonzero(lengths == m) for m in np.unique(lengths)}
    index = {m: p[:, None] + period * np.arange(m) for m, p in phases.items()}
    place = {m: p[:, None] + period * np.arange(m + 2) for m, p in phases.items()}
    low_lines = Lines(np.ones((1, n)), low_span, everywhere)
    for _ in range(rounds):
        # weights stay during a round, and with them all of a line but the values
        cycle_lines = {m: Lines(weight[i], season_span, np.arange(-1, m + 1)) for m, i in index.items()}
        trend_lines = Lines(weight[None], trend_span, everywhere)
        for _ in range(inner):
            left = y - trend
            cycle = np.zeros(n + 2 * period)
            for m, i in index.items():
                cycle[place[m]] = cycle_lines[m].through(left[i])
            low = moving_mean(moving_mean(moving_mean(cycle, period), period), 3)
            season = cycle[period : n + period] - low_lines.through(low[None])[0]
            trend = trend_lines.through((y - season)[None])[0]
        rest = np.abs(y - trend - season)
        scale = 6 * np.median(rest)
        new = np.clip(1 - (rest / scale) ** 2, 0, 1) ** 2 if scale > 1e-12 else np.ones(n)
        settled = np.abs(new - weight).max(initial=0.0) < 1e-3
        weight = new
        if settled:
            break
    return trend, season
