"""Hashed word and character n-gram features of whole texts, pooled per text, for the classifiers."""

from __future__ import annotations

import numpy as np

from .textnum import Texts, mix


def _bucket(h: np.ndarray, bits: int, salt: int) -> np.ndarray:
    return ((h + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


def feature_runs(t: Texts, bits: int, grams: tuple[int, ...], words: bool):
    """Yield (bucket of each feature, first feature of each text, end of each text) for every kind of feature."""
    for n in grams:
        size = np.maximum(t.lengths - n + 1, 0)
        yield _bucket(t.grams(n), bits, n), t.offsets[:-1], t.offsets[:-1] + size
    if words:
        w = t.words()
        yield _bucket(w, bits, 101), t.word_at[:-1], t.word_at[1:]
        # a word that repeats the one before it counts as a word of its own kind
        again = np.zeros(len(w), np.uint64)
        again[1:] = w[1:] == w[:-1]
        if len(t.word_at) > 1:
            first = t.word_at[:-1]
            again[first[first < len(w)]] = 0
        yield _bucket(mix(again), bits, 202), t.word_at[:-1], t.word_at[1:]


def pooled(t: Texts, table: np.ndarray, bits: int, grams: tuple[int, ...], words: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the table's rows over each text's features, and the number of features."""
    total = np.zeros((t.n, table.shape[1]))
    count = np.zeros(t.n, np.int64)
    for bucket, lo, hi in feature_runs(t, bits, grams, words):
        some = np.flatnonzero(hi > lo)
        count[some] += (hi - lo)[some]
        if len(some):
            edges = np.stack((lo[some], hi[some]), 1).ravel()
            for c in range(table.shape[1]):
                v = np.append(table[:, c][bucket], np.float32(0)).astype(np.float32)
                total[some, c] += np.add.reduceat(v, edges)[::2]
    return total, count


def sparse(t: Texts, bits: int, grams: tuple[int, ...], words: bool) -> dict:
    """Distinct buckets (int32) and counts (float32) of each text, as bytes."""
    parts = list(feature_runs(t, bits, grams, words))
    idx, cnt = [], []
    for i in range(t.n):
        u, c = np.unique(np.concatenate([b[lo[i] : hi[i]] for b, lo, hi in parts]) if parts else np.zeros(0, np.int64), return_counts=True)
        idx.append(u.astype(np.int32).tobytes())
        cnt.append(c.astype(np.float32).tobytes())
    return {"idx": idx, "cnt": cnt}
