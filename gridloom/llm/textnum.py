"""Vectorised views of texts: code points, words and 64-bit hashes of words, n-grams and shingles (numpy)."""

from __future__ import annotations

import numpy as np

_R = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_pow: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the odd multiplier and of its inverse modulo 2^64."""
    if not _pow or len(_pow[0]) <= n:
        size = max(n + 1, 1 << 20) + 64
        both = []
        for base in (_R, _INV):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        _pow[:] = both
    return _pow[0], _pow[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit (splitmix64 constants)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Texts:
    """Texts joined by a line feed, as code points, with the words ``[^\\x20\\x09-\\x0D]+`` of each."""

    def __init__(self, texts: list[str | None], lower_ascii: bool = False):
        texts = [t or "" for t in texts]
        self.n = len(texts)
        self.lengths = np.fromiter(map(len, texts), np.int64, self.n)
        self.offsets = np.concatenate(([0], np.cumsum(self.lengths + 1)))
        joined = "\n".join(texts) + "\n" if texts else ""
        self.cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        if lower_ascii:
            self.cp = np.where((self.cp >= 65) & (self.cp <= 90), self.cp + 32, self.cp)
        space = (self.cp == 32) | ((self.cp >= 9) & (self.cp <= 13))
        edge = np.diff(np.concatenate(([1], space.view(np.int8), [1])))
        self.starts = np.flatnonzero(edge == -1)
        self.ends = np.flatnonzero(edge == 1)
        self.space = space
        #: number of words before each text, one more at the end
        self.word_at = np.searchsorted(self.starts, self.offsets)
        self.n_words = np.diff(self.word_at)
        self._prefix = None

    def word_doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_words)

    def prefix(self) -> np.ndarray:
        if self._prefix is None:
            power, _ = _powers(len(self.cp))
            c = (self.cp.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
            c ^= c >> np.uint64(29)
            self._prefix = np.zeros(len(self.cp) + 1, np.uint64)
            np.cumsum(c * power[: len(c)], out=self._prefix[1:])
        return self._prefix

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of the code points in each [start, end), alike wherever they stand."""
        p, (_, inverse) = self.prefix(), _powers(len(self.cp))
        return mix((p[ends] - p[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))

    def words(self) -> np.ndarray:
        return self.span_hash(self.starts, self.ends)

    def grams(self, n: int) -> np.ndarray:
        """Rolling hash of each n code points; the grams that begin in a text's last n-1 places run over its end."""
        m = len(self.cp) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        h = np.zeros(m, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x2545F4914F6CDD1D) + self.cp[j : j + m].astype(np.uint64) + np.uint64(1)
        return h


def sequences(word_hash: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each start."""
    h = np.full(len(starts), n, np.uint64)
    for j in range(n):
        h = mix(h * np.uint64(0x2545F4914F6CDD1D) + word_hash[starts + j])
    return h


def shingle_sets(t: Texts, size: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; a text with fewer words is one shingle, one without words none."""
    w, at, counts = t.words(), t.word_at, t.n_words
    full = sequences(w, np.arange(max(0, len(w) - size + 1)), size)
    out = []
    for i in range(t.n):
        n, lo = int(counts[i]), int(at[i])
        if n >= size:
            out.append(np.unique(full[lo : lo + n - size + 1]))
        elif n:
            out.append(sequences(w, np.array([lo]), n))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
