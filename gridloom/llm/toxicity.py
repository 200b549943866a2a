"""Operator 7, toxicity by weak supervision.

1. Lexicons of words and of word beginnings (4 to 6 characters) are mined from a bounded sample of labelled rows; each kind is dealt over
   several voters. With patterns (shouting, exclamation marks, repeated punctuation) they are the voters: a voter says toxic, clean or nothing.
2. A generative label model, which sees the votes and no label, estimates how often each voter is right under either class, and how far
   voters repeat each other beyond what the class explains; a voter counts the less the more it repeats others. The result is a
   posterior probability for each sampled text.
3. A linear classifier over hashed words and word beginnings is trained on these posteriors; features without evidence beyond chance have no
   weight. It scores every whole text by the distinct features it has; the lexicons are not needed any more.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_bucket, id_text, map_texts, read
from .textnum import Texts, mix
from .training import balanced_ids, byte_cut

#: Labelled rows of each class that are used at most.
TRAIN_ROWS_PER_CLASS = 3000
BITS = 20
PREFIXES = (4, 5, 6)
SHARDS = 4
FAMILIES = ("word", *(f"prefix{n}" for n in PREFIXES))
PATTERNS = ("shouting", "exclaiming", "punctuation")


def token_hashes(t: Texts) -> list[np.ndarray]:
    """Hashes of each word, and of its first 4, 5 and 6 characters where it is longer than that (0 otherwise); one array a family."""
    out = [t.words()]
    for n in PREFIXES:
        ends = np.minimum(t.starts + n, t.ends)
        h = mix(t.span_hash(t.starts, ends) + np.uint64(n))
        h[t.ends - t.starts <= n] = 0
        out.append(h)
    return out


def _lower(texts: list) -> Texts:
    # letters of any script in lower case, and what stands before or after them stripped, so "Word," is "word"
    return Texts([" ".join(w.strip(_EDGES) for w in (t or "").lower().split()) for t in texts])


_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def distinct_features(texts: list) -> dict:
    """Per text: distinct (family, hash) as bytes, and the patterns it shows as a bit mask."""
    t = _lower(texts)
    fams = token_hashes(t)
    feats, shows = [], []
    for i in range(t.n):
        lo, hi = t.word_at[i], t.word_at[i + 1]
        feats.append(b"".join(len(u := np.unique(f[lo:hi])).to_bytes(4, "little") + u.tobytes() for f in fams))
        raw = texts[i] or ""
        n = max(len(raw), 1)
        shows.append((sum(map(str.isupper, raw)) > 0.3 * n) | (raw.count("!") > 0.02 * n) << 1 | any(p in raw for p in ("!!!", "???", "?!?")) << 2)
    return {"feats": feats, "shows": shows}


def _families(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    for _ in FAMILIES:
        n = int.from_bytes(blob[at : at + 4], "little")
        out.append(np.frombuffer(blob, np.uint64, n, at + 4))
        at += 4 + 8 * n
    return out


def mine(sample: list[tuple[int, list[np.ndarray]]], least: int = 4, odds: float = 3.0) -> list[np.ndarray]:
    """Sorted lexicon of each family: hashes in ``least`` toxic texts or more and ``odds`` times likelier there (log scale)."""
    n1 = sum(y for y, _ in sample)
    n0 = len(sample) - n1
    out = []
    for f in range(len(FAMILIES)):
        both = []
        for y in (1, 0):
            parts = [fams[f] for label, fams in sample if label == y]
            both.append(np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_counts=True))
        (u1, c1), (u0, c0) = both
        at = np.searchsorted(u0, u1)
        clean = np.where((at < len(u0)) & (u0[np.minimum(at, len(u0) - 1)] == u1), c0[np.minimum(at, len(u0) - 1)], 0) if len(u0) else np.zeros(len(u1))
        score = np.log((c1 + 0.5) / (n1 + 1)) - np.log((clean + 0.5) / (n0 + 1))
        out.append(u1[(c1 >= least) & (score > odds) & (u1 != 0)])
    return out


def votes(sample: list[tuple[list[np.ndarray], int]], lexicons: list[np.ndarray]) -> np.ndarray:
    """One row a text: 1 toxic, -1 clean, 0 nothing. Shards of a lexicon say toxic or nothing; a whole family without a hit says clean."""
    out = np.zeros((len(sample), len(FAMILIES) * (SHARDS + 1) + len(PATTERNS)), np.int8)
    for i, (fams, shows) in enumerate(sample):
        for f, lexicon in enumerate(lexicons):
            hits = np.intersect1d(fams[f], lexicon, assume_unique=True)
            base = f * (SHARDS + 1)
            out[i, base + (mix(hits) % np.uint64(SHARDS)).astype(int)] = 1
            out[i, base + SHARDS] = 0 if len(hits) else -1
        for k in range(len(PATTERNS)):
            out[i, len(FAMILIES) * (SHARDS + 1) + k] = shows >> k & 1
    return out


def label_model(v: np.ndarray, rounds: int = 40, prior: float = 0.3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of toxic for each row, P(vote | class) as [class, voter, vote + 1], independence weight of each voter), labels unseen."""
    n, m = v.shape
    said = np.stack([v == o for o in (-1, 0, 1)], 2).astype(float)
    post = np.clip((v == 1).any(1) * 0.9 + 0.05, 0, 1)
    weight, share = np.ones(m), prior
    for r in range(rounds):
        p = np.stack([((1 - post)[:, None, None] * said).sum(0), (post[:, None, None] * said).sum(0)])
        p = (p + 0.5) / (p.sum(2, keepdims=True) + 1.5)
        share = float(np.clip(post.mean(), 0.02, 0.98))
        if r % 10 == 5:  # what two voters share beyond the class
            mean = (1 - post)[:, None] * (p[0, :, 2] - p[0, :, 0]) + post[:, None] * (p[1, :, 2] - p[1, :, 0])
            rest = v - mean
            scale = np.sqrt((rest**2).mean(0)) + 1e-6
            rho = np.abs(rest.T @ rest / n / np.outer(scale, scale))
            np.fill_diagonal(rho, 0)
            weight = 1 / (1 + np.where(rho > 0.1, rho, 0).sum(1))
        odds = np.log(share / (1 - share)) + ((np.log(p[1]) - np.log(p[0]))[None] * said).sum(2) @ weight
        post = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
    return post, p, weight


def _slots(fams: list[np.ndarray]) -> np.ndarray:
    h = np.concatenate([mix(f[f != 0] + np.uint64(k)) for k, f in enumerate(fams)])
    return np.unique((h >> np.uint64(64 - BITS)).astype(np.int64))


def fit_linear(slots: list[np.ndarray], target: np.ndarray, ridge: float = 0.3, least: float = 3.0, steps: int = 200) -> tuple[np.ndarray, float]:
    """Logistic weights over bucket presence for soft targets, and the bias.

    A bucket counts by its smoothed log odds between the targets' classes, and only if its share of label 1 is more than ``least`` standard errors
    away from the sample's: what a small sample shows by chance has no weight. Texts of label 1 weigh more by the root of the classes' ratio,
    so that a rare class isn't given up for the bias. Full gradient steps of adaptive length.
    """
    table = np.zeros(1 << BITS, np.float32)
    ones = float(target.sum())
    zeros = len(target) - ones
    if not slots or min(ones, zeros) <= 0:
        return table, 0.0
    doc = np.repeat(np.arange(len(slots)), [len(s) for s in slots])
    used, at, n = np.unique(np.concatenate(slots), return_inverse=True, return_counts=True)
    in_ones = np.bincount(at, target[doc], len(used))
    odds = np.log((in_ones + 1) / (ones + 2)) - np.log((n - in_ones + 1) / (zeros + 2))
    share = ones / len(target)
    odds[np.abs(in_ones - n * share) <= least * np.sqrt(n * share * (1 - share))] = 0
    some = odds[at] != 0
    at, doc, x = at[some], doc[some], odds[at[some]]
    heavy = 1 + (np.sqrt(zeros / ones) - 1) * target
    w, b, squares, square = np.zeros(len(used)), 0.0, np.full(len(used), 1e-6), 1e-6
    for _ in range(steps):
        off = heavy * (1 / (1 + np.exp(-np.clip(np.bincount(doc, w[at] * x, len(slots)) + b, -30, 30))) - target)
        step, step_b = np.bincount(at, off[doc] * x, len(used)) + ridge * w, off.sum()
        squares, square = squares + step * step, square + step_b * step_b
        w, b = w - 0.5 * step / np.sqrt(squares), b - 0.5 * step_b / np.sqrt(square)
    table[used] = w * odds
    return table, float(b)


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", rows_per_class: int = TRAIN_ROWS_PER_CLASS) -> tuple[np.ndarray, float]:
    ids = balanced_ids(labels, column, rows_per_class)
    chosen = docs.join(F.broadcast(ids.select("doc_id", F.col(column).alias("_label"))), "doc_id").select("doc_id", "_label", "text")
    rows = byte_cut(map_texts(chosen, distinct_features, "feats binary, shows int"), F.octet_length("feats")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    fams = [_families(r["feats"]) for r in rows]
    if len({r["_label"] for r in rows}) < 2:
        return np.zeros(1 << BITS, np.float32), 0.0
    lexicons = mine([(int(r["_label"]), f) for r, f in zip(rows, fams)])
    v = votes([(f, r["shows"]) for r, f in zip(rows, fams)], lexicons)
    post, _, _ = label_model(v)
    return fit_linear([_slots(f) for f in fams], post)


def score(docs: DataFrame, table: np.ndarray, bias: float) -> DataFrame:
    """``docs`` with the text replaced by score: the probability of label 1."""
    some = np.flatnonzero(table)
    shared = docs.sparkSession.sparkContext.broadcast((some, table[some], bias))

    def run(texts: list) -> dict:
        some, weights, bias = shared.value
        table = np.zeros(1 << BITS, np.float32)
        table[some] = weights
        t = _lower(texts)
        total = np.full(t.n, float(bias))
        doc = t.word_doc()
        hits = []
        for k, f in enumerate(token_hashes(t)):
            slot = (mix(f + np.uint64(k)) >> np.uint64(64 - BITS)).astype(np.int64)
            found = np.flatnonzero((table[slot] != 0) & (f != 0))
            hits.append(doc[found] << BITS | slot[found])
        hits = np.unique(np.concatenate(hits))
        np.add.at(total, hits >> BITS, table[hits & ((1 << BITS) - 1)])
        return {"score": 1 / (1 + np.exp(-np.clip(total, -60, 60)))}

    return map_texts(docs, run, "score double")


def classify(docs: DataFrame, labels: DataFrame, column: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Learns from labelled rows whose crc32(doc_id as text) mod 5 is not 0. Null and empty texts have no features and get the bias alone.
    Rows that repeat an id each get a row. Empty tables give an empty result, without labels of two classes every score is 0.5; columns
    besides id and text are ignored.
    """
    rows = id_text(docs, id_col, text_col)
    usable = labels.select(F.col(id_col).cast("long").alias("doc_id"), column).where(crc_bucket(F.col("doc_id"), 5) != 0)
    table, bias = train(rows, usable, column)
    return score(rows, table, bias).select("doc_id", (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
