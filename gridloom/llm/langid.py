"""Operator 10, language identification by error-correcting output codes.

Every language gets a codeword of bits. For each bit, a linear classifier over hashed character 1- to 3-grams learns to tell the
languages with a one from those with a zero. A text's bit margins are compared with each codeword by a logistic loss, each bit weighed
by how reliable it was in training; the language of least loss is chosen, and a text whose two best losses lie close is flagged.
Up to seven languages get the exhaustive code (every way to split them), more a random code of the largest minimum distance found.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_bucket, id_text, map_texts, read
from .pooled import pooled
from .textnum import Texts
from .training import balanced_ids, sparse_sample

#: Rows of each language that are used for training at most.
TRAIN_ROWS_PER_LANGUAGE = 800
BITS, GRAMS = 16, (1, 2, 3)
#: Below this difference of the two best scores a text is ambiguous.
AMBIGUOUS = 0.2
UNKNOWN = "und"


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """n codewords of -1 and 1, rows apart from each other."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        bits = (1 << (n - 1)) - 1
        masks = np.arange(1, bits + 1)  # language 0 always has 0, so no split and its complement are both used
        return np.where(masks[None, :] >> np.maximum(np.arange(n)[:, None] - 1, 0) & 1 & (np.arange(n)[:, None] > 0), 1.0, -1.0)
    rng, length = np.random.default_rng(seed), int(np.ceil(15 * np.log2(n)))
    best, far = None, -1.0
    for _ in range(300):
        c = rng.choice((-1.0, 1.0), (n, length))
        d = (length - c @ c.T) / 2
        np.fill_diagonal(d, length)
        if d.min() > far and np.all(np.abs(c.sum(0)) < n):
            best, far = c, d.min()
    return best


def fit_bits(sample: list[tuple[int, np.ndarray, np.ndarray]], code: np.ndarray, epochs: int = 6, rate: float = 4.0, seed: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(table of bucket weights, bias, weight of each bit). A bit's weight is the log odds of its being right on the last epoch."""
    rng = np.random.default_rng(seed)
    w, b = np.zeros((1 << BITS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    steps, done = max(1, epochs * len(sample)), 0
    right = np.zeros(code.shape[1])
    for epoch in range(epochs):
        right[:] = 0
        for i in rng.permutation(len(sample)):
            y, idx, cnt = sample[i]
            x = cnt / max(1.0, float(cnt.sum()))
            margin = code[y] * (x @ w[idx] + b)
            right += margin > 0
            g = (code[y] / (1 + np.exp(np.clip(margin, -30, 30)))).astype(np.float32)
            lr = rate * (1 - done / steps)
            done += 1
            w[idx] += (lr * 40) * x[:, None] * g[None, :]
            b += lr * 0.01 * g
    share = (right + 1) / (len(sample) + 2)
    return w, b, np.log(share / (1 - share)).clip(0.1, 6)


def decode(margins: np.ndarray, code: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Scores (rows sum to 1) of the codewords: softmax of the negative weighted logistic losses."""
    loss = np.stack([(np.logaddexp(0, -margins * c[None, :]) * weight[None, :]).sum(1) for c in code], 1)
    z = -(loss - loss.min(1, keepdims=True))
    p = np.exp(z)
    return p / p.sum(1, keepdims=True)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, ambiguous.

    Learns from rows with text and a language whose crc32(doc_id as text) mod 5 is not 0. Null and empty texts and texts without a letter
    get ``und`` with score 0 and are not ambiguous (of more than 1,000 languages the commonest are learned); so does every text where no row can be learned from. With one language only, all other
    texts get it with score 1. Rows that repeat an id each get a row; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    usable = rows.where((crc_bucket(F.col("doc_id"), 5) != 0) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    sample = sparse_sample(rows.select("doc_id", "text"), balanced_ids(usable.select("doc_id", "lang"), "lang", TRAIN_ROWS_PER_LANGUAGE), "lang", BITS, GRAMS, False)
    langs = sorted({y for y, _, _ in sample})
    code = codewords(len(langs))
    place = {l: i for i, l in enumerate(langs)}
    w, b, weight = fit_bits([(place[y], i, c) for y, i, c in sample if len(i)], code) if langs else (np.zeros((1, 1)), np.zeros(1), np.ones(1))
    shared = docs.sparkSession.sparkContext.broadcast((w, b, weight, code, langs))

    def run(texts: list) -> dict:
        w, b, weight, code, langs = shared.value
        if not langs:
            return {"lang_pred": [UNKNOWN] * len(texts), "score": [0.0] * len(texts), "ambiguous": [False] * len(texts)}
        total, count = pooled(Texts(texts), w, BITS, GRAMS, False)
        p = decode(total / np.maximum(count, 1)[:, None] + b, code, weight)
        top = np.sort(p, 1)
        letter = np.fromiter(map(has_letter, texts), bool, len(texts))
        near = (top[:, -1] - top[:, -2] < AMBIGUOUS) if len(langs) > 1 else np.zeros(len(texts), bool)
        return {"lang_pred": [langs[k] if ok else UNKNOWN for k, ok in zip(p.argmax(1), letter)], "score": np.where(letter, top[:, -1], 0.0), "ambiguous": near & letter}

    out = map_texts(rows.select("doc_id", "text"), run, "lang_pred string, score double, ambiguous boolean")
    return out.select("doc_id", (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "ambiguous")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))
