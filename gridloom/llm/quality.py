"""Operator 1, quality classifier: supervised subword embeddings.

Every word and every character 2- to 4-gram of a text is hashed to a row of a learned embedding table; a document is the mean of its
rows, a softmax layer gives class probabilities. Table and layer are trained together by stochastic gradient descent in numpy, one
document a step, on a bounded sample of labelled rows. Because the mean and the output layer are both linear, scoring first projects the
table to one logit a class and row, and then only adds up logits: the same numbers at a fraction of the memory traffic.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_bucket, id_text, map_texts, read, release
from .pooled import pooled
from .textnum import Texts
from .training import balanced_ids, sparse_sample

#: Labelled rows of each class that are used for training at most.
TRAIN_ROWS_PER_CLASS = 1500
BITS, GRAMS, DIM = 18, (2, 3, 4), 8


class SubwordClassifier:
    """Embedding table, output layer and bias."""

    def __init__(self, classes: int, bits: int = BITS, dim: int = DIM, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bits, self.table = bits, rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
        self.out, self.bias = np.zeros((dim, classes), np.float32), np.zeros(classes, np.float32)
        self.out[:] = rng.normal(0, 0.5, self.out.shape)

    def fit(self, sample: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 12, rate: float = 0.6, seed: int = 11) -> SubwordClassifier:
        rng = np.random.default_rng(seed)
        steps, done = max(1, epochs * len(sample)), 0
        for _ in range(epochs):
            for i in rng.permutation(len(sample)):
                y, idx, cnt = sample[i]
                if not len(idx):
                    continue
                lr = rate * (1 - done / steps)
                done += 1
                w = cnt / cnt.sum()
                rows = self.table[idx]
                h = w @ rows
                z = h @ self.out + self.bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y] -= 1
                back = self.out @ p
                self.out -= lr * np.outer(h, p)
                self.bias -= lr * p * 0.1
                # a feature's step is not shrunk by the text's length as its share is; long texts would not learn otherwise
                self.table[idx] = rows - (lr * 20) * np.minimum(w * 8, 1)[:, None] * back[None, :].astype(np.float32)
        return self

    def logits(self) -> np.ndarray:
        """One row of class logits per bucket."""
        return (self.table @ self.out).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", rows_per_class: int = TRAIN_ROWS_PER_CLASS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket logits relative to class 0, bias) learned from labelled rows. Without rows of two classes: even scores."""
    ids = balanced_ids(labels, column, rows_per_class)
    sample = sparse_sample(docs, ids, column, BITS, GRAMS, True)
    if len({y for y, _, _ in sample}) < 2:
        return np.zeros((1 << BITS, 1), np.float32), np.zeros(1, np.float32)
    m = SubwordClassifier(2).fit([(int(y), i, c) for y, i, c in sample])
    z = m.logits()
    out = z[:, 1:] - z[:, :1], m.bias[1:] - m.bias[:1]
    del sample, m, z
    release()
    return out


def score(docs: DataFrame, table: np.ndarray, bias: np.ndarray, keep_text: bool = False) -> DataFrame:
    """``docs`` (doc_id, text and other columns) with the text replaced by (or kept beside) ``_score``: the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast((table, bias))

    def run(texts: list) -> dict:
        table, bias = shared.value
        total, count = pooled(Texts(texts), table, BITS, GRAMS, True)
        z = total[:, 0] / np.maximum(count, 1) + float(bias[0])
        return {"_score": 1 / (1 + np.exp(-np.clip(z, -60, 60)))}

    return map_texts(docs, run, "_score double", keep_text)


def classify(docs: DataFrame, labels: DataFrame, column: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Learns from labelled rows whose crc32(doc_id as text) mod 3 is not 1. Null texts count as empty; an empty text has no features and
    gets the bias alone. Rows that repeat an id each get a row (a null id counts as the empty text for the split). Empty tables give an
    empty result, without labels of two classes every score is 0.5; columns besides id and text are ignored.
    """
    rows = id_text(docs, id_col, text_col)
    usable = labels.select(F.col(id_col).cast("long").alias("doc_id"), column).where(crc_bucket(F.col("doc_id"), 3) != 1)
    table, bias = train(rows, usable, column)
    return score(rows, table, bias).select("doc_id", (crc_bucket(F.col("doc_id"), 3) == 1).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def drop_rejected(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without the rows that the classifier gives less than ``least``; all columns stay."""
    rows = id_text(docs)
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(crc_bucket(F.col("doc_id"), 3) != 1)
    table, bias = train(rows, usable, "quality")
    return score(docs, table, bias, keep_text=True).where(F.col("_score") >= least).select(*docs.columns)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
