"""Bounded labelled samples for the trained operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts
from .pooled import sparse
from .textnum import Texts


#: Parts of the hash range that a sample is first cut from, and how many times the rows wanted it is to hold.
PARTS, MARGIN = 1_000_000, 8


#: Bytes of features of each class that a sample sends to the driver at most; a single text may take an eighth of them.
SAMPLE_BYTES = 24_000_000


def hash_cut(df: DataFrame, rows: int, total: int, margin: int = MARGIN) -> DataFrame:
    """About ``margin * rows`` of ``total`` rows by a hash of doc_id, all if there are fewer. What a sorted limit then sends to the driver
    doesn't grow with the number of tasks."""
    return df.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(PARTS)) < min(PARTS, PARTS * margin * rows // max(total, 1) + 1))


def byte_cut(rows: DataFrame, size: Column, most: int = SAMPLE_BYTES) -> DataFrame:
    """The rows of each class (``_label``) that fit into ``most`` bytes together, in hash order of doc_id; ``rows`` is a bounded sample."""
    order = Window.partitionBy("_label").orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    fitting = rows.withColumn("_size", size).where(F.col("_size") <= most // 8)
    return fitting.withColumn("_total", F.sum("_size").over(order)).where(F.col("_total") <= most).drop("_size", "_total")


def balanced_ids(labels: DataFrame, column: str, rows_per_class: int, max_classes: int = 1000) -> DataFrame:
    """At most so many ids of each class, in hash order: repeatable, and not following the ids. Of more than ``max_classes`` classes the
    commonest are learned."""
    labels = labels.where(f"doc_id is not null and `{column}` is not null")
    classes = labels.groupBy(column).count().orderBy(F.desc("count"), column).limit(max_classes).collect()
    out = labels.limit(0)
    for r in sorted(classes, key=lambda r: r[column]):
        own = hash_cut(labels.where(F.col(column) == r[column]), rows_per_class, r["count"]).dropDuplicates(["doc_id"])
        out = out.unionByName(own.orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(rows_per_class))
    return out


def sparse_sample(docs: DataFrame, ids: DataFrame, column: str, bits: int, grams: tuple[int, ...], words: bool) -> list[tuple[object, np.ndarray, np.ndarray]]:
    """(label, buckets, counts) of the sampled documents' whole texts, as many as ``SAMPLE_BYTES`` allows. ``ids`` is bounded by its sample
    size, so it is broadcast."""
    chosen = docs.join(F.broadcast(ids.select("doc_id", F.col(column).alias("_label"))), "doc_id").select("doc_id", "_label", "text")
    rows = map_texts(chosen, lambda t: sparse(Texts(t), bits, grams, words), "idx binary, cnt binary")
    got = byte_cut(rows, F.octet_length("idx") + F.octet_length("cnt")).select("doc_id", "_label", "idx", "cnt").toArrow()
    # views of the batches that came, not copies: the sample is the largest thing a driver holds
    label, order = got.column("_label").to_pylist(), np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    view = lambda c, i, kind: np.frombuffer(got.column(c)[i].as_buffer(), kind)
    return [(label[i], view("idx", i, np.int32), view("cnt", i, np.float32)) for i in order.tolist()]
