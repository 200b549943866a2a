"""Connected components of a link table by alternating large-star and small-star steps, entirely as shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keep


def _star(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (hi, lo) with hi > lo."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
    low = large.groupBy("hi").agg(F.min("lo").alias("m"))
    pairs = large.join(low, "hi")
    small = pairs.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(low.select("hi", F.col("m").alias("lo")))
    return small.distinct()


def components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a, b), component being the smallest node reachable.

    Rows with a null or with a = b are ignored; repeated links count once. An empty table gives an empty result.
    Each round is written to the shared folder; the rounds end when a round changes nothing.
    """
    edges = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    edges, seen = keep(edges, "links"), None
    for _ in range(max_rounds):
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if state == seen or state[0] == 0:
            break
        seen, before, edges = state, edges, keep(_star(edges), "links")
        discard(before)
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)
