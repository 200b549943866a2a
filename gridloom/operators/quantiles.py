"""Exact quantiles of groups of any size: a histogram pass, then only the buckets that hold the wanted ranks.

Edges of about equal counts come from Spark's bounded quantile sketch. One pass counts each group's values between and on the edges, which
shows where its wanted ranks fall; only the rows of those buckets go on, and a bucket with many distinct values is cut again in the same
way. No task holds a group's values: what meets is counts, ``LIMIT`` of a bucket at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.sources.shared import kept

from .ranks import join_same

#: Values of a group that may meet in one task; larger groups take the histograms.
ONE_TASK = 2_000_000
#: Buckets of a histogram, and distinct values of a bucket at which they are counted one by one.
BUCKETS, LIMIT = 256, 20_000


def fits(df: DataFrame, keys: list[str] | None = None) -> bool:
    """Whether no group has more rows than ``ONE_TASK``."""
    counts = df.groupBy(*keys).count() if keys else df.agg(F.count("*").alias("count"))
    return (counts.agg(F.max("count")).first()[0] or 0) <= ONE_TASK


def _between(v: Column, lo: Column, hi: Column) -> Column:
    return (lo.isNull() | (v > lo)) & (hi.isNull() | (v < hi))


def exact_quantiles(df: DataFrame, value: str, probs: list[float], keys: list[str] | None = None) -> DataFrame:
    """keys, n and ``quantiles``: for each group the values at probs * (n - 1) in order, linear between neighbours, as Spark's ``percentile`` gives
    them. Null and not-a-number don't count; a group without values has null quantiles. Without keys one row for the whole table, an empty
    one too."""
    names = keys or []
    own = [f"_g{i}" for i in range(len(names))] or ["_g0"]
    group = [F.col(k).alias(g) for k, g in zip(names, own)] or [F.lit(0).alias("_g0")]
    rows = df.select(*group, F.col(value).cast("double").alias("_v")).withColumn("_v", F.when(~F.isnan("_v"), F.col("_v")))
    counted = rows.groupBy(*own).agg(F.count("_v").alias("n")) if names else rows.agg(F.count("_v").alias("n")).select(F.lit(0).alias("_g0"), "n")
    counted = kept(counted, "groups")
    rows = rows.where("_v is not null")
    place = [F.lit(float(p)) * (F.col("n") - 1) for p in probs]
    both = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(x).cast("long"), F.ceil(x).cast("long")) for x in place))))
    none = F.lit(None).cast("double")
    # each wanted rank with the open interval it lies in and its rank among the values there
    wanted = kept(counted.where("n > 0").select(*own, F.explode(both).alias("_rank")).select("*", none.alias("_lo"), none.alias("_hi"), F.col("_rank").alias("_inner")), "ranks")
    at, found = [*own, "_lo", "_hi"], None
    while not wanted.isEmpty():
        spans = wanted.select(*at).distinct()
        inside = join_same(rows, spans.groupBy(*own).agg(F.collect_list(F.struct("_lo", "_hi")).alias("_spans")), own)
        inside = inside.withColumn("_span", F.filter("_spans", lambda s: _between(F.col("_v"), s["_lo"], s["_hi"]))).where(F.size("_span") > 0)
        inside = inside.select(*own, "_v", F.col("_span")[0]["_lo"].alias("_lo"), F.col("_span")[0]["_hi"].alias("_hi"))
        sketch = F.percentile_approx("_v", [i / BUCKETS for i in range(1, BUCKETS)], F.lit(20 * BUCKETS))
        edges = kept(inside.groupBy(*at).agg(F.approx_count_distinct("_v").alias("_d"), F.array_distinct(sketch).alias("_edges")).withColumn("_edges", F.when(F.col("_d") > LIMIT, F.col("_edges"))).drop("_d"), "edges")
        below = F.aggregate("_edges", F.lit(0), lambda a, e: a + F.when(e < F.col("_v"), 1).otherwise(0))
        cells = join_same(inside, edges, at).withColumn("_below", below).withColumn("_x", F.when(F.col("_edges").isNull() | F.array_contains("_edges", F.col("_v")), F.col("_v")))
        # the place of a bucket: between two edges, or on the value itself
        cells = cells.groupBy(*at, "_below", "_x").agg(F.count("*").alias("_c"), F.min("_v").alias("_first"))
        cells = cells.withColumn("_to", F.sum("_c").over(Window.partitionBy(*at).orderBy("_first")))
        cells = join_same(kept(cells, "cells"), edges, at)
        # few cells a group are wanted, so the ranks travel to the cells
        asked = wanted.groupBy(*at).agg(F.collect_list(F.struct("_rank", "_inner")).alias("_asked"))
        hit = join_same(cells, asked, at).withColumn("_one", F.explode(F.filter("_asked", lambda q: (q["_inner"] < F.col("_to")) & (q["_inner"] >= F.col("_to") - F.col("_c")))))
        hit = kept(hit.select(*at, "_below", "_x", "_edges", F.col("_one._rank").alias("_rank"), (F.col("_one._inner") - F.col("_to") + F.col("_c")).alias("_inner")), "hits")
        done = hit.where("_x is not null").select(*own, "_rank", "_x")
        found = done if found is None else found.unionByName(done)
        edge = lambda i: F.try_element_at("_edges", i.cast("int"))
        lo = F.when(F.col("_below") > 0, edge(F.greatest(F.col("_below"), F.lit(1))))
        wanted = hit.where("_x is null").select(*own, "_rank", F.coalesce(lo, F.col("_lo")).alias("_lo"), F.coalesce(edge(F.col("_below") + 1), F.col("_hi")).alias("_hi"), "_inner")
    if found is None:
        found = wanted.select(*own, "_rank", F.col("_lo").alias("_x"))
    values = found.groupBy(*own).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_x"))).alias("_at"))
    joined = counted.join(values.withColumnsRenamed({g: f"_r{g}" for g in own}), on=_all_same(own), how="left")
    take = lambda r: F.try_element_at("_at", r.cast("long"))
    at_p = [F.when(F.floor(x) == F.ceil(x), take(F.floor(x))).otherwise((F.ceil(x) - x) * take(F.floor(x)) + (x - F.floor(x)) * take(F.ceil(x))) for x in place]
    return joined.select(*(F.col(g).alias(k) for k, g in zip(names, own)), "n", F.when(F.col("n") > 0, F.array(*at_p)).alias("quantiles"))


def _all_same(own: list[str]) -> Column:
    match = None
    for g in own:
        one = F.col(g).eqNullSafe(F.col(f"_r{g}"))
        match = one if match is None else match & one
    return match
