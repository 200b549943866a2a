"""Gridded products: per-cell statistics over time, comparison of products, binning, composites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = ["lat", "lon"]


def z_score(df: DataFrame, keys: list[str], value: str, least: int = 30, out: str = "z") -> DataFrame:
    """Standard score over time by population deviation; null under ``least`` values or where the deviation is next to nothing."""
    w = Window.partitionBy(*keys)
    s = F.stddev_pop(value).over(w)
    return df.withColumn(out, F.when((F.count(value).over(w) >= least) & (s > 1e-10), (F.col(value) - F.avg(value).over(w)) / s))


def anomaly(df: DataFrame, keys: list[str], month: str, value: str) -> DataFrame:
    """Adds the climatology of the month and the deviation from it."""
    return df.withColumn("climatology", F.avg(value).over(Window.partitionBy(*keys, month))).withColumn("anomaly", F.col(value) - F.col("climatology"))


def amplitude(df: DataFrame, keys: list[str], value: str, out: str = "scaled") -> DataFrame:
    """Scaled to 0..1 within a key; null where it doesn't vary."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn(out, F.when(hi > lo, (F.col(value) - lo) / (hi - lo)))


def pair_products(df: DataFrame, reference: str, value: str, keys: list[str]) -> DataFrame:
    """Each other product next to the reference at the same place and time: product, keys, a (product), b (reference)."""
    ref = df.where(F.col("product") == reference).select(*keys, F.col(value).alias("b"))
    return df.where(F.col("product") != reference).select("product", *keys, F.col(value).alias("a")).join(ref, keys)


def cell_correlation(df: DataFrame, reference: str, value: str, time: str, least: int, keys: list[str] = CELL) -> DataFrame:
    """Per product and cell: r with the reference, each variable's mean and deviation over its own times and the product over common ones."""
    w = Window.partitionBy("product", *keys)
    own = df.withColumn("_m", F.avg(value).over(w)).withColumn("_s", F.stddev_pop(value).over(w)).withColumn("_d", F.col(value) - F.col("_m"))
    ref = own.where(F.col("product") == reference).select(*keys, time, F.col("_d").alias("_rd"), F.col("_s").alias("_rs"))
    both = own.where(F.col("product") != reference).join(ref, [*keys, time])
    return both.groupBy("product", *keys).agg(F.count("*").alias("n"), (F.avg(F.col("_d") * F.col("_rd")) / F.when(F.first("_s") * F.first("_rs") > 1e-12, F.first("_s") * F.first("_rs"))).alias("_r")).select("product", *keys, "n", F.when(F.col("n") >= least, F.col("_r")).alias("r"))


def consensus(corr: DataFrame, keys: list[str] = CELL) -> DataFrame:
    """Mean and deviation of r over products, how many exceed 0.5, and a zone: 3 from 75 %, 2 from 50 %, else 1."""
    g = corr.where("r is not null").groupBy(*keys).agg(F.avg("r").alias("mean_r"), F.stddev_pop("r").alias("std_r"), F.count_if(F.col("r") > 0.5).alias("n_high"), F.count("*").alias("n"))
    share = F.col("n_high") / F.col("n")
    return g.withColumn("zone", F.when(share >= 0.75, 3).when(share >= 0.5, 2).otherwise(1))


def trend(df: DataFrame, keys: list[str], year: str, value: str) -> DataFrame:
    """Least-squares slope of annual means on the year's index within the table; missing years are skipped in the numerator only."""
    annual = df.groupBy(*keys, year).agg(F.avg(value).alias("v"))
    span = df.agg(F.min(year).alias("y0"), F.max(year).alias("y1"))
    a = annual.join(F.broadcast(span)).withColumn("n", F.col("y1") - F.col("y0") + 1).withColumn("x", F.col(year) - F.col("y0"))
    dx = F.col("x") - (F.col("n") - 1) / 2
    mean = F.avg("v").over(Window.partitionBy(*keys))
    return a.withColumn("_t", dx * (F.col("v") - mean)).groupBy(*keys).agg((F.sum("_t") / F.first(F.col("n") * (F.col("n") * F.col("n") - 1) / 12)).alias("slope"))


def sign_agreement(slopes: DataFrame, keys: list[str] = CELL) -> DataFrame:
    """Share of the products that have the commoner sign."""
    g = slopes.groupBy(*keys).agg(F.count_if(F.col("slope") > 0).alias("p"), F.count_if(F.col("slope") < 0).alias("m"), F.count("slope").alias("n"))
    return g.where("n > 0").select(*keys, (F.greatest("p", "m") / F.col("n")).alias("agreement"))


def triple_collocation(df: DataFrame, a: str, b: str, c: str) -> DataFrame:
    """Error variances of three columns (over common rows, floored at 0) and inverse-variance weights, equal where none is positive."""
    cov = lambda x, y: F.covar_pop(x, y)
    m = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(c).isNotNull()).agg(
        F.count("*").alias("n"), F.var_pop(a).alias("aa"), F.var_pop(b).alias("bb"), F.var_pop(c).alias("cc"), cov(a, b).alias("ab"), cov(a, c).alias("ac"), cov(b, c).alias("bc"))
    e = m.select("n", *(F.greatest(F.col(v) - F.col(p) * F.col(q) / F.col(r), F.lit(0.0)).alias(f"err_{k}") for k, v, p, q, r in (("a", "aa", "ab", "ac", "bc"), ("b", "bb", "ab", "bc", "ac"), ("c", "cc", "ac", "bc", "ab"))))
    inv = [F.when(F.col(f"err_{k}") > 1e-12, 1 / F.col(f"err_{k}")).otherwise(0.0) for k in "abc"]
    total = inv[0] + inv[1] + inv[2]
    return e.select("*", *(F.when(total > 0, i / total).otherwise(1 / 3).alias(f"weight_{k}") for k, i in zip("abc", inv)))


def bin_points(df: DataFrame, time: str, value: str, top: float, left: float, res: float) -> DataFrame:
    """Grid row and column of points, duplicates averaged: row from the north, an epsilon against points on a border."""
    row = F.floor((F.lit(top) - F.col("lat") + 1e-6) / res).cast("long")
    col = F.floor((F.col("lon") - left + 1e-6) / res).cast("long")
    return df.groupBy(time, row.alias("row"), col.alias("col")).agg(F.avg(value).alias(value))


def composites(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, exact median, min, max, sample deviation (null for one value) and count."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.median(value).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))


def dominant_class(columns: list[str]) -> Column:
    """Name of the largest column, the first on ties; null where all are null."""
    top = F.greatest(*columns)
    out = F.lit(None).cast("string")
    for c in reversed(columns):
        out = F.when(F.col(c) == top, c).otherwise(out)
    return out


def coarsen(df: DataFrame, keys: list[str], value: str, res: float) -> DataFrame:
    """Mean over target cells of spacing ``res``, weighted by the cosine of latitude (the area of a cell)."""
    w = F.cos(F.radians("lat"))
    cell = lambda c: (F.floor(F.col(c) / res) * res).alias(c)
    return df.groupBy(*keys, cell("lat"), cell("lon")).agg((F.sum(F.col(value) * w) / F.sum(w)).alias(value))


def regions(df: DataFrame, boxes: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, count per named box (name, lat0, lat1, lon0, lon1); boxes are few and broadcast."""
    hit = (F.col("lat") >= F.col("lat0")) & (F.col("lat") <= F.col("lat1")) & (F.col("lon") >= F.col("lon0")) & (F.col("lon") <= F.col("lon1"))
    return df.join(F.broadcast(boxes), hit).groupBy("name", *keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
