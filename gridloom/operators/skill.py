"""Model skill: sufficient statistics of errors, pooled and grouped metrics, rankings, ensembles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def error_sums(df: DataFrame, keys: list[str], y: str = "y", yhat: str = "yhat") -> DataFrame:
    """n_points, ss_res, sum_abs_err, sum_true, sum_true_sq over rows where both are known; sums of them merge."""
    d = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull())
    e = F.col(y) - F.col(yhat)
    return d.groupBy(*keys).agg(F.count("*").alias("n_points"), F.sum(e * e).alias("ss_res"), F.sum(F.abs(e)).alias("sum_abs_err"), F.sum(y).alias("sum_true"), F.sum(F.col(y) * F.col(y)).alias("sum_true_sq"))


def pooled(sums: DataFrame, keys: list[str]) -> DataFrame:
    """r2, rmse, mae from error sums, merged over ``keys``; null where the truth doesn't vary."""
    s = sums.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("n_points", "ss_res", "sum_abs_err", "sum_true", "sum_true_sq")))
    total = F.col("sum_true_sq") - F.col("sum_true") * F.col("sum_true") / F.col("n_points")
    return s.select(*keys, "n_points", F.when(total > 1e-12, 1 - F.col("ss_res") / total).alias("r2"), F.sqrt(F.col("ss_res") / F.col("n_points")).alias("rmse"), (F.col("sum_abs_err") / F.col("n_points")).alias("mae"))


def by_group(df: DataFrame, keys: list[str], least: int = 10, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """n, r2, rmse, mae, bias and means of each group of at least ``least`` rows."""
    e = F.col(yhat) - F.col(y)
    g = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.var_pop(y).alias("var"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), F.avg(y).alias("mean_true"), F.avg(yhat).alias("mean_pred"))
    return g.where(F.col("n") >= least).select(*keys, "n", F.when(F.col("var") > 0, 1 - F.col("mse") / F.col("var")).alias("r2"), F.sqrt("mse").alias("rmse"), "mae", "bias", "mean_true", "mean_pred")


def efficiency(df: DataFrame, keys: list[str], y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Kling-Gupta efficiency with its parts r, alpha, beta, Nash-Sutcliffe efficiency and mean absolute error."""
    e = F.col(yhat) - F.col(y)
    g = df.groupBy(*keys).agg(F.corr(y, yhat).alias("r"), (F.stddev_pop(yhat) / F.stddev_pop(y)).alias("alpha"), (F.avg(yhat) / F.avg(y)).alias("beta"), (1 - F.avg(e * e) / F.var_pop(y)).alias("nse"), F.avg(F.abs(e)).alias("mae"))
    return g.withColumn("kge", 1 - F.sqrt(F.pow(F.col("r") - 1, 2) + F.pow(F.col("alpha") - 1, 2) + F.pow(F.col("beta") - 1, 2)))


def rank_methods(df: DataFrame, keys: list[str], name: str, score: str, top: int = 5) -> DataFrame:
    """The ``top`` names of each key by falling score, ties by name."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), name)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def reliability_threshold(df: DataFrame, keys: list[str], size: str, score: str, least: float) -> DataFrame:
    """Smallest size whose best score falls below ``least`` (null if none does)."""
    best = df.groupBy(*keys, size).agg(F.max(score).alias("best"))
    return best.groupBy(*keys).agg(F.min(F.when(F.col("best") < least, F.col(size))).alias("threshold"))


def select_method(scores: DataFrame, keys: list[str], name: str, size: str, score: str, least: float, cap: int) -> DataFrame:
    """Per key the method that reaches the largest size (up to ``cap``) with a score of at least ``least``; ties take the first name."""
    ok = scores.where((F.col(score) >= least) & (F.col(size) <= cap)).groupBy(*keys, name).agg(F.max(size).alias("max_size"))
    w = Window.partitionBy(*keys).orderBy(F.desc("max_size"), name)
    return ok.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def median_of(columns: list[str]) -> Column:
    """Median over the columns that are not null."""
    known = F.array_sort(F.array_compact(F.array(*columns)))
    n = F.size(known)
    return F.when(n > 0, (F.element_at(known, F.floor((n + 1) / 2).cast("int")) + F.element_at(known, F.floor(n / 2 + 1).cast("int"))) / 2)


def ks_statistic(df: DataFrame, keys: list[str], value: str, side: Column) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance between rows with ``side`` and those without, with the shift of mean and deviation."""
    d = df.withColumn("_s", side).groupBy(*keys, value).agg(F.count_if("_s").alias("a"), F.count_if(~F.col("_s")).alias("b"))
    run = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*keys)
    gap = F.abs(F.sum("a").over(run) / F.sum("a").over(all_) - F.sum("b").over(run) / F.sum("b").over(all_))
    ks = d.withColumn("_g", gap).groupBy(*keys).agg(F.max("_g").alias("ks"))
    mean = df.withColumn("_s", side).groupBy(*keys).agg((F.avg(F.when(F.col("_s"), F.col(value))) - F.avg(F.when(~F.col("_s"), F.col(value)))).alias("mean_shift"),
                                                     (F.stddev_samp(F.when(F.col("_s"), F.col(value))) - F.stddev_samp(F.when(~F.col("_s"), F.col(value)))).alias("std_shift"))
    return ks.join(mean, keys)
