"""Summary statistics of sites, sensors and variables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import quantiles
from .ranks import join_same


def describe(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Counts, missing share, moments, quantiles, zeros, negatives and values beyond three deviations; skew and kurtosis are the biased forms.
    Quantiles of a table with a group too large for one task come from histograms (``quantiles.exact_quantiles``)."""
    v, probs = F.col(value), (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
    apart = not quantiles.fits(df, keys)
    q = F.lit(None) if apart else F.expr(f"percentile(`{value}`, array{probs})")
    g = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count(v).alias("n_valid"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.var_samp(v).alias("var"), F.min(v).alias("min"), F.max(v).alias("max"),
        q.alias("_q"), F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurtosis"), F.count_if(v == 0).alias("n_zero"), F.count_if(v < 0).alias("n_negative"))
    if apart:
        g = join_same(g.drop("_q"), quantiles.exact_quantiles(df, value, list(probs), keys).select(*keys, F.col("quantiles").alias("_q")), keys)
    names = ("p01", "p05", "p25", "median", "p75", "p95", "p99")
    out = g.select(*[c for c in g.columns if c != "_q"], *(F.col("_q")[i].alias(n) for i, n in enumerate(names)))
    return out.withColumn("missing_pct", 100 * (F.col("n") - F.col("n_valid")) / F.col("n")).withColumn("cv", F.col("std") / F.col("mean")).withColumn("iqr", F.col("p75") - F.col("p25")).withColumn("range", F.col("max") - F.col("min"))


def site_years(df: DataFrame, keys: list[str], time: str, max_step: int, per_year: float) -> DataFrame:
    """Sum of the steps up to ``max_step`` as years, and its share of the whole span."""
    d = F.col(time) - F.lag(time).over(Window.partitionBy(*keys).orderBy(time))
    g = df.withColumn("_d", d).groupBy(*keys).agg(F.sum(F.when(F.col("_d") <= max_step, F.col("_d"))).alias("_s"), (F.max(time) - F.min(time)).alias("_w"))
    return g.select(*keys, (F.coalesce("_s", F.lit(0)) / per_year).alias("site_years"), F.when(F.col("_w") > 0, 100 * F.coalesce("_s", F.lit(0)) / F.col("_w")).alias("coverage_pct"))


def mode(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Most frequent value of each key and its share; ties take the smallest."""
    c = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    r = F.row_number().over(w.orderBy(F.desc("n"), value))
    return c.select(*keys, F.col(value).alias("mode"), r.alias("_r"), (F.col("n") / F.sum("n").over(w)).alias("share")).where("_r = 1").drop("_r")


def min_max_scale(df: DataFrame, columns: list[str], digits: int = 3) -> DataFrame:
    """Every column scaled to 0..1 over the whole table and rounded; a constant column becomes null. The bounds are one row, broadcast."""
    bounds = df.agg(*(f(c).alias(f"_{k}_{c}") for c in columns for k, f in (("lo", F.min), ("hi", F.max))))
    out = df.crossJoin(F.broadcast(bounds))
    for c in columns:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        out = out.withColumn(c, F.when(hi > lo, F.round((F.col(c) - lo) / (hi - lo), digits)))
    return out.select(*df.columns)


def daily_completeness(df: DataFrame, keys: list[str], value: str, daytime: Column, least: float) -> DataFrame:
    """Valid and expected daytime points a day, and whether the day is kept."""
    g = df.groupBy(*keys).agg(F.count_if(daytime & F.col(value).isNotNull()).alias("valid"), F.count_if(daytime).alias("expected"))
    return g.withColumn("kept", F.coalesce(F.col("valid") / F.when(F.col("expected") > 0, F.col("expected")) >= least, F.lit(False)))


def reversed_days(df: DataFrame, keys: list[str], value: str, is_day: Column) -> DataFrame:
    """Days whose signal is higher at night: 0.8 mean day < mean night - 0.5 (three values each), or over 30 % of the values from the 85 %
    quantile up at night (ten values)."""
    v = F.col(value)
    w = Window.partitionBy(*keys)
    d = df.withColumn("_day", is_day).withColumn("_q", F.expr(f"percentile(`{value}`, 0.85)").over(w))
    g = d.groupBy(*keys).agg(F.avg(F.when(F.col("_day"), v)).alias("mean_day"), F.avg(F.when(~F.col("_day"), v)).alias("mean_night"), F.count(F.when(F.col("_day"), v)).alias("nd"), F.count(F.when(~F.col("_day"), v)).alias("nn"),
                             F.count_if(v >= F.col("_q")).alias("top"), F.count_if((v >= F.col("_q")) & ~F.col("_day")).alias("top_night"))
    low = (F.col("nd") >= 3) & (F.col("nn") >= 3) & (0.8 * F.col("mean_day") < F.col("mean_night") - 0.5)
    peaks = (F.col("nd") + F.col("nn") >= 10) & (F.col("top_night") / F.col("top") > 0.3)
    return g.select(*keys, "mean_day", "mean_night", F.coalesce(low | peaks, F.lit(False)).alias("reversed"))


def agreement(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """r, r2, bias, rmse, mae and n of two columns, and whether r2 reaches 0.5."""
    e = F.col(b) - F.col(a)
    g = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.corr(a, b).alias("r"), F.avg(e).alias("bias"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))
    return g.withColumn("r2", F.col("r") * F.col("r")).withColumn("good", F.coalesce(F.col("r2") >= 0.5, F.lit(False)))


def diurnal_lookup(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean of the values other than 0, or 0 where there are none."""
    return df.groupBy(*keys).agg(F.coalesce(F.avg(F.when(F.col(value) != 0, F.col(value))), F.lit(0.0)).alias("lookup"))


def histogram(df: DataFrame, keys: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts of ``bins`` equal bins; bin 0 lies below, bin ``bins`` + 1 from ``high`` on."""
    b = F.when(F.col(value) < low, 0).when(F.col(value) >= high, bins + 1).otherwise(F.floor((F.col(value) - low) / ((high - low) / bins)) + 1)
    return df.where(F.col(value).isNotNull()).groupBy(*keys, b.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def weighted_profile(df: DataFrame, keys: list[str], weight: str, gate: str, values: list[str]) -> DataFrame:
    """Weighted means over layers; a layer counts where ``gate`` is known, and its other missing values count as 0."""
    w = F.when(F.col(gate).isNotNull(), F.col(weight))
    return df.groupBy(*keys).agg(*((F.sum(F.coalesce(F.col(v), F.lit(0.0)) * w) / F.sum(w)).alias(v) for v in values))
