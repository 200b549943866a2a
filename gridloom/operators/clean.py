"""Projections, filters and predicates of cleaning: casts, flags, removals, labels, units, masks, validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import small


def number(c: str) -> Column:
    """Text to double; what isn't a number becomes null, and so does NaN."""
    v = F.expr(f"try_cast(`{c}` as double)")
    return F.when(~F.isnan(v), v)


def first_of_duplicates(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def duplicate_report(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand more than once, and how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def flag_mask(value: str, warned: Column, non_negative: bool = False) -> Column:
    """Negative values become null (or 0 for variables that can't be negative), values with a warning flag null."""
    base = F.when(F.col(value) < 0, F.lit(0.0) if non_negative else F.lit(None)).otherwise(F.col(value))
    return F.when(~F.coalesce(warned, F.lit(False)), base)


def removal_periods(log: DataFrame) -> DataFrame:
    """One row per period of a removal log whose start_time and end_time are ``;``-lists, zipped to the shorter one; rows whose start lies
    after the end or does not parse are invalid and go."""
    zipped = log.withColumn("_p", F.explode(F.arrays_zip(F.split("start_time", ";").alias("s"), F.split("end_time", ";").alias("e"))))
    parsed = zipped.withColumn("period_start", F.expr("try_to_timestamp(trim(_p.s))")).withColumn("period_end", F.expr("try_to_timestamp(trim(_p.e))"))
    return parsed.where("period_start is not null and period_end is not null and period_start <= period_end").drop("_p")


def apply_removals(df: DataFrame, rules: DataFrame, value: str) -> DataFrame:
    """``value`` nulled where a rule (site, sensor or null for all, start, end) holds; ``removed`` tells where a value went."""
    spans = rules.groupBy("site").agg(F.collect_list(F.struct("sensor", "start", "end")).alias("_rules"))
    hit = F.exists("_rules", lambda r: (r.sensor.isNull() | (r.sensor == F.col("sensor"))) & (F.col("t") >= r.start) & (F.col("t") <= r.end))
    out = df.join(small(spans), "site", "left").withColumn("_hit", F.coalesce(hit, F.lit(False)))
    return out.withColumn("removed", F.col("_hit") & F.col(value).isNotNull()).withColumn(value, F.when(~F.col("_hit"), F.col(value))).drop("_hit", "_rules")


# Words in treatment labels (fixed values).
CONTROL = ("control", "ambient", "pre irrigat", "untreated", "reference")
SAMPLING = ("core", "sampl")
DROP = ("drought", "irrig", "thin", "fertil", "elevated", "girdl", "exclusion", "burn")


def label_class(label: Column, control: tuple[str, ...] = CONTROL, sampling: tuple[str, ...] = SAMPLING, drop: tuple[str, ...] = DROP) -> Column:
    """control before sampling before drop before keep, by substrings; a null label is kept."""
    low = F.lower(F.trim(label))
    has = lambda words: reduce(lambda a, b: a | b, (low.contains(w) for w in words))
    return F.when(label.isNull(), "keep").when(has(control), "control").when(has(sampling), "sampling").when(has(drop), "drop").otherwise("keep")


def method_factor(method: Column, calibrated: Column) -> Column:
    """Correction of uncalibrated heat-dissipation readings: e^0.519 for HD, e^0.493 for CHD, else 1."""
    return F.when(F.coalesce(F.lower(calibrated) == "true", F.lit(False)), 1.0).when(method == "HD", F.exp(F.lit(0.519))).when(method == "CHD", F.exp(F.lit(0.493))).otherwise(1.0)


def per_area(value: Column, area: Column) -> Column:
    """Flow per area where the area is positive, else null."""
    return F.when(area > 0, value / area)


def all_near_zero(columns: list[str], threshold: float = 1e-10, every: bool = True) -> Column:
    """Whether all (or any) of the columns lie within ``threshold`` of 0."""
    parts = [F.coalesce(F.abs(F.col(c)) <= threshold, F.lit(False)) for c in columns]
    return reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), parts)


def pass_counts(df: DataFrame, rules: dict[str, Column], keys: list[str]) -> DataFrame:
    """Rows and rows that pass each rule, in one pass."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *(F.count_if(c).alias(n) for n, c in rules.items()))


def finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """Infinite values become null, then rows with any null among ``columns`` go."""
    for c in columns:
        df = df.withColumn(c, F.when(F.abs(F.col(c)) != float("inf"), F.col(c)))
    return df.dropna("any", subset=columns)


def hash_sample(df: DataFrame, keys: list[str], n: int, seed: int) -> DataFrame:
    """A repeatable sample of ``n`` rows: the smallest hashes of key and seed."""
    return df.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(n)


def site_flags(df: DataFrame) -> DataFrame:
    """Reasons why a site's statistics look wrong, joined by ``;``, for tables with mean, max, zeros_pct, negatives_pct, skew, missing_pct."""
    w = Window.partitionBy()
    stats = df.agg(F.avg("mean").alias("_am"), F.stddev_samp("mean").alias("_as"))
    z = F.abs(F.col("mean") - F.col("_am")) / F.col("_as")
    del w
    rules = {"extreme_mean": z > 3, "zeros": F.col("zeros_pct") > 50, "negatives": F.col("negatives_pct") > 5, "skewed": F.abs(F.col("skew")) > 5, "peaks": F.col("max") / F.col("mean") > 20, "missing": F.col("missing_pct") > 50}
    reasons = F.array_compact(F.array(*(F.when(c, n) for n, c in rules.items())))
    return df.crossJoin(F.broadcast(stats)).withColumn("reasons", F.array_join(reasons, ";")).drop("_am", "_as")
