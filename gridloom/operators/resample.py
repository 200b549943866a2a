"""Resampling and reshaping of series; time is a whole number of steps (hours, days) unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of series that a task sorts, about.
ROWS_A_TASK = 1_000_000

RULES = {
    "mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count,
    "first": None,
}


def bins(df: DataFrame, keys: list[str], time: str, every: int) -> DataFrame:
    """Every bin between the first and the last of each key; an empty table gives none."""
    start = F.col("_lo") - F.pmod(F.col("_lo"), F.lit(every))
    return df.groupBy(*keys).agg(F.min(time).alias("_lo"), F.max(time).alias("_hi")).select(*keys, F.explode(F.sequence(start, F.col("_hi"), F.lit(every).cast("long"))).alias(time))


def aggregates(time: str, rules: dict[str, tuple[str, str]]) -> list[Column]:
    """Aggregate columns of {name: (rule, column)}; ``first`` is the first value that is not null in time order."""
    out = []
    for name, (rule, column) in rules.items():
        if rule == "first":
            c = F.min_by(F.col(column), F.when(F.col(column).isNotNull(), F.col(time)))
        else:
            c = RULES[rule](column)
        out.append(c.alias(name))
    return out


def dealt(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """``df`` dealt out by its keys into partitions that will hold some ``ROWS_A_TASK`` of the ``rows`` it is to grow to: what is sorted in a task
    doesn't grow with the table, however few bytes are shuffled before rows are made of them."""
    if not keys:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(int(max(1, -(-rows // ROWS_A_TASK), min(cores, -(-rows // 20_000)))), *keys)


def calendar(df: DataFrame, keys: list[str], time: str, every: int, rules: dict[str, tuple[str, str]]) -> DataFrame:
    """Resample to bins of ``every`` steps and emit every bin: empty bins have sum 0 and count 0, other rules null (all bins of a null key are empty).

    The bins that hold rows are shuffled by key; the empty ones up to the next are made after that, where they are used."""
    df = df.where(F.col(time).isNotNull())
    ends = df.groupBy(*keys).agg(((F.max(time) - F.min(time)) / every + 2).alias("n"))
    rows = int(ends.agg(F.sum("n")).first()[0] or 0)
    bucket = (F.col(time) - F.pmod(F.col(time), F.lit(every))).cast("long").alias(time)
    agg = dealt(df.groupBy(*keys, bucket).agg(*aggregates(time, rules)), keys, rows)
    following = F.lead(time).over(Window.partitionBy(*keys).orderBy(time))
    bins_ = F.sequence(F.col(time), F.coalesce(F.col("_next") - every, F.col(time)), F.lit(every).cast("long"))
    full = agg.withColumn("_next", following).withColumn("_bin", F.explode(bins_))
    own = F.col("_bin") == F.col(time)
    for k in keys:
        own = own & F.col(k).isNotNull()
    out = full.select(*keys, F.col("_bin").alias(time), *(F.when(own, F.col(n)).alias(n) for n in rules))
    zero = [n for n, (rule, _) in rules.items() if rule in ("sum", "count")]
    return out.fillna(0, zero) if zero else out


def accumulate(df: DataFrame, keys: list[str], time: str, every: int, value: str) -> DataFrame:
    """Sub-step amounts summed to bins; null where a bin has no value at all (a minimum count of one)."""
    bucket = (F.col(time) - F.pmod(F.col(time), F.lit(every))).alias(time)
    return df.groupBy(*keys, bucket).agg(F.sum(value).alias(value))


def multi_statistics(df: DataFrame, keys: list[str], time: str, every: int, numeric: list[str], static: list[str]) -> DataFrame:
    """Mean (bare name), min, max and sum of numeric columns, first of static ones, for every bin."""
    rules = {}
    for c in numeric:
        rules |= {c: ("mean", c), f"{c}_min": ("min", c), f"{c}_max": ("max", c), f"{c}_sum": ("sum", c)}
    return calendar(df, keys, time, every, rules | {c: ("first", c) for c in static})


def means_with_suffix(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Mean of each column as ``<name>_mean``, but the sum of precipitation-like ones as ``<name>_sum``."""
    return df.groupBy(*keys).agg(*(F.sum(c).alias(f"{c}_sum") if "precip" in c else F.avg(c).alias(f"{c}_mean") for c in columns))


def to_wide(df: DataFrame, keys: list[str], sensor: str, value: str, sensors: list[str]) -> DataFrame:
    """One column a sensor; values that meet in a cell are averaged. The sensors are listed, so no extra pass finds them."""
    return df.groupBy(*keys).pivot(sensor, sensors).agg(F.avg(value))


def to_long(df: DataFrame, keys: list[str], sensors: list[str], name: str = "sensor", value: str = "value") -> DataFrame:
    """One row a sensor and key, nulls dropped."""
    return df.unpivot(keys, sensors, name, value).where(F.col(value).isNotNull())


def collapse(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows of equal keys averaged (repeated timestamps, or columns that stand for one plant)."""
    return df.groupBy(*keys).agg(F.avg(value).alias(value))


def site_mean(df: DataFrame, keys: list[str], value: str, sensors: int | Column, valid_share: float = 0.0) -> DataFrame:
    """Mean over sensors; null where fewer than ``max(1, floor(share * sensors))`` are valid."""
    enough = F.greatest(F.lit(1), F.floor(F.lit(valid_share) * sensors))
    return df.groupBy(*keys).agg(F.when(F.count(value) >= (F.max(enough) if isinstance(sensors, Column) else enough), F.avg(value)).alias(value))


def spread_year(df: DataFrame, keys: list[str], first: str, last: str, value: str, time: str) -> DataFrame:
    """A value that holds from ``first`` to ``last`` (inclusive) as one row a step."""
    return df.select(*keys, F.explode(F.sequence(first, last)).alias(time), value)


def composites_to_daily(df: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    """Values of several days apart, linearly interpolated in time to every day between the first and the last; days before the first known value
    and after the last one are null. ``day`` doesn't repeat in a series.

    Only the rows given are sorted: each known row makes the days up to the next."""
    df = df.select(*keys, F.col(day).cast("long").alias(day), value).where(F.col(day).isNotNull())
    df = dealt(df, keys, df.count())
    w = Window.partitionBy(*keys)
    at, known = F.col(day), F.col(value).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    # the rows with a value, and of the others those that are the first or last of their series
    ends = df.withColumn("_known", known).withColumn("_lo", F.min(day).over(w)).withColumn("_hi", F.max(day).over(w)).where(F.col("_known") | (at == F.col("_lo")) | (at == F.col("_hi")))
    ordered = w.orderBy(day)
    step = ends.select(*keys, day, F.when(F.col("_known"), F.col(value)).alias("_pv"), F.lead(day).over(ordered).alias("_nt"), F.lead(F.when(F.col("_known"), F.col(value))).over(ordered).alias("_nv"))
    full = step.withColumn("_at", F.explode(F.sequence(at, F.coalesce(F.col("_nt") - 1, at), F.lit(1).cast("long"))))
    line = F.when(F.col("_at") == at, F.col("_pv")).otherwise(F.col("_pv") + (F.col("_nv") - F.col("_pv")) * (F.col("_at") - at) / (F.col("_nt") - at))
    return full.select(*keys, F.col("_at").alias(day), line.alias(value))
