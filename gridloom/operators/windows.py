"""Window operators over series: rolling statistics, outliers, gaps, segments, lags, seasons."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks, sliding


def islands(df: DataFrame, keys: list[str], order: str, predicate: Column) -> DataFrame:
    """Add _island: a number that stays the same over maximal runs of equal ``predicate``."""
    w = Window.partitionBy(*keys).orderBy(order)
    change = F.when(F.lag(predicate).over(w).eqNullSafe(predicate), 0).otherwise(1)
    return df.withColumn("_c", change).withColumn("_island", F.sum("_c").over(w)).drop("_c")


def centred(df: DataFrame, keys: list[str], order: str, width: int, stats: dict[str, Callable[[object], Column]]) -> DataFrame:
    """Adaptive centred rolling: ``width`` rows, shifted inward at both ends; an even width takes one more row inside; a series no longer
    than the width uses all of it. ``stats`` maps a name to a function from a window to a column, such as ``lambda w: F.avg("v").over(w)``."""
    h = width // 2
    w = Window.partitionBy(*keys).orderBy(order)
    # the window of the first rows is what lies ahead of the first one, that of the last rows what lies behind the last: one sort does for all
    start, end = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, h)
    made = [c for name, f in stats.items() for c in (f(w.rowsBetween(0, width - 1)).alias(f"_f_{name}"), f(w.rowsBetween(-(width - 1), 0)).alias(f"_l_{name}"), f(w.rowsBetween(-h, h)).alias(f"_c_{name}"))]
    out = df.select("*", F.row_number().over(w).alias("_i"), F.count(F.lit(1)).over(w.rowsBetween(1, width)).alias("_ahead"), *made)
    head = (F.col("_i") + F.col("_ahead") <= width) | (F.col("_i") + h < width)
    tail = F.col("_ahead") < width - h - 1
    return out.select(*(c for c in df.columns if c not in stats), *(F.when(head, F.first(f"_f_{n}").over(start)).when(tail, F.last(f"_l_{n}").over(end)).otherwise(F.col(f"_c_{n}")).alias(n) for n in stats))


def outliers_by_month(df: DataFrame, keys: list[str], value: str, n_std: float, out: str = "outlier") -> DataFrame:
    """Farther from the mean of its group than ``n_std`` sample deviations; ``keys`` hold the series and the calendar month."""
    w = Window.partitionBy(*keys)
    return df.withColumn(out, F.coalesce(F.abs(F.col(value) - F.avg(value).over(w)) > n_std * F.stddev_samp(value).over(w), F.lit(False)))


def _far(value: str, mean: str, dev: str, keys: list[str], n_std: float) -> Column:
    """Farther from the mean than ``n_std`` deviations; a zero deviation is replaced by the series' mean one."""
    s = F.when(F.col(dev) == 0, F.avg(dev).over(Window.partitionBy(*keys))).otherwise(F.col(dev))
    return F.coalesce(F.abs(F.col(value) - F.col(mean)) > n_std * s, F.lit(False))


def outliers_rolling(df: DataFrame, keys: list[str], order: str, value: str, width: int, n_std: float, out: str = "outlier") -> DataFrame:
    """Farther from the adaptive centred mean than ``n_std`` population deviations; a zero deviation is replaced by the series' mean one."""
    df = centred(df, keys, order, width, {"_m": lambda w: F.avg(value).over(w), "_s": lambda w: F.stddev_pop(value).over(w)})
    return df.withColumn(out, _far(value, "_m", "_s", keys, n_std)).drop("_m", "_s")


def outliers_mad(df: DataFrame, keys: list[str], order: str, value: str, width: int, n_mad: float, out: str = "outlier", piece: int | None = None) -> DataFrame:
    """Farther from the adaptive centred median than ``n_mad`` times the window's median absolute deviation / 0.6745.

    An ordered window slides over pieces of the series (``ranks.over_pieces``), so a row costs about the logarithm of the width, and a long
    series spreads over many tasks. ``order`` doesn't repeat in a series.
    """

    def run(values: dict[str, np.ndarray], place: np.ndarray, lo: int, hi: int, n: int) -> dict[str, np.ndarray]:
        a, b = sliding.centred_bounds(place[lo:hi], n, width)
        med, dev = sliding.slide(values[value], a - place[0], b - place[0], [lambda w: w.quantile(0.5), sliding.Sorted.deviation])
        return {out: np.abs(values[value][lo:hi] - med) > n_mad * dev / 0.6745}

    return ranks.over_pieces(df, keys, order, [value], width, run, f"{out} boolean", piece)


def outliers_global_fallback(df: DataFrame, keys: list[str], order: str, value: str, width: int, n_std: float, out: str = "outlier") -> DataFrame:
    """Centred rolling mean and sample deviation where half the window is known, the series' own elsewhere."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(width // 2), width - width // 2 - 1)
    all_ = Window.partitionBy(*keys)
    ok = F.count(value).over(w) >= width // 2
    mean = F.coalesce(F.when(ok, F.avg(value).over(w)), F.avg(value).over(all_))
    dev = F.coalesce(F.when(ok, F.stddev_samp(value).over(w)), F.stddev_samp(value).over(all_))
    return df.withColumn(out, F.coalesce(F.abs(F.col(value) - mean) > n_std * dev, F.lit(False)))


def day_night_outliers(df: DataFrame, keys: list[str], order: str, value: str, is_day: Column, width: int, day_std: float, night_std: float, out: str = "outlier") -> DataFrame:
    """Day and night values are judged apart, each against the series with the other half missing."""
    df = df.withColumn("_day", F.when(is_day, F.col(value))).withColumn("_night", F.when(~is_day, F.col(value)))
    stats = {f"_{n}{half}": (lambda w, f=f, half=half: f(half).over(w)) for half in ("_day", "_night") for n, f in (("m", F.avg), ("s", F.stddev_pop))}
    df = centred(df, keys, order, width, stats)
    far = _far("_day", "_m_day", "_s_day", keys, day_std) | _far("_night", "_m_night", "_s_night", keys, night_std)
    return df.withColumn(out, far).drop("_day", "_night", *stats)


def _mean_and_deviation(values: Column) -> Column:
    """Mean m and population deviation s of an array without nulls. Values are taken one by one, as DuckDB's windows of 12 or 13 rows do (not those of
    24), so that a deviation of exactly a limit falls on the same side of it; Spark's ``stddev_pop`` differs from that in the last digit."""

    def add(a: Column, x: Column) -> Column:
        n, d = a["n"] + 1.0, x - a["mean"]
        mean = a["mean"] + d / n
        return F.struct(n.alias("n"), (a["sum"] + x).alias("sum"), mean.alias("mean"), (a["squares"] + (x - mean) * d).alias("squares"))

    def finish(a: Column) -> Column:
        n = F.nullif(a["n"], F.lit(0.0))
        return F.struct((a["sum"] / n).alias("m"), F.sqrt(a["squares"] / n).alias("s"))

    return F.aggregate(values, F.struct(*(F.lit(0.0).alias(c) for c in ("n", "sum", "mean", "squares"))), add, finish)


def variability(df: DataFrame, keys: list[str], order: str, value: str, width: int, max_cv: float, max_std: float, out: str = "unstable") -> DataFrame:
    """Rolling coefficient of variation or population deviation above its limit; with a mean of 0 the coefficient is above every limit, as a
    division of doubles and the order of not-a-number have it."""
    df = centred(df, keys, order, width, {"_l": lambda w: F.collect_list(value).over(w)})
    df = df.withColumn("_l", F.when(F.col(value).isNotNull(), _mean_and_deviation(F.col("_l"))))  # rows without a value are stable
    m, s = F.col("_l.m"), F.col("_l.s")
    cv = F.when(m == 0, s.isNotNull()).otherwise(s / F.nullif(m, F.lit(0.0)) > max_cv)
    return df.withColumn(out, F.coalesce(cv | (s > max_std), F.lit(False))).drop("_l")


def baseline(df: DataFrame, keys: list[str], order: str, value: str, is_night: Column, width: int, quantile: float, least: int, out: str = "corrected") -> DataFrame:
    """Rolling night quantile, interpolated over rows without one, subtracted; floored at 0. The quantile is read off an ordered window that slides
    over pieces of the series; ``order`` doesn't repeat in one."""
    from .fill import linear

    h = width // 2

    def run(values: dict[str, np.ndarray], place: np.ndarray, lo: int, hi: int, n: int) -> dict[str, np.ndarray]:
        own = place[lo:hi]
        a, b = np.maximum(own - h, 0) - place[0], np.minimum(own + h + 1, n) - place[0]
        return {"_n": (got := sliding.slide(values["_q"], a, b, [lambda w: len(w.values), lambda w: w.quantile(quantile)]))[0].astype(np.int64), "_w": got[1]}

    df = ranks.over_pieces(df.withColumn("_q", F.when(is_night, F.col(value))), keys, order, ["_q"], h, run, "_n bigint, _w double")
    df = df.withColumn("_b", F.when((F.col("_n") >= least) & ~F.isnan("_w"), F.col("_w"))).drop("_n", "_w")
    return linear(df, keys, order, "_b", "_base").withColumn(out, F.greatest(F.col(value) - F.coalesce("_base", F.lit(0.0)), F.lit(0.0))).withColumn(out, F.when(F.col(value).isNotNull(), F.col(out))).drop("_q", "_b", "_base")


def window_points(df: DataFrame, keys: list[str], time: str, seconds: int) -> DataFrame:
    """Number of points that ``seconds`` are at the median step of each series (at least one)."""
    step = F.col(time) - F.lag(time).over(Window.partitionBy(*keys).orderBy(time))
    return df.withColumn("_d", step).groupBy(*keys).agg(F.expr("percentile(_d, 0.5)").alias("step")).select(*keys, "step", F.greatest(F.floor(F.lit(seconds) / F.col("step")), F.lit(1)).alias("points"))


def rolling(df: DataFrame, keys: list[str], order: str, value: str, n: int, least: int) -> DataFrame:
    """Trailing mean, sample deviation and sum over n rows, null under ``least`` known values."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1), 0)
    enough = F.count(value).over(w) >= least
    return df.select("*", *(F.when(enough, f(value).over(w)).alias(f"{value}_{k}_{n}") for k, f in (("mean", F.avg), ("std", F.stddev_samp), ("sum", F.sum))))


def gaps(df: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Maximal runs of missing values: keys, gap_start, gap_end, size (rows, at least 1)."""
    marked = islands(df, keys, time, F.col(value).isNull())
    return marked.where(F.col(value).isNull()).groupBy(*keys, "_island").agg(F.min(time).alias("gap_start"), F.max(time).alias("gap_end"), F.count("*").alias("size")).drop("_island")


def segments(df: DataFrame, keys: list[str], time: str, limit: Column | float, least: int, out: str = "segment") -> DataFrame:
    """Numbers runs without a step above ``limit``; rows of runs shorter than ``least`` rows get null."""
    w = Window.partitionBy(*keys).orderBy(time)
    df = df.withColumn("_s", F.sum(F.when(F.col(time) - F.lag(time).over(w) > limit, 1).otherwise(0)).over(w))
    return df.withColumn(out, F.when(F.count("*").over(Window.partitionBy(*keys, "_s")) >= least, F.col("_s"))).drop("_s")


def segments_relative(df: DataFrame, keys: list[str], time: str, times: float, least: int, out: str = "segment") -> DataFrame:
    """Segments cut where a step exceeds ``times`` the series' median step."""
    w = Window.partitionBy(*keys).orderBy(time)
    med = F.expr("percentile(_d, 0.5)").over(Window.partitionBy(*keys))
    df = df.withColumn("_d", F.col(time) - F.lag(time).over(w)).withColumn("_med", med)
    return segments(df, keys, time, F.lit(times) * F.col("_med"), least, out).drop("_d", "_med")


def longest_run(df: DataFrame, keys: list[str], time: str, value: str, least: int) -> DataFrame:
    """The longest run of known values of each series (the earliest on ties), if it has ``least`` rows."""
    runs = islands(df, keys, time, F.col(value).isNotNull()).where(F.col(value).isNotNull()).groupBy(*keys, "_island").agg(F.min(time).alias("run_start"), F.max(time).alias("run_end"), F.count("*").alias("length"))
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("length"), "run_start"))
    return runs.where(F.col("length") >= least).withColumn("_r", best).where("_r = 1").drop("_r", "_island")


def lag_features(df: DataFrame, keys: list[str], order: str, value: str, lags: tuple[int, ...]) -> DataFrame:
    """Lags, leads and the difference to the row before, within a series."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.select("*", *(F.lag(value, k).over(w).alias(f"{value}_lag{k}" if k > 0 else f"{value}_lead{-k}") for k in lags), (F.col(value) - F.lag(value).over(w)).alias(f"{value}_diff"))


def lag_matrix(df: DataFrame, keys: list[str], order: str, dynamic: list[str], width: int) -> DataFrame:
    """``<feature>_t-k`` for k from width-1 to 0; rows without a whole window go."""
    w = Window.partitionBy(*keys).orderBy(order)
    cols = [F.lag(c, k).over(w).alias(f"{c}_t-{k}") for c in dynamic for k in range(width - 1, -1, -1)]
    return df.select("*", *cols, F.row_number().over(w).alias("_rn")).where(F.col("_rn") >= width).drop("_rn")


def training_windows(df: DataFrame, keys: list[str], order: str, value: str, label: str, width: int, shift: int) -> DataFrame:
    """One row per window of ``width`` complete rows with the label ``shift`` rows after it; ``keys`` include the segment, so none crosses one."""
    w = Window.partitionBy(*keys).orderBy(order)
    seen = w.rowsBetween(-(width - 1), 0)
    out = df.select(*keys, order, F.collect_list(value).over(seen).alias("inputs"), F.count("*").over(seen).alias("_n"), F.lead(label, shift).over(w).alias("label"), F.lead(order, shift).over(w).alias("target"))
    return out.where((F.col("_n") == width) & (F.size("inputs") == width) & F.col("label").isNotNull()).drop("_n")


def since_last(df: DataFrame, keys: list[str], order: str, event: Column, out: str) -> DataFrame:
    """Rows since the last row with ``event`` (0 on it; counted from the start before the first one)."""
    w = Window.partitionBy(*keys).orderBy(order)
    df = df.withColumn("_g", F.sum(F.when(event, 1).otherwise(0)).over(w))
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys, "_g").orderBy(order)) - 1).drop("_g")


def floored_sum(df: DataFrame, keys: list[str], order: str, delta: str, out: str) -> DataFrame:
    """Running sum that never falls below 0; missing deltas give null and change nothing. Closed form: S - min(0, min of S so far)."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_s", F.sum(F.coalesce(F.col(delta), F.lit(0.0))).over(w))
    return df.withColumn(out, F.when(F.col(delta).isNotNull(), F.col("_s") - F.least(F.lit(0.0), F.min("_s").over(w)))).drop("_s")


def z_score(df: DataFrame, keys: list[str], value: str, out: str, near_zero: float = 1e-9) -> DataFrame:
    """Standard score within a key by sample deviation; 0 where the deviation is next to nothing."""
    w = Window.partitionBy(*keys)
    s = F.stddev_samp(value).over(w)
    return df.withColumn(out, F.when(s > near_zero, (F.col(value) - F.avg(value).over(w)) / s).when(F.col(value).isNotNull(), 0.0))


def relative_range(df: DataFrame, keys: list[str], value: str, low: float, high: float, out: str) -> DataFrame:
    """Place between two quantiles of the key, clipped to 0..1; null where they coincide."""
    w = Window.partitionBy(*keys)
    q = F.expr(f"percentile(`{value}`, array({low}, {high}))").over(w)
    df = df.withColumn("_q", q)
    lo, hi = F.col("_q")[0], F.col("_q")[1]
    return df.withColumn(out, F.when((hi > lo) & F.col(value).isNotNull(), F.least(F.greatest((F.col(value) - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0)))).drop("_q")


def active_season(df: DataFrame, keys: list[str], order: str, value: str, out: str = "season") -> DataFrame:
    """Rows in season by their own signal: 14-row centred mean of known rows above 0.2 of its 95 % quantile; a series whose amplitude
    (q95 - q05) / median is under 0.3 is in season throughout. Rows without a value are not part of the result."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-7, 6)
    known = df.where(F.col(value).isNotNull()).withColumn("_m", F.avg(value).over(w))
    known = known.withColumn("_q", F.expr("percentile(_m, array(0.05, 0.5, 0.95))").over(Window.partitionBy(*keys)))
    q = F.col("_q")
    return known.withColumn(out, ((q[2] - q[0]) / q[1] < 0.3) | (F.col("_m") > 0.2 * q[2])).drop("_m", "_q")


def ramp(c: Column, low: float, high: float) -> Column:
    """0 up to ``low``, 1 from ``high``, linear between."""
    return F.least(F.greatest((c - low) / (high - low), F.lit(0.0)), F.lit(1.0))


def season_index(df: DataFrame, keys: list[str], order: str, index: Column, out: str = "gsi") -> DataFrame:
    """21-row centred mean of a daily index."""
    return df.withColumn("_i", index).withColumn(out, F.avg("_i").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-10, 10))).drop("_i")


def warm_season(df: DataFrame, keys: list[str], order: str, warm: Column, run: int = 5) -> DataFrame:
    """First and last day on which a run of warm days has reached ``run`` rows; keys hold the series and the year."""
    marked = islands(df, keys, order, warm).withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "_island").orderBy(order)))
    hit = F.when(warm & (F.col("_k") >= run), F.col(order))
    return marked.groupBy(*keys).agg(F.min(hit).alias("season_start"), F.max(hit).alias("season_end"))


def degree_day_season(df: DataFrame, keys: list[str], order: str, degrees: Column, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Days between which the share of the year's degree days goes from ``low`` to ``high``."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    share = F.sum("_g").over(w) / F.sum("_g").over(Window.partitionBy(*keys))
    inside = df.withColumn("_g", F.greatest(degrees, F.lit(0.0))).withColumn("_p", share)
    hit = F.when((F.col("_p") >= low) & (F.col("_p") <= high), F.col(order))
    return inside.groupBy(*keys).agg(F.min(hit).alias("season_start"), F.max(hit).alias("season_end"))


def phenology(df: DataFrame, keys: list[str], order: str, value: str, share: float = 0.5) -> DataFrame:
    """First and last row above ``share`` of the range of the smoothed value, and the rows of its steepest rise and fall (the earliest on
    ties)."""
    w = Window.partitionBy(*keys).orderBy(order)
    s = df.where(F.col(value).isNotNull()).withColumn("_s", F.avg(value).over(w.rowsBetween(-3, 3))).withColumn("_d", F.col("_s") - F.lag("_s").over(w))
    s = s.withColumn("_lo", F.min("_s").over(Window.partitionBy(*keys))).withColumn("_hi", F.max("_s").over(Window.partitionBy(*keys)))
    hit = F.when(F.col("_s") > F.col("_lo") + share * (F.col("_hi") - F.col("_lo")), F.col(order))
    step = F.floor(F.col("_d") * 1e6 + 0.5).cast("double")  # in millionths, so that equal steps tie; the first row has none
    return s.groupBy(*keys).agg(F.min(hit).alias("above_start"), F.max(hit).alias("above_end"),
                                F.min_by(F.col(order), F.struct(F.coalesce(-step, F.lit(1e300)), F.col(order))).alias("rise"), F.min_by(F.col(order), F.struct(F.coalesce(step, F.lit(1e300)), F.col(order))).alias("fall"))


def moisture_season(df: DataFrame, keys: list[str], order: str, water: str, rain: str, demand: str, least_water: float, least_ratio: float, days: int = 30, out: str = "moist") -> DataFrame:
    """Trailing mean of soil water and ratio of trailing sums of rain and demand both high enough."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(days - 1), 0)
    ratio = F.sum(rain).over(w) / F.sum(demand).over(w)
    return df.withColumn(out, F.coalesce((F.avg(water).over(w) > least_water) & (ratio > least_ratio), F.lit(False)))


def flux_from_total(df: DataFrame, keys: list[str], order: str, total: str, seconds: int, out: str = "flux", top: float = 1500.0) -> DataFrame:
    """Accumulated amounts, reset once a day, to a flux; a fall means a reset and counts from zero. Clipped to 0..top."""
    d = F.col(total) - F.lag(total).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn(out, F.least(F.greatest(F.when(d < 0, F.col(total)).otherwise(d) / seconds, F.lit(0.0)), F.lit(top)))


def local_weights(width: int) -> list[list[float]]:
    """Row i: weights of a window's ``width`` values for the value at place i of their least-squares parabola."""
    x = np.vander(np.arange(width) - width // 2, 3).astype(float)
    return (x @ np.linalg.pinv(x)).tolist()


def savitzky_golay(df: DataFrame, keys: list[str], order: str, value: str, width: int = 7, out: str = "smooth") -> DataFrame:
    """Quadratic local fit over ``width`` rows where all of them are known. The first and last half windows of a series are places on the
    parabola through its first and last ``width`` rows. Rows of shorter series, and with a missing value in their window, keep their value."""
    h = width // 2
    w = Window.partitionBy(*keys).orderBy(order)
    before, after = F.count(F.lit(1)).over(w.rowsBetween(-h, -1)), F.count(F.lit(1)).over(w.rowsBetween(1, h))
    around = F.collect_list(F.struct(F.col(value).alias("v"))).over(w.rowsBetween(-(width - 1), width - 1))
    n, lo = F.size("_l"), F.col("_b")
    first = F.when(lo < h, F.lit(1)).when(F.col("_a") < h, n - width + 1).otherwise(F.least(F.col("_r"), F.lit(width)) - h)
    place = F.when(lo < h, lo).when(F.col("_a") < h, width - 1 - F.col("_a")).otherwise(F.lit(h))
    df = df.withColumn("_b", before).withColumn("_a", after).withColumn("_r", F.count(F.lit(1)).over(w.rowsBetween(-(width - 1), 0))).withColumn("_l", around)
    table = F.array(*(F.array(*map(F.lit, row)) for row in local_weights(width)))
    df = df.withColumn("_p", place.cast("int")).withColumn("_l", F.when(n >= width, F.slice("_l", first.cast("int"), F.lit(width))))
    fit = F.aggregate(F.zip_with("_l", F.element_at(table, F.col("_p") + 1), lambda a, b: a["v"] * b), F.lit(0.0), lambda a, x: a + x)
    known = F.col("_l").isNotNull() & ~F.exists("_l", lambda a: a["v"].isNull())
    return df.withColumn(out, F.when(known, fit).otherwise(F.col(value))).drop("_b", "_a", "_r", "_l", "_p")


def largest_step(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Largest absolute change between neighbouring rows of each series."""
    d = F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(order)))
    return df.withColumn("_d", d).groupBy(*keys).agg(F.max("_d").alias("max_step"))


def sequences(df: DataFrame, keys: list[str], order: str, value: str, length: int = 24) -> DataFrame:
    """The last ``length`` values up to each row; the first rows of a series are padded on the left with its earliest value."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(length - 1), 0)
    df = df.where(F.col(value).isNotNull()).withColumn("_l", F.collect_list(value).over(w))
    return df.withColumn("sequence", F.concat(F.expr(f"array_repeat(_l[0], {length} - size(_l))"), F.col("_l"))).drop("_l")
