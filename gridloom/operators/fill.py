"""Gap filling of regular series (a row for each step, missing values null)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def known_neighbours(df: DataFrame, keys: list[str], time: str, value: str, position: str | None = None) -> DataFrame:
    """Add _pv, _pt, _nv, _nt: value and place of the last known row up to each row and of the next from it on.

    The next known row is the last one in descending order, so that both frames grow by a row at a time; places must not repeat in a series."""
    w = Window.partitionBy(*keys).orderBy(time)
    if position is None:
        df, position = df.withColumn("_rn", F.row_number().over(w)), "_rn"
    # value and place on their own: plain numbers are cheaper to carry along a frame than a struct
    v, t = F.col(value), F.when(F.col(value).isNotNull(), F.col(position))
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys).orderBy(F.col(position).desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = df.select("*", F.last(v, True).over(back).alias("_pv"), F.last(t, True).over(back).alias("_pt"))
    return out.select("*", F.last(v, True).over(ahead).alias("_nv"), F.last(t, True).over(ahead).alias("_nt"), F.col(position).alias("_at"))


_HELP = ("_pv", "_pt", "_nv", "_nt", "_at", "_rn")


def _between() -> Column:
    return F.when(F.col("_nt") == F.col("_pt"), F.col("_pv")).otherwise(F.col("_pv") + (F.col("_nv") - F.col("_pv")) * (F.col("_at") - F.col("_pt")) / (F.col("_nt") - F.col("_pt")))


def linear(df: DataFrame, keys: list[str], time: str, value: str, out: str = "filled") -> DataFrame:
    """Linear interpolation by row position, both edges extended, clipped at 0; a series without any value stays null."""
    filled = F.coalesce(_between(), F.col("_pv"), F.col("_nv"))
    return known_neighbours(df, keys, time, value).withColumn(out, F.when(filled.isNotNull(), F.greatest(filled, F.lit(0.0)))).drop(*_HELP)


def interpolate_time(df: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Linear interpolation by elapsed time, edges not extended."""
    return known_neighbours(df, keys, time, value, time).withColumn(value, _between()).drop(*_HELP)


def nearest(df: DataFrame, keys: list[str], time: str, value: str, out: str = "filled") -> DataFrame:
    """The nearer known value; a tie takes the earlier one, rows outside the known range stay null (as pandas' nearest leaves them); clipped at 0."""
    pick = F.when(F.col("_pt").isNotNull() & F.col("_nt").isNotNull(), F.when(F.col("_at") - F.col("_pt") <= F.col("_nt") - F.col("_at"), F.col("_pv")).otherwise(F.col("_nv")))
    return known_neighbours(df, keys, time, value).withColumn(out, F.when(pick.isNotNull(), F.greatest(pick, F.lit(0.0)))).drop(*_HELP)


def mean_diurnal(df: DataFrame, keys: list[str], time: str, value: str, days: int = 7, out: str = "filled", daily: bool = False) -> DataFrame:
    """Gaps take the mean at the same hour of the day within so many days, what is left is interpolated; clipped at 0. ``time`` counts hours;
    of ``daily`` series it counts days, and the day of the week stands for the hour."""
    per_day, period = (1, 7) if daily else (24, 24)
    w = Window.partitionBy(*keys, F.pmod(F.col(time), F.lit(period))).orderBy(time).rangeBetween(-per_day * days, per_day * days)
    step = df.withColumn("_m", F.coalesce(F.col(value), F.avg(value).over(w)))
    return linear(step, keys, time, "_m", out).drop("_m")


def rolling_mean(df: DataFrame, keys: list[str], time: str, value: str, window: int | None = None, out: str = "filled", daily: bool = False) -> DataFrame:
    """Gaps take the centred rolling mean where a quarter of the window is known, what is left is interpolated; clipped at 0. The window is 48
    rows, 7 of ``daily`` series, unless it is given."""
    window = window or (7 if daily else 48)
    w = Window.partitionBy(*keys).orderBy(time).rowsBetween(-(window // 2), window - window // 2 - 1)
    mean = F.when(F.count(value).over(w) >= max(1, window // 4), F.avg(value).over(w))
    return linear(df.withColumn("_m", F.coalesce(F.col(value), mean)), keys, time, "_m", out).drop("_m")


def seasonal(df: DataFrame, keys: list[str], time: str, value: str, period: int | None = None, out: str = "filled", daily: bool = False, piece: int = 20_000) -> DataFrame:
    """Seasonal-trend fill: gaps take trend and season of the interpolated series (``decompose.decompose``: local regression, outliers weighed
    down) plus the interpolated rest of the known rows. The period is 24 rows, 7 of ``daily`` series; a series of fewer than two periods takes
    the rolling mean. Clipped at 0.

    A series of more than ``piece`` rows is decomposed in pieces with forty periods of neighbours on each side. Local regressions reach no
    farther; only the scale by which outliers lose weight is then a piece's own. ``time`` doesn't repeat in a series.
    """
    from . import ranks
    from .decompose import decompose

    period = period or (7 if daily else 24)

    def run(values: dict[str, np.ndarray], place: np.ndarray, lo: int, hi: int, n: int) -> dict[str, np.ndarray]:
        y = values["_lin"]
        if n < 2 * period or np.isnan(y).any() or lo == hi:
            return {"_trend": np.full(hi - lo, np.nan), "_season": np.full(hi - lo, np.nan)}
        trend, season = decompose(y, period)
        return {"_trend": trend[lo:hi], "_season": season[lo:hi]}

    base = rolling_mean(linear(df, keys, time, value, "_lin"), keys, time, value, None, "_rolled", daily)
    parts = ranks.over_pieces(base, keys, time, ["_lin"], 40 * period, run, "_trend double, _season double", piece)
    model = F.when(~F.isnan("_trend"), F.col("_trend") + F.col("_season"))
    rest = parts.withColumn("_model", model).withColumn("_rest", F.col(value) - F.col("_model"))
    filled = known_neighbours(rest, keys, time, "_rest").withColumn("_r", F.coalesce(_between(), F.col("_pv"), F.col("_nv"))).drop(*_HELP)
    total = F.coalesce(F.col(value), F.col("_model") + F.coalesce("_r", F.lit(0.0)), F.col("_rolled"))
    return filled.withColumn(out, F.when(total.isNotNull(), F.greatest(total, F.lit(0.0)))).drop("_lin", "_rolled", "_trend", "_season", "_model", "_rest", "_r")


def akima(df: DataFrame, keys: list[str], time: str, value: str, out: str = "filled") -> DataFrame:
    """Akima's piecewise cubic through the known rows (by row position); series of fewer than four known rows are interpolated linearly (edges
    extended); of others, rows outside the known range stay null, as ``nearest`` leaves them. Clipped at 0."""
    w = Window.partitionBy(*keys).orderBy(time)
    # the known rows of a series are a window of their own, so no join brings back what is found there
    placed = df.withColumn("_rn", F.row_number().over(w)).withColumn("_aknown", F.col(value).isNotNull()).withColumn("_ay", F.col(value))
    k = Window.partitionBy(*keys, "_aknown").orderBy("_rn")
    m = placed.withColumn("_am0", (F.lead("_ay").over(k) - F.col("_ay")) / (F.lead("_rn").over(k) - F.col("_rn")))
    for i in (1, 2):
        m = m.withColumn(f"_ap{i}", F.lag("_am0", i).over(k)).withColumn(f"_an{i}", F.lead("_am0", i).over(k))
    # two slopes beyond each end continue the change of the slopes there
    m = m.withColumn("_am0x", F.coalesce("_am0", 2 * F.col("_ap1") - F.col("_ap2"))).withColumn("_ap1x", F.coalesce("_ap1", 2 * F.col("_am0x") - F.col("_an1")))
    m = m.withColumn("_an1x", F.coalesce("_an1", 2 * F.col("_am0x") - F.col("_ap1x"))).withColumn("_ap2x", F.coalesce("_ap2", 2 * F.col("_ap1x") - F.col("_am0x")))
    a, b = F.abs(F.col("_an1x") - F.col("_am0x")), F.abs(F.col("_ap1x") - F.col("_ap2x"))
    t = m.withColumn("_ag", F.when(a + b > 1e-9, (a * F.col("_ap1x") + b * F.col("_am0x")) / (a + b)).otherwise((F.col("_ap1x") + F.col("_am0x")) / 2))
    seg = t.withColumn("_ah", F.lead("_rn").over(k) - F.col("_rn")).withColumn("_ag1", F.lead("_ag").over(k))
    last = F.last(F.when(F.col("_aknown"), F.struct("_rn", "_ay", "_ag", "_am0", "_ah", "_ag1")), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    placed = seg.select(*df.columns, "_rn", last.alias("_as"), F.count(value).over(Window.partitionBy(*keys)).alias("_ac"))
    f = linear(placed.withColumnRenamed("_rn", "_ai"), keys, time, value, "_line").withColumnRenamed("_ai", "_rn")
    d = F.col("_rn") - F.col("_as._rn")
    h = F.col("_as._ah")
    cubic = F.col("_as._ay") + F.col("_as._ag") * d + (3 * F.col("_as._am0") - 2 * F.col("_as._ag") - F.col("_as._ag1")) / h * d * d + (F.col("_as._ag") + F.col("_as._ag1") - 2 * F.col("_as._am0")) / (h * h) * d * d * d
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("_ac") < 4, F.col("_line")).otherwise(cubic)
    return f.select(*df.columns, F.when(filled.isNotNull(), F.greatest(filled, F.lit(0.0))).alias(out))


def bin_climatology(df: DataFrame, keys: list[str], day_of_year: Column, value: str, days: int = 4, out: str = "filled") -> DataFrame:
    """Gaps take the mean of their bin of ``days`` days of the year over all years."""
    w = Window.partitionBy(*keys, F.floor((day_of_year - 1) / days))
    return df.withColumn(out, F.coalesce(F.col(value), F.avg(value).over(w)))


def fill_small_gaps(df: DataFrame, keys: list[str], time: str, value: str, limits: tuple[tuple[int, str], ...] = ((3, "linear"), (24, "diurnal")), out: str = "filled") -> DataFrame:
    """Gaps of up to the first limit are interpolated, those up to the second take the diurnal mean; longer ones stay null."""
    from .windows import islands

    sized = islands(df, keys, time, F.col(value).isNull()).withColumn("_size", F.when(F.col(value).isNull(), F.count("*").over(Window.partitionBy(*keys, "_island", F.col(value).isNull()))))
    for i, (_, method) in enumerate(limits):
        sized = linear(sized, keys, time, value, f"_f{i}") if method == "linear" else mean_diurnal(sized, keys, time, value, out=f"_f{i}")
    pick = F.when(F.col(value).isNotNull(), F.col(value))
    for i, (limit, _) in enumerate(limits):
        pick = pick.when(F.col("_size") <= limit, F.col(f"_f{i}"))
    return sized.withColumn(out, pick).drop("_size", "_island", *(f"_f{i}" for i in range(len(limits))))


def gap_mask(before: str, after: str) -> Column:
    """Whether a value was filled."""
    return F.col(before).isNull() & F.col(after).isNotNull()


def lag_features(df: DataFrame, keys: list[str], time: str, value: str, lags: int = 24) -> DataFrame:
    """Earlier values, hour and rolling mean and deviation of the day before, for model-based filling."""
    w = Window.partitionBy(*keys).orderBy(time)
    day = w.rowsBetween(-23, 0)
    return df.select("*", *(F.lag(value, k).over(w).alias(f"lag_{k}") for k in range(1, lags + 1)), (F.col(time) % 24).alias("hour"), F.avg(value).over(day).alias("roll_mean"),
                     F.stddev_samp(value).over(day).alias("roll_std"), ((F.col(time) % 24 >= 6) & (F.col(time) % 24 <= 20)).cast("int").alias("daytime"))


#: Rows with all features that a series must have to be learned from.
LEAST_TRAINED = 50


def lag_space(df: DataFrame, keys: list[str], time: str, value: str, hour: Column, day_of_year: Column, month: Column, lags: int = 24) -> DataFrame:
    """keys, time, value and ``features``: the values before each row, hour, day of the year, month, trailing mean and sample deviation of 24 rows
    (0 for one value) and daytime; null where any is missing."""
    w = Window.partitionBy(*keys).orderBy(time)
    day = w.rowsBetween(-23, 0)
    one = [*(F.lag(value, k).over(w) for k in range(1, lags + 1)), hour, day_of_year, month, F.avg(value).over(day), F.coalesce(F.stddev_samp(value).over(day), F.when(F.count(value).over(day) > 0, F.lit(0.0))), hour.between(6, 20).cast("int")]
    out = df.select(*keys, F.col(time), F.col(value), *(c.cast("double").alias(f"_f{i}") for i, c in enumerate(one)))
    names = [f"_f{i}" for i in range(len(one))]
    # plain columns up to here: functions of array elements are not compiled
    whole = F.lit(True)
    for c in names:
        whole = whole & F.col(c).isNotNull()
    return out.select(*keys, time, value, F.when(whole, F.array(*names)).alias("features"))


def scaled_by_key(df: DataFrame, keys: list[str], vector: str, width: int, learned: Column, least: int = LEAST_TRAINED) -> DataFrame:
    """``df`` with the vector less its mean over population deviation (1 where that is 0) within its key, both over the ``learned`` rows; keys with
    fewer than ``least`` of them go."""
    from .joins import small

    parts = [f(F.element_at(vector, i + 1)).alias(f"_{n}{i}") for i in range(width) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    stats = df.where(learned).groupBy(*keys).agg(F.count("*").alias("_trained"), *parts).where(F.col("_trained") >= least)
    scale = [F.struct(F.col(f"_m{i}").alias("m"), F.when(F.col(f"_s{i}") > 0, F.col(f"_s{i}")).otherwise(1.0).alias("s")) for i in range(width)]
    stats = stats.select(*keys, F.array(*scale).alias("_by"))
    return df.join(small(stats), keys).withColumn(vector, F.zip_with(vector, "_by", lambda x, y: (x - y["m"]) / y["s"])).drop("_by")


def nearest_in_lags(df: DataFrame, keys: list[str], time: str, value: str, hour: Column | None = None, day_of_year: Column | None = None, month: Column | None = None, k: int = 10, lags: int = 24, out: str = "filled") -> DataFrame:
    """Gaps take the mean of the k known rows of their series nearest in the space of ``lag_space``, standardised (k at most a tenth of the known
    rows, one at least; ties to the earlier row); series with fewer than ``LEAST_TRAINED`` known rows with all features, and gaps without all
    features, are interpolated. Clipped at 0.

    ``time`` is a whole number that doesn't repeat in a series, by default of hours since 1970. Neighbours are found by blocks
    (``neighbours.nearest``), so a long series spreads over many tasks.
    """
    from gridloom.sources.shared import kept

    from .joins import small
    from .neighbours import nearest as nearest_points

    at = F.timestamp_seconds(F.col(time) * 3600)
    space = lag_space(df, keys, time, value, F.pmod(F.col(time), F.lit(24)) if hour is None else hour, F.dayofyear(at) if day_of_year is None else day_of_year, F.month(at) if month is None else month, lags)
    space = kept(space, "lag-space")
    known = F.col(value).isNotNull()
    z = scaled_by_key(space.where("features is not null"), keys, "features", lags + 6, known)
    near = nearest_points(z.where(~known), z.where(known), k, "features", time, keys, value=value)
    counts = space.groupBy(*keys).agg(F.least(F.lit(k), F.greatest(F.lit(1), F.floor(F.count(value) * 0.1))).cast("int").alias("_k"))
    best = F.slice("near", 1, F.col("_k"))
    mean = F.aggregate(best, F.lit(0.0), lambda a, x: a + x["value"]) / F.size(best)
    found = near.where("near is not null").join(small(counts), keys).select(*keys, time, F.greatest(mean, F.lit(0.0)).alias("_p"))
    return linear(df.join(found, [*keys, time], "left").withColumn("_m", F.coalesce(F.col(value), F.col("_p"))), keys, time, "_m", out).drop("_m", "_p")


#: Rows of a key that its model is trained on at most (those first in the order of a hash), and gap rows a task predicts at once.
TRAIN_ROWS, PREDICT_ROWS = 20_000, 50_000


def by_own_model(df: DataFrame, keys: list[str], time: str, value: str, hour: Column | None = None, day_of_year: Column | None = None, month: Column | None = None, lags: int = 24, out: str = "filled") -> DataFrame:
    """Gaps take what the series' own model predicts from ``lag_space``; clipped at 0.

    A series with ``LEAST_TRAINED`` known rows with all features gets a model of boosted trees, fitted in one task on at most ``TRAIN_ROWS`` of
    them, the first in hash order. Gaps without all features, and series with fewer rows to learn from, are interpolated. ``time`` is as
    in ``nearest_in_lags``.
    """
    import pickle

    import pyarrow as pa

    from gridloom.sources.shared import kept

    from . import boosting
    from .ranks import join_same

    at = F.timestamp_seconds(F.col(time) * 3600)
    df = kept(df, "series")
    space = lag_space(df, keys, time, value, F.pmod(F.col(time), F.lit(24)) if hour is None else hour, F.dayofyear(at) if day_of_year is None else day_of_year, F.month(at) if month is None else month, lags)
    space = kept(space.where("features is not null"), "lag-space")
    trained = space.where(F.col(value).isNotNull())
    enough = kept(trained.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= LEAST_TRAINED), "trained")
    # a cut by hash that leaves about twice the rows wanted of a longer series, then the first of them
    cut = F.pmod(F.xxhash64(time, F.lit(5)), F.lit(1 << 30)) < F.least(F.lit(1.0), 2.0 * TRAIN_ROWS / F.col("_n")) * (1 << 30)
    sample = join_same(trained, enough, keys).where(cut).withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(time, F.lit(5)), time))).where(F.col("_r") <= TRAIN_ROWS)
    matrix = lambda c: c.combine_chunks().flatten().to_numpy().reshape(len(c), -1)
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in space.select(*keys).schema.fields)

    def learn(t: pa.Table) -> pa.Table:
        t = t.sort_by([(time, "ascending")])
        model = boosting.fit(matrix(t.column("features")), t.column(value).to_numpy())
        return pa.table([*(t.column(k).slice(0, 1) for k in keys), pa.array([pickle.dumps(model)], pa.binary())], names=[*keys, "_model"])

    models = kept(sample.select(*keys, time, F.col(value).cast("double"), "features").groupBy(*keys).applyInArrow(learn, f"{names}, _model binary"), "models")
    gaps = kept(join_same(space.where(F.col(value).isNull()), enough, keys), "gaps")
    parts = gaps.groupBy(*keys).agg(F.ceil(F.count("*") / PREDICT_ROWS).cast("int").alias("_parts"))
    gaps = join_same(gaps.select(*keys, time, "features"), parts, keys).withColumn("_part", F.pmod(F.xxhash64(time), F.col("_parts")).cast("int"))
    copies = join_same(models, parts, keys).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))

    def predict(rows: pa.Table, model: pa.Table) -> pa.Table:
        p = pickle.loads(model.column("_model")[0].as_py()).predict(matrix(rows.column("features"))) if rows.num_rows and model.num_rows else np.zeros(0)
        return pa.table([*(rows.column(k).slice(0, len(p)) for k in (*keys, time)), pa.array(np.maximum(p, 0.0))], names=[*keys, time, "_p"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in space.select(*keys, time).schema.fields)
    found = kept(gaps.groupBy(*keys, "_part").cogroup(copies.select(*keys, "_part", "_model").groupBy(*keys, "_part")).applyInArrow(predict, f"{types}, _p double"), "predicted")
    return linear(df.join(found, [*keys, time], "left").withColumn("_m", F.coalesce(F.col(value), F.col("_p"))), keys, time, "_m", out).drop("_m", "_p")
