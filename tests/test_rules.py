"""Edge rules that the tables at hand don't show, on frames small enough to work out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from gridloom.operators import aoa, clean, fill, joins, resample, skill, windows
from gridloom.streaming import incremental


def series(spark, values, key="a"):
    return spark.createDataFrame([(key, i, None if v is None else float(v)) for i, v in enumerate(values)], "k string, t long, v double")


def column(df, name, order="t"):
    return [r[name] for r in df.orderBy(order).collect()]


@pytest.mark.parametrize("n", [3, 8, 9, 17])
@pytest.mark.parametrize("width", [4, 5, 8])
def test_centred_bounds(spark, n, width):
    h = width // 2
    want = []
    for i in range(n):
        lo, hi = (0, n) if width >= n else (0, width) if i + h + 1 < width else (n - width, n) if i - h > n - width else (max(0, i - h), min(n, i + h + 1))
        want.append(sum(range(lo, hi)) / (hi - lo))
    got = column(windows.centred(series(spark, range(n)), ["k"], "t", width, {"m": lambda w: F.avg("v").over(w)}), "m")
    assert got == pytest.approx(want)


def test_floored_sum_equals_loop(spark):
    d = [3, -5, None, 2, 2, -1, -9, 4]
    s, want = 0.0, []
    for x in d:
        if x is None:
            want.append(None)
        else:
            s = max(0.0, s + x)
            want.append(s)
    assert column(windows.floored_sum(series(spark, d), ["k"], "t", "v", "o"), "o") == want


def test_linear_extends_edges_and_clips(spark):
    assert column(fill.linear(series(spark, [None, 2, None, 4, -3, None]), ["k"], "t", "v"), "filled") == [2, 2, 3, 4, 0, 0]
    assert column(fill.linear(series(spark, [None, None]), ["k"], "t", "v"), "filled") == [None, None]


def test_nearest_ties_go_back(spark):
    assert column(fill.nearest(series(spark, [None, 1, None, 3, None]), ["k"], "t", "v"), "filled") == [None, 1, 1, 3, None]


def test_akima_is_exact_on_a_line_and_falls_back_to_it(spark):
    assert column(fill.akima(series(spark, [0, 1, None, 3, 4, None, 6]), ["k"], "t", "v"), "filled") == pytest.approx([0, 1, 2, 3, 4, 5, 6])
    assert column(fill.akima(series(spark, [0, None, 2, 5]), ["k"], "t", "v"), "filled") == [0, 1, 2, 5]  # three known rows
    assert column(fill.akima(series(spark, [None, 1, None, 3, None]), ["k"], "t", "v"), "filled") == [1, 1, 2, 3, 3]
    assert column(fill.akima(series(spark, [None, 0, 1, 2, 3, None]), ["k"], "t", "v"), "filled") == [None, 0, 1, 2, 3, None]  # edges as nearest leaves them


def test_akima_passes_through_known_points(spark):
    got = column(fill.akima(series(spark, [0, None, 5, 1, None, None, 7, 2]), ["k"], "t", "v"), "filled")
    assert [got[i] for i in (0, 2, 3, 6, 7)] == [0, 5, 1, 7, 2] and all(x is not None for x in got)


def test_gap_limits(spark):
    v = [1, None, 3] + [None] * 5 + [9]
    got = column(fill.fill_small_gaps(series(spark, v), ["k"], "t", "v", ((2, "linear"), (3, "diurnal"))), "filled")
    assert got[1] == 2 and got[3:8] == [None] * 5


def test_asof_ties_and_equal_times(spark):
    left = spark.createDataFrame([("a", 5)], "k string, t long")
    right = spark.createDataFrame([("a", 3, 1), ("a", 7, 2), ("a", 3, 9)], "k string, t long, x int")
    assert joins.asof(left, right, ["k"], "t", ["x"]).first()["x"] == 9
    assert joins.asof(left, right, ["k"], "t", ["x"], tolerance=1).first()["x"] is None
    assert joins.asof(left, right.where("t > 5"), ["k"], "t", ["x"]).first()["x"] == 2
    assert joins.asof(left, right.limit(0), ["k"], "t", ["x"]).first()["x"] is None


def test_calendar_empty_bins(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 3, 2.0)], "k string, t long, v double")
    rows = resample.calendar(df, ["k"], "t", 1, {"s": ("sum", "v"), "m": ("mean", "v")}).orderBy("t").collect()
    assert [(r["s"], r["m"]) for r in rows] == [(1, 1), (0, None), (0, None), (2, 2)]
    assert resample.calendar(df.limit(0), ["k"], "t", 1, {"s": ("sum", "v")}).count() == 0


def test_labels_control_beats_drop(spark):
    df = spark.createDataFrame([("Pre Irrigation",), ("Irrigation",), (None,), ("Increment cores",), ("other",)], "l string")
    assert [r[0] for r in df.select(clean.label_class(F.col("l"))).collect()] == ["control", "drop", "keep", "sampling", "keep"]


def test_removal_lists_zip_to_the_shorter(spark):
    log = spark.createDataFrame([("2024-01-01;2024-02-01", "2024-01-02"), ("2024-03-02", "2024-03-01"), ("x", "2024-01-01")], "start_time string, end_time string")
    assert clean.removal_periods(log).count() == 1


def test_selection_ties_take_the_first_name(spark):
    df = spark.createDataFrame([(1, "b", 6, 0.9), (1, "a", 6, 0.8), (1, "c", 24, 0.1)], "k int, m string, size int, r double")
    assert skill.select_method(df, ["k"], "m", "size", "r", 0.5, 72).first()["m"] == "a"


def test_constant_truth_has_no_r2(spark):
    df = spark.createDataFrame([(1, 2.0, 2.0), (1, 2.0, 3.0)], "k int, y double, yhat double")
    assert skill.pooled(skill.error_sums(df, ["k"]), ["k"]).first()["r2"] is None


def test_median_of(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (None, None, None), (5.0, 1.0, 2.0)], "a double, b double, c double")
    assert [r[0] for r in df.select(skill.median_of(["a", "b", "c"])).collect()] == [2, None, 2]


def test_ring_search_order(spark):
    cells = spark.createDataFrame([(0, 1, 5.0), (1, 0, 6.0), (2, 2, 7.0), (1, 1, None)], "row int, col int, v double")
    got = joins.ring_search(spark.createDataFrame([(1, 1, 1)], "id int, row int, col int"), cells, ["id"], 2, "v").first()
    assert (got["v"], got["ring"]) == (5.0, 1)


def test_empty_and_missing_series(spark):
    e = series(spark, [])
    for f in (fill.linear, fill.nearest, fill.akima, fill.mean_diurnal, fill.rolling_mean, fill.seasonal, fill.nearest_in_lags):
        assert f(e, ["k"], "t", "v").count() == 0
        assert column(f(series(spark, [None, None]), ["k"], "t", "v"), "filled") == [None, None]
    assert windows.gaps(series(spark, [None, None]), ["k"], "t", "v").first()["size"] == 2


def test_savitzky_golay_keeps_a_parabola(spark):
    v = [x * x for x in range(9)]
    assert column(windows.savitzky_golay(series(spark, v), ["k"], "t", "v", 5), "smooth") == pytest.approx(v)


def test_haversine():
    assert math.isclose(2 * math.pi * 6371 / 360, 111.19, rel_tol=1e-3)


def test_long_series_take_linear_time(spark):
    """One series of 200,000 rows: next known values must not be looked for anew for every row."""
    import time

    df = spark.range(200_000).select(F.lit(1).alias("k"), F.col("id").alias("t"), F.when(F.col("id") % 50_000 == 7, F.col("id").cast("double")).alias("v"))
    t = time.time()
    got = fill.linear(df, ["k"], "t", "v").agg(F.count("filled"), F.max("filled")).first()
    pairs = joins.asof(df.select("k", "t"), df.where("v is not null").select("k", "t", "v"), ["k"], "t", ["v"]).agg(F.count("v")).first()
    assert tuple(got) == (200_000, 150_007.0) and pairs[0] == 200_000 and time.time() - t < 60


def test_blocks_of_the_cloud_agree(spark, monkeypatch):
    """Distances to a cloud dealt out in blocks, with many equal vectors, equal those by brute force."""
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (60, 3))
    x[20:45] = x[0]
    rows = [(i, v.tolist(), i % 4) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, x array<double>, fold int")
    mean, std = aoa.statistics(df, "x")
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2))
    other = np.where(np.arange(60)[:, None] % 4 == np.arange(60)[None] % 4, np.inf, d).min(1)
    for numbers in (4_000_000, 30):
        monkeypatch.setattr(aoa, "CLOUD_NUMBERS", numbers)
        got = {r["id"]: r["nearest"] for r in aoa.nearest_distance(df, df, "x", mean, std, fold="fold").collect()}
        assert np.allclose([got[i] for i in range(60)], other, atol=1e-6)
        assert abs(aoa.mean_distance(df, "x", mean, std) - d.sum() / (60 * 59)) < 1e-6


def test_stations_against_brute_force(spark):
    """Neighbours across cells, the date line and near the poles."""
    import math

    import numpy as np

    rng = np.random.default_rng(5)
    sites = [(i, float(a), float(o)) for i, (a, o) in enumerate(zip(rng.uniform(-90, 90, 60), rng.uniform(-180, 180, 60)))]
    sites += [(100 + i, a, o) for i, (a, o) in enumerate([(0.0, 179.99), (0.0, -179.99), (89.99, 10.0), (89.98, -170.0), (-90.0, 0.0), (-89.995, 77.0), (60.0, 180.0), (60.01, -180.0), (45.0, 10.0), (45.03, 10.04)])]
    df = spark.createDataFrame(sites, "id long, lat double, lon double")

    def km(a, b):
        h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(min(h, 1)))

    for far in (5.0, 900.0):
        got = [(r["id_a"], r["id_b"]) for r in joins.stations_within(df, df, far).collect()]
        assert len(got) == len(set(got)) and set(got) == {(a[0], b[0]) for a in sites for b in sites if km(a, b) <= far}


def test_composites_of_large_means(spark):
    df = spark.createDataFrame([(k % 3, 1e9 + 0.25 * k) for k in range(12)], "k int, v double")
    parts = incremental.partial_composites(df.where("v % 1 < 0.5"), ["k"], "v").unionByName(incremental.partial_composites(df.where("v % 1 >= 0.5"), ["k"], "v"))
    want = {r["k"]: r["s"] for r in df.groupBy("k").agg(F.stddev_samp("v").alias("s")).collect()}
    for r in incremental.merge_composites(parts, ["k"]).collect():
        assert abs(r["std"] - want[r["k"]]) < 1e-6 and r["n"] == 4


def test_rows_without_a_feature_stay(spark):
    from gridloom.plans import ml

    df = spark.createDataFrame([(i, float(i), None if i % 5 == 0 else float(i % 7), i % 2) for i in range(60)], "id long, y double, x double, fold int")
    got = ml.out_of_fold(df, ["x"], "y", "fold", 2, maxDepth=2, numTrees=3).collect()
    assert len(got) == 60 and all((r["prediction"] is None) == (r["id"] % 5 == 0) for r in got)


def test_variability_with_a_mean_of_zero(spark):
    """A window of zeros alone, and one of values that cancel out."""
    rows = [("a", t, 0.0 if t < 4 else None) for t in range(8)] + [("b", t, (-1.0) ** t) for t in range(4)] + [("c", t, 5.0) for t in range(4)] + [("d", 0, None)]
    df = spark.createDataFrame(rows, "k string, t long, v double")
    got = {(r["k"], r["t"]): r["unstable"] for r in windows.variability(df, ["k"], "t", "v", 4, 1.0, 30.0).collect()}
    assert all(got[k, t] == (k in "ab" and v is not None) for k, t, v in rows) and len(got) == len(rows)


def test_variability_at_its_limits_as_in_sql(spark, tmp_path):
    """Pairs 60 apart deviate by the limit of 30 exactly, pairs with a 0 by their mean: which side rounding puts them on is as in the SQL."""
    import duckdb

    from gridloom.plans import queries as registry

    pairs = [(86.84, 26.84), *((a + 60, a) if k % 2 else (a, a + 60) for k in range(200) for a in [k * 0.37 + 0.01]), *((0.0, k * 0.61) for k in range(100))]
    rows = [((2 * k + j) * 11 + 1, k, round(v, 2), 3 * j) for k, pair in enumerate(pairs) for j, v in enumerate(pair)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, value double, h int")
    events.selectExpr("event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, h) as ts", "user_id", "'view' as event_type", "value", "'{}' as props").write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = duck.sql(registry.SQL["e7_variability"]).fetchall()
    assert sorted(tuple(r) for r in registry.QUERIES["e7_variability"](spark, str(tmp_path)).collect()) == sorted(want) and len(want) == 4 * len(pairs)


def test_calendar_of_odd_keys_and_times(spark):
    """Null times make no bins, the bins of a null key stay empty, and a step of several rows starts at a multiple of it."""
    rows = [("a", 5, 1.0), ("a", 14, None), ("a", None, 9.0), (None, 1, 2.0), (None, 7, 3.0), ("b", None, 1.0), ("c", -3, 4.0)]
    df = spark.createDataFrame(rows, "k string, t long, v double")
    got = sorted((tuple(r) for r in resample.calendar(df, ["k"], "t", 4, {"m": ("mean", "v"), "n": ("count", "v")}).collect()), key=repr)
    assert got == sorted([("a", 4, 1.0, 1), ("a", 8, None, 0), ("a", 12, None, 0), (None, 0, None, 0), (None, 4, None, 0), ("c", -4, 4.0, 1)], key=repr)


def test_series_are_dealt_out_by_the_rows_they_grow_to(spark, monkeypatch):
    """Two far rows a key make many bins: they must not all be sorted in one task."""
    monkeypatch.setattr(resample, "ROWS_A_TASK", 100)
    df = spark.range(20).selectExpr("id % 10 as k", "(id div 10) * 99 as t", "1.0D as v")
    out = windows.outliers_rolling(resample.calendar(df, ["k"], "t", 1, {"v": ("mean", "v")}), ["k"], "t", "v", 4, 2.0)
    rows = out.groupBy(F.spark_partition_id()).count().collect()
    assert out.rdd.getNumPartitions() >= 10 and sum(r["count"] for r in rows) == 1000


@pytest.mark.parametrize("width", [2, 3, 8, 9])
def test_centred_on_short_and_long_series(spark, width):
    """Every length about the width, against the windows written out."""
    lengths = {f"n{n}": n for n in (*range(1, width + 3), 3 * width)}
    rows = [(k, t, float(t * t % 7)) for k, n in lengths.items() for t in range(n)]
    df = spark.createDataFrame(rows, "k string, t long, v double")
    got = {(r["k"], r["t"]): r["m"] for r in windows.centred(df, ["k"], "t", width, {"m": lambda w: F.avg("v").over(w)}).collect()}
    h = width // 2
    for k, n in lengths.items():
        v = [float(t * t % 7) for t in range(n)]
        for i in range(n):
            lo, hi = (0, n) if n <= width else (0, width) if i + h + 1 < width else (n - width, n) if i - h > n - width else (max(0, i - h), min(n, i + h + 1))
            assert got[k, i] == pytest.approx(sum(v[lo:hi]) / (hi - lo))


def test_composites_with_unknown_ends(spark):
    rows = [("a", 1, None), ("a", 3, 2.0), ("a", 5, None), ("a", 7, 6.0), ("a", 9, None), ("b", 4, None), ("b", 6, None), ("c", 2, 1.0), (None, 1, 1.0), (None, 2, 2.0)]
    df = spark.createDataFrame(rows, "k string, d long, v double")
    got = {(r["k"], r["d"]): r["v"] for r in resample.composites_to_daily(df, ["k"], "d", "v").collect()}
    assert got == {("a", 1): None, ("a", 2): None, **{("a", d): float(d - 1) for d in range(3, 8)}, ("a", 8): None, ("a", 9): None, ("b", 4): None, ("b", 5): None, ("b", 6): None, ("c", 2): 1.0, (None, 1): None, (None, 2): None}


def test_akima_needs_no_join(spark):
    rows = [("a", t, None if t in (0, 4, 5, 9) else float(t * t % 7)) for t in range(10)] + [("b", t, float(t) if t in (2, 5) else None) for t in range(8)]
    out = fill.akima(spark.createDataFrame(rows, "k string, t long, v double"), ["k"], "t", "v")
    assert "Join" not in out._jdf.queryExecution().toString()
    got = {(r["k"], r["t"]): r["filled"] for r in out.collect()}
    assert all(got[k, t] == v for k, t, v in rows if v is not None) and got["a", 0] is None and got["a", 9] is None and got["a", 4] is not None
    assert [got["b", t] for t in range(8)] == pytest.approx([2, 2, 2, 3, 4, 5, 5, 5])
