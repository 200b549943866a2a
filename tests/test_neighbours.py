"""The exact nearest-neighbour join and what is built on it, against brute force."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import aoa, fill, neighbours


def cloud(seed=0, n=500):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, 4))
    x[: n // 3] += 10
    x[n // 3 : n // 2] = x[n // 3]  # many equal vectors
    return x, np.arange(n) % 2, rng.integers(0, 3, n)


@pytest.mark.parametrize("block", [4096, 25])
@pytest.mark.parametrize("k,apart", [(1, True), (6, True), (4, False)])
def test_against_brute_force(spark, monkeypatch, block, k, apart):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", block)
    x, key, fold = cloud()
    n = len(x)
    df = spark.createDataFrame([(i, int(key[i]), x[i].tolist(), int(fold[i]), float(i % 17)) for i in range(n)], "id long, k int, x array<double>, fold int, v double")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    report = {}
    got = {r["id"]: r["near"] for r in neighbours.nearest(df, df, k, "x", keys=["k"], other="fold" if apart else None, value="v", report=report).collect()}
    for i in range(n):
        j = np.flatnonzero((key == key[i]) & ((fold != fold[i]) if apart else True))
        best = j[np.lexsort((j, d[i, j]))[:k]]
        assert [(m["id"], m["value"]) for m in got[i]] == [(int(b), float(b % 17)) for b in best]
        assert [m["distance"] for m in got[i]] == pytest.approx(d[i, best].tolist())
    assert 0 < report["compared"] <= report["possible"] and (block > 25 or report["compared"] < 0.8 * report["possible"])


def test_rows_without_a_vector(spark):
    rows = [(1, [0.0, 0.0]), (2, None), (3, [0.0, None]), (4, [float("nan"), 1.0]), (5, [3.0, 4.0]), (5, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, x array<double>")
    got = sorted((r["id"], None if r["near"] is None else [(m["id"], m["distance"]) for m in r["near"]]) for r in neighbours.nearest(df, df.where("id <> 2 and id < 5"), 2, "x").collect())
    assert got == [(1, [(1, 0.0)]), (2, None), (3, None), (4, None), (5, [(1, 1.0)]), (5, [(1, 5.0)])]
    assert all(r["near"] is None for r in neighbours.nearest(df, df.limit(0), 2, "x").collect()) and neighbours.nearest(df.limit(0), df, 2, "x").count() == 0


def test_pruned_cloud_equals_the_matrix_product(spark, monkeypatch):
    x, _, fold = cloud(3, 400)
    df = spark.createDataFrame([(i, v.tolist(), int(f)) for i, (v, f) in enumerate(zip(x, fold))], "id long, x array<double>, fold int")
    mean, std = aoa.statistics(df, "x")
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2))
    want = np.where(fold[:, None] == fold[None], np.inf, d).min(1)
    monkeypatch.setattr(aoa, "CLOUD_NUMBERS", 40)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 20)
    got = {r["id"]: r["nearest"] for r in aoa.nearest_distance(df, df, "x", mean, std, fold="fold").collect()}
    assert [got[i] for i in range(400)] == pytest.approx(want.tolist(), abs=1e-9)


def test_sampled_mean_distance(spark):
    x = np.random.default_rng(1).normal(0, 1, (3000, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    mean, std = aoa.statistics(df, "x")
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    whole = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2)).sum() / (3000 * 2999)
    m, error = aoa.sampled_mean_distance(df, "x", mean, std, 300)
    assert 0 < error < 0.1 * whole and abs(m - whole) < 4 * error
    again = aoa.sampled_mean_distance(df.repartition(7), "x", mean, std, 300)
    assert again[0] == pytest.approx(m) and again[1] == pytest.approx(error)
    exact, none = aoa.sampled_mean_distance(df.limit(200), "x", mean, std, 300)
    assert none == 0 and exact == pytest.approx(aoa.mean_distance(df.limit(200), "x", mean, std))


def brute_fill(v, hour, k=10, lags=24):
    """Mean of the nearest known rows in the space of lags, then linear interpolation, for one series of hours from 0."""
    n = len(v)
    feats = np.full((n, lags + 6), np.nan)
    for i in range(lags, n):
        day = v[max(0, i - 23) : i + 1]
        day = day[~np.isnan(day)]
        if len(day):
            at = np.datetime64("1970-01-01") + np.timedelta64(int(hour[i]), "h")
            doy = (at.astype("datetime64[D]") - at.astype("datetime64[Y]")).astype(int) + 1
            feats[i] = [*v[i - lags : i][::-1], hour[i] % 24, doy, at.astype("datetime64[M]").astype(int) % 12 + 1, day.mean(), day.std(ddof=1) if len(day) > 1 else 0, 6 <= hour[i] % 24 <= 20]
    whole, known = ~np.isnan(feats).any(1), ~np.isnan(v)
    train = np.flatnonzero(whole & known)
    out = v.copy()
    if len(train) >= 50:
        s = feats[train].std(0)
        z = (feats - feats[train].mean(0)) / np.where(s > 0, s, 1)
        kk = min(k, max(1, int(known.sum() * 0.1)))
        for i in np.flatnonzero(whole & ~known):
            d = np.sqrt(((z[train] - z[i]) ** 2).sum(1))
            out[i] = max(0.0, v[train[np.lexsort((train, d))[:kk]]].mean())
    have = np.flatnonzero(~np.isnan(out))
    return np.maximum(np.interp(np.arange(n), have, out[have]), 0)


def test_fill_in_lag_space(spark, monkeypatch):
    rng = np.random.default_rng(6)
    hour = np.arange(240)
    want, rows = {}, []
    for key in ("a", "b", "short"):
        v = 5 + 4 * np.sin(hour / 24 * 2 * np.pi) + rng.normal(0, 0.5, 240)
        v[rng.integers(30, 235, 6 if key != "short" else 60)] = np.nan
        want[key] = brute_fill(v, hour)
        rows += [(key, int(h), None if np.isnan(x) else float(x)) for h, x in zip(hour, v)]
    df = spark.createDataFrame(rows, "k string, t long, v double")
    for block in (4096, 30):
        monkeypatch.setattr(neighbours, "BLOCK_ROWS", block)
        rows = fill.nearest_in_lags(df, ["k"], "t", "v").orderBy("t").collect()
        for key in want:
            assert [r["filled"] for r in rows if r["k"] == key] == pytest.approx(want[key].tolist(), abs=1e-6)


def test_a_long_series_is_filled_in_bounded_tasks(spark):
    """One series of 60,000 rows, of which a tenth is missing; the blocks of a task hold 4,096 rows."""
    t = time.time()
    df = spark.range(60_000).select(F.lit(1).alias("k"), F.col("id").alias("t"), F.when((F.col("id") % 300 < 290), 5 + F.sin(F.col("id") / 5) + F.pmod(F.xxhash64("id"), F.lit(100)) / 100).alias("v"))
    got = fill.nearest_in_lags(df, ["k"], "t", "v").agg(F.count("filled"), F.max("filled")).first()
    assert got[0] == 60_000 and got[1] < 8 and time.time() - t < 240


@pytest.mark.parametrize("numbers", [10_000, 30])
def test_distances_in_tiles(spark, monkeypatch, numbers):
    """Equal vectors far from the mean are at distance 0, rows that lack a number find nothing, and no more than a tile of distances exists at once."""
    x = np.random.default_rng(4).normal(0, 1, (40, 3))
    x[:, 0] += 1e6
    rows = [(i, v.tolist(), i % 4) for i, v in enumerate(x)] + [(40 + i, v.tolist(), 9) for i, v in enumerate(x)] + [(90, None, 1), (91, [1.0, None, 2.0], 1)]
    df = spark.createDataFrame(rows, "id long, x array<double>, fold int")
    mean, std = np.zeros(3), np.ones(3)
    monkeypatch.setattr(aoa, "CLOUD_NUMBERS", numbers)
    monkeypatch.setattr(aoa, "TILE", (4, 5))
    got = {r["id"]: r["nearest"] for r in aoa.nearest_distance(df, df, "x", mean, std, fold="fold").collect()}
    assert got == {**{i: 0.0 for i in range(80)}, 90: None, 91: None}
    assert max(d.size for _, _, d in aoa._tiles(x, x)) == 20
    z = np.vstack([x, x])
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2))
    assert aoa.mean_distance(df, "x", mean, std) == pytest.approx(d.sum() / (80 * 79), rel=1e-4)
