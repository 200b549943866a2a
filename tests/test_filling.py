"""Back-tests, models of a series' own and seasonal decomposition, against brute force and known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import backtest, boosting, decompose, fill


def test_spans_are_apart_and_inside(spark):
    lengths = spark.createDataFrame([("a", 5), ("b", 6), ("c", 97), ("d", 1000)], "k string, n long")
    got = backtest.hidden_spans(lengths, ["k"], "n", [1, 2, 24], 3).collect()
    again = backtest.hidden_spans(lengths.repartition(3), ["k"], "n", [1, 2, 24], 3).collect()
    assert sorted(got) == sorted(again)
    n = {"a": 5, "b": 6, "c": 97, "d": 1000}
    by = {}
    for r in got:
        assert 0 <= r["start"] and r["start"] + r["size"] <= n[r["k"]]
        by.setdefault((r["k"], r["size"]), []).append(r["start"])
    for (k, size), starts in by.items():
        starts.sort()
        assert n[k] >= 3 * size and all(b - a >= 2 * size for a, b in zip(starts, starts[1:]))
        assert len(starts) == min(3, (n[k] - 2 * size) // (3 * size) + 1)
    assert ("a", 2) not in by and len(by["d", 24]) == 3
    assert len({tuple(sorted(s)) for (k, size), s in by.items() if k == "d"}) == 3  # sizes are drawn apart


def test_longest_segment_is_the_truth(spark):
    v = [1.0, None, 2.0, 3.0, None, 4.0, 5.0, None]
    df = spark.createDataFrame([("a", t, x) for t, x in enumerate(v)] + [("b", 0, None), ("b", 1, 7.0)], "k string, t long, v double")
    assert sorted(tuple(r) for r in backtest.truth_segments(df, ["k"], "t", "v").collect()) == [("a", 2, 2.0, 0), ("a", 3, 3.0, 1), ("b", 1, 7.0, 0)]
    assert backtest.truth_segments(df, ["k"], "t", "v", 2).select("k").distinct().count() == 1


def test_back_test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(5, 2, 60).round(3)
    seg = spark.createDataFrame([("a", i, float(x), i) for i, x in enumerate(v)], "k string, t long, v double, i int")
    spans = backtest.hidden_spans(spark.createDataFrame([("a", 60)], "k string, n long"), ["k"], "n", [2, 5], 3).collect()
    errors = {}
    for r in spans:
        w = v.copy()
        w[r["start"] : r["start"] + r["size"]] = np.nan
        have = np.flatnonzero(~np.isnan(w))
        f = np.maximum(np.interp(np.arange(60), have, w[have]), 0)
        errors.setdefault(r["size"], []).extend((f - v)[r["start"] : r["start"] + r["size"]])
    got = {(r["method"], r["size"]): r for r in backtest.run(seg, ["k"], "t", "v", [2, 5], 3, {"linear": fill.linear, "again": fill.linear}).collect()}
    for size, e in errors.items():
        for method in ("linear", "again"):
            assert got[method, size]["n_points"] == len(e) and got[method, size]["rmse"] == pytest.approx(np.sqrt(np.mean(np.square(e)))) and got[method, size]["mae"] == pytest.approx(np.mean(np.abs(e)))


def counted(spark, df):
    """``df`` with a count of the times its values are made."""
    made = spark.sparkContext.accumulator(0)

    def look(v):
        made.add(1)
        return v

    return df.select("k", "t", F.udf(look, "double")("v").alias("v")), made


def test_back_test_makes_its_series_once(spark):
    df = spark.createDataFrame([("a", t, float(t % 9)) for t in range(90)] + [("b", t, None if t == 4 else float(t)) for t in range(30)], "k string, t long, v double")
    seen, made = counted(spark, df)
    got = backtest.run(backtest.truth_segments(seen, ["k"], "t", "v"), ["k"], "i", "v", [2, 6], 2, {"linear": fill.linear, "nearest": fill.nearest}).collect()
    assert len(got) == 4 and 120 <= made.value <= 240  # a filter may look at the value once more


def brute_tree(binned, rest, depth, ridge=1.0):
    """One tree by trying every split of every node."""
    if depth == 0 or not len(rest):
        return (rest.sum() / (len(rest) + ridge),)
    best = None
    for f in range(binned.shape[1]):
        for b in range(boosting.BINS):
            left = binned[:, f] <= b
            if 0 < left.sum() < len(rest):
                gain = rest[left].sum() ** 2 / (left.sum() + ridge) + rest[~left].sum() ** 2 / ((~left).sum() + ridge)
                if gain > 0 and (best is None or gain > best[0] + 1e-12):
                    best = (gain, f, b)
    if best is None:
        return brute_tree(binned, rest, 0)
    _, f, b = best
    left = binned[:, f] <= b
    return f, b, brute_tree(binned[left], rest[left], depth - 1), brute_tree(binned[~left], rest[~left], depth - 1)


def brute_value(tree, row):
    while len(tree) == 4:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0]


@pytest.mark.parametrize("seed", range(3))
def test_boosted_trees_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (70, 3)).round(1)
    y = np.where(x[:, 0] > 0, 3.0, 0.0) + x[:, 1] ** 2 + rng.normal(0, 0.1, 70)
    model = boosting.fit(x, y, trees=4, depth=2)
    binned = boosting.bin_of(x, model.edges)
    want, rest = np.full(70, y.mean()), y - y.mean()
    for _ in range(4):
        tree = brute_tree(binned, rest, 2)
        step = 0.1 * np.array([brute_value(tree, r) for r in binned])
        want, rest = want + step, rest - step
    assert model.predict(x) == pytest.approx(want)
    assert np.corrcoef(boosting.fit(x, y).predict(x), y)[0, 1] > 0.97


def test_each_series_has_its_own_model(spark, monkeypatch):
    """Which rows are learned from, which are predicted, and which are interpolated."""
    rng = np.random.default_rng(8)
    rows, gaps = [], {"a": [60, 100, 101, 102, 150, 199], "b": [80, 120], "short": [26, 40]}
    made = {"a": lambda h: 10 + 5 * np.sin(h / 24 * 2 * np.pi), "b": lambda h: 3 - 2 * np.cos(h / 24 * 2 * np.pi), "short": lambda h: 1.0 + h}
    for k, f in made.items():
        for h in range(70 if k == "short" else 200):
            rows.append((k, h, None if h in gaps[k] else float(f(h) + rng.normal(0, 0.05))))
    df = spark.createDataFrame(rows, "k string, t long, v double")
    got = {(r["k"], r["t"]): r["filled"] for r in fill.by_own_model(df, ["k"], "t", "v").collect()}
    lin = {(r["k"], r["t"]): r["filled"] for r in fill.linear(df, ["k"], "t", "v").collect()}
    known = {(k, t): v for k, t, v in rows if v is not None}
    assert all(got[x] == pytest.approx(v) for x, v in known.items())
    for k in ("a", "b"):
        for h in gaps[k]:
            modelled = all(x not in gaps[k] for x in range(h - 24, h))  # all 24 lags known
            if modelled:
                assert got[k, h] != pytest.approx(lin[k, h], abs=1e-9) and abs(got[k, h] - made[k](h)) < 0.8
    assert got["a", 102] == pytest.approx(got["a", 100] + (known["a", 103] - got["a", 100]) * 2 / 3)  # lags missing: between what is there
    assert all(got["short", h] == pytest.approx(lin["short", h]) for h in gaps["short"])  # under fifty rows with all lags
    monkeypatch.setattr(fill, "TRAIN_ROWS", 60)
    monkeypatch.setattr(fill, "PREDICT_ROWS", 1)
    few = {(r["k"], r["t"]): r["filled"] for r in fill.by_own_model(df, ["k"], "t", "v").collect()}
    assert set(few) == set(got) and abs(few["a", 60] - made["a"](60)) < 2
    assert fill.by_own_model(df.limit(0), ["k"], "t", "v").count() == 0


def test_fill_by_own_model_makes_its_series_once(spark):
    df = spark.createDataFrame([("a", t, None if t % 41 == 40 else 5 + float(t % 24)) for t in range(200)] + [("b", t, float(t)) for t in range(20)], "k string, t long, v double")
    seen, made = counted(spark, df)
    got = {(r["k"], r["t"]): r["filled"] for r in fill.by_own_model(seen, ["k"], "t", "v").collect()}
    assert got == pytest.approx({(r["k"], r["t"]): r["filled"] for r in fill.by_own_model(df, ["k"], "t", "v").collect()}) and len(got) == 220
    assert made.value == 220


def wave(n, seed=0, period=24):
    t = np.arange(n)
    trend, season = 20 + 0.01 * t + 3 * np.sin(t / 200), 5 * np.sin(2 * np.pi * t / period)
    return trend, season, trend + season + np.random.default_rng(seed).normal(0, 0.05, n)


def test_decomposition_recovers_what_was_put_in():
    trend, season, y = wave(600)
    y[[50, 130, 131, 400, 555]] += [40, -30, 60, 25, -50]  # outliers leave trend and season alone
    t, s = decompose.decompose(y, 24)
    inner = slice(30, -30)
    assert np.abs(t - trend)[inner].max() < 0.25 and np.abs(s - season)[inner].max() < 0.25
    assert np.abs(y - t - s)[[50, 130, 131, 400, 555]].min() > 20
    line = 3.0 + 0.5 * np.arange(100)
    t, s = decompose.decompose(line, 7)
    assert t + s == pytest.approx(line) and np.abs(s).max() < 1e-6


def test_local_lines_against_least_squares():
    rng = np.random.default_rng(1)
    y, w = rng.normal(0, 1, (2, 15)), rng.random((2, 15))
    for span in (5, 7, 21):
        at = np.arange(-1, 16)
        got = decompose.local_lines(y, w, span, at)
        q = min(span, 15)
        for r in range(2):
            for k, x0 in enumerate(at):
                lo = int(np.clip(x0 - q // 2, 0, 15 - q))
                x = np.arange(lo, lo + q)
                h = max(x0 - lo, lo + q - 1 - x0) + max(0, (span - 15) // 2)
                far = np.abs(x - x0) / h
                k_w = np.sqrt(np.where(far > 0.999, 0, (1 - np.minimum(far, 1) ** 3) ** 3) * w[r, x])
                a = np.stack((np.ones(q), x - x0), 1) * k_w[:, None]
                assert got[r, k] == pytest.approx(np.linalg.lstsq(a, y[r, x] * k_w, rcond=None)[0][0])


def test_seasonal_fill(spark):
    trend, season, y = wave(400, 2)
    gaps = [*range(100, 112), 200, *range(300, 330), 399]
    rows = [("long", t, None if t in gaps else float(v)) for t, v in enumerate(y)] + [("short", t, None if t in (10, 11) else float(t)) for t in range(40)]
    df = spark.createDataFrame(rows, "k string, t long, v double")
    got = {(r["k"], r["t"]): r["filled"] for r in fill.seasonal(df, ["k"], "t", "v").collect()}
    assert max(abs(got["long", t] - trend[t] - season[t]) for t in gaps[:-1]) < 1.5 and got["long", 399] is not None
    rolled = {(r["k"], r["t"]): r["filled"] for r in fill.rolling_mean(df, ["k"], "t", "v").collect()}
    assert all(got["short", t] == pytest.approx(rolled["short", t]) for t in range(40))  # under two periods
    lin = {(r["k"], r["t"]): r["filled"] for r in fill.linear(df, ["k"], "t", "v").collect()}
    assert sum(abs(got["long", t] - trend[t] - season[t]) for t in gaps) < 0.5 * sum(abs(lin["long", t] - trend[t] - season[t]) for t in gaps)
    weekly = spark.createDataFrame([("d", t, None if t in (30, 31) else 5.0 + t % 7) for t in range(70)], "k string, t long, v double")
    assert {r["t"]: r["filled"] for r in fill.seasonal(weekly, ["k"], "t", "v", daily=True).collect()}[30] == pytest.approx(7, abs=0.2)


def test_pieces_of_a_long_series_fit_together(spark):
    _, _, y = wave(1500, 3, 7)
    df = spark.createDataFrame([("a", t, None if t % 97 < 3 else float(v)) for t, v in enumerate(y)], "k string, t long, v double")
    whole = {r["t"]: r["filled"] for r in fill.seasonal(df, ["k"], "t", "v", daily=True).collect()}
    parts = {r["t"]: r["filled"] for r in fill.seasonal(df, ["k"], "t", "v", daily=True, piece=300).collect()}
    assert max(abs(whole[t] - parts[t]) for t in whole) < 0.2  # of values around 20: a piece weighs outliers by its own median rest
