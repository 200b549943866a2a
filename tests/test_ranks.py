"""Distributed numbering and the sliding ordered window against plain computation."""

import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.operators import ranks, sliding, split, windows


def test_row_numbers(spark):
    rows = [(["a", "b", None][i % 3] if i > 40 else "a", (i * 37) % 101 if i % 11 else None) for i in range(200)]
    df = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(rows)], "k string, v int, id int").repartition(5)
    got = ranks.row_numbers(df, ["k"], ["v", "id"]).collect()
    by = {}
    for r in got:
        by.setdefault(r["k"], []).append(r)
    assert len(got) == 200 and set(by) == {"a", "b", None}
    for own in by.values():
        want = sorted(own, key=lambda r: (r["v"] is not None, r["v"] or 0, r["id"]))
        assert [r["row"] for r in want] == list(range(1, len(own) + 1)) and all(r["_n"] == len(own) for r in own)
    assert ranks.row_numbers(df.limit(0), ["k"], ["v"]).count() == 0


def test_dense_ranks_use_no_single_task(spark):
    df = spark.createDataFrame([(float(i % 7), i % 3 if i % 5 else None) for i in range(90)], "a double, b int")
    want = {v: i + 1 for i, v in enumerate(sorted({(r["a"], r["b"]) for r in df.collect()}, key=lambda v: (v[0], v[1] is not None, v[1] or 0)))}
    out = ranks.dense_ranks(df, ["a", "b"], "grp")
    assert all(r["grp"] == want[r["a"], r["b"]] for r in out.collect()) and out.count() == 90
    sites = spark.createDataFrame([(i, float(i * 13 % 50), float(i * 7 % 90)) for i in range(60)], "id int, lat double, lon double")
    low, west = min(i * 13 % 50 for i in range(60)), min(i * 7 % 90 for i in range(60))
    cells = sorted({((i * 13 % 50 - low) // 20, (i * 7 % 90 - west) // 20) for i in range(60)})
    assert {r["id"]: r["grp"] for r in split.grid_groups(sites, 20.0).collect()} == {i: cells.index(((i * 13 % 50 - low) // 20, (i * 7 % 90 - west) // 20)) + 1 for i in range(60)}


def test_class_split_shares(spark):
    ids = spark.createDataFrame([(i, "ab"[i % 5 == 0]) for i in range(200)], "id int, label string")
    for label in (None, "label"):
        got = split.class_split(ids, "id", label, {"train": 0.5, "valid": 0.1, "test": 0.4}, F.col("id")).collect()
        for part in {r["label"] if label else "" for r in got}:
            own = sorted((r for r in got if not label or r["label"] == part), key=lambda r: r["id"])
            p = [i / (len(own) - 1) for i in range(len(own))]
            assert [r["part"] for r in own] == ["train" if x < 0.5 else "valid" if x < 0.6 else "test" for x in p]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.just(float("nan")), st.integers(-5, 5).map(float), st.floats(-1e6, 1e6)), min_size=1, max_size=60), st.integers(1, 30))
def test_order_statistics_of_a_window(values, width):
    v = np.array(values)
    i = np.arange(len(v))
    lo, hi = sliding.centred_bounds(i, len(v), width)
    med, dev, q = sliding.slide(v, lo, hi, [lambda w: w.quantile(0.5), sliding.Sorted.deviation, lambda w: w.quantile(0.1)])
    for k in range(len(v)):
        own = v[lo[k] : hi[k]]
        own = own[~np.isnan(own)]
        if len(own):
            assert med[k] == pytest.approx(np.median(own)) and dev[k] == pytest.approx(np.median(np.abs(own - np.median(own))), abs=1e-9) and q[k] == pytest.approx(np.quantile(own, 0.1))
        else:
            assert np.isnan([med[k], dev[k], q[k]]).all()


@pytest.mark.parametrize("piece", [None, 10])
def test_pieces_equal_the_whole(spark, piece):
    rng = np.random.default_rng(2)
    rows = [(k, t, None if rng.random() < 0.2 else float(rng.normal() * (20 if rng.random() < 0.05 else 1))) for k, n in (("a", 95), ("b", 7), ("c", 1)) for t in range(n)]
    df = spark.createDataFrame(rows, "k string, t long, v double")
    got = {(r["k"], r["t"]): r["outlier"] for r in windows.outliers_mad(df, ["k"], "t", "v", 9, 3.0, piece=piece).collect()}
    for k in "abc":
        v = np.array([np.nan if x[2] is None else x[2] for x in rows if x[0] == k])
        for i in range(len(v)):
            lo, hi = (int(x[0]) for x in sliding.centred_bounds(np.array([i]), len(v), 9))
            own = v[lo:hi][~np.isnan(v[lo:hi])]
            m = np.median(own) if len(own) else np.nan
            assert got[k, i] == bool(abs(v[i] - m) > 3 * np.median(np.abs(own - m)) / 0.6745 if len(own) else False)


def test_a_long_series_slides_in_pieces(spark):
    """40,000 rows of one series at width 720: five pieces, a row costs microseconds."""
    df = spark.range(40_000).select(F.lit("s").alias("k"), F.col("id").alias("t"), (F.sin(F.col("id") / 50) + F.pmod(F.xxhash64("id"), F.lit(1000)) / 500 + F.when(F.col("id") % 997 == 0, 50).otherwise(0)).alias("v"))
    t = time.time()
    found = windows.outliers_mad(df, ["k"], "t", "v", 720, 5.0).where("outlier").count()
    assert found == 41 and time.time() - t < 30


def test_short_series_are_worked_on_as_they_lie(spark):
    """Series of at most a piece need no numbers and no join, and give what pieces give; a null key is a series too."""
    from gridloom.operators import ranks

    rows = [(k, t, None if t % 5 == 3 else float(t * t % 11), f"{k}{t}") for k in ("a", "b", None) for t in range(30)]
    df = spark.createDataFrame(rows, "k string, t long, v double, note string")

    def run(values, place, lo, hi, n):
        v = np.nan_to_num(values["v"])
        return {"s": np.array([v[max(0, i - 2) : i + 3].sum() + n for i in range(lo, hi)])}

    whole, cut = (ranks.over_pieces(df, ["k"], "t", ["v"], 2, run, "s double", p) for p in (30, 7))
    assert "Join" not in whole._jdf.queryExecution().toString() and "Join" in cut._jdf.queryExecution().toString()
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, cut.collect())) and whole.count() == 90
