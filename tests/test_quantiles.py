"""Exact quantiles against Spark's own percentile."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import aoa, quantiles, stats

PROBS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]


def made(spark, n=4000):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        k = ["hot", "warm", "ties", None][int(rng.choice(4, p=[0.5, 0.2, 0.25, 0.05]))]
        v = {"hot": rng.lognormal(0, 3), "warm": rng.normal(), "ties": float(rng.integers(3)), None: -1e300 * rng.random()}[k]
        rows.append((k, None if rng.random() < 0.05 else float(v)))
    return spark.createDataFrame([*rows, ("none", None), ("one", 7.5), ("nan", float("nan")), ("nan", 1.0)], "k string, v double").repartition(5)


@pytest.mark.parametrize("buckets,limit", [(256, 20_000), (4, 5), (8, 1)])
def test_equal_to_percentile(spark, monkeypatch, buckets, limit):
    """One look at the values, or several rounds of coarse histograms: the same."""
    monkeypatch.setattr(quantiles, "BUCKETS", buckets)
    monkeypatch.setattr(quantiles, "LIMIT", limit)
    df = made(spark)
    clean = df.withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    want = {r["k"]: (r["n"], r["q"]) for r in clean.groupBy("k").agg(F.count("v").alias("n"), F.expr(f"percentile(v, array({', '.join(map(str, PROBS))}))").alias("q")).collect()}
    got = {r["k"]: (r["n"], r["quantiles"]) for r in quantiles.exact_quantiles(df, "v", PROBS, ["k"]).collect()}
    assert set(got) == set(want)
    for k, (n, q) in want.items():
        assert got[k][0] == n and (got[k][1] is None if q is None else got[k][1] == pytest.approx(q, rel=1e-12))
    whole = quantiles.exact_quantiles(df.where("k = 'hot'"), "v", PROBS).first()
    assert whole["quantiles"] == pytest.approx(want["hot"][1], rel=1e-12)


def test_empty_table(spark):
    e = made(spark).limit(0)
    assert quantiles.exact_quantiles(e, "v", [0.5], ["k"]).count() == 0
    r = quantiles.exact_quantiles(e, "v", [0.5]).collect()
    assert len(r) == 1 and (r[0]["n"], r[0]["quantiles"]) == (0, None)


def test_large_groups_take_the_histograms(spark, monkeypatch):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4, 10]], "di double")
    cells = made(spark).where("not isnan(v)")
    plain = {r["k"]: r.asDict() for r in stats.describe(cells, ["k"], "v").collect()}
    assert aoa.threshold(df).first()["threshold"] == 4 + 1.5 * 2
    monkeypatch.setattr(quantiles, "ONE_TASK", 3)
    assert aoa.threshold(df).first()["threshold"] == 4 + 1.5 * 2
    for r in stats.describe(cells, ["k"], "v").collect():
        assert all(r[c] == plain[r["k"]][c] or r[c] == pytest.approx(plain[r["k"]][c], rel=1e-12) for c in ("n", "p01", "median", "p99", "iqr"))
