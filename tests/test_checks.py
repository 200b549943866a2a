"""Operators without SQL against brute force or known answers: samples, manifests, folds, groups, seasons and models."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import clean, split, windows
from gridloom.plans import ml
from gridloom.sources import io, vocabulary


def test_manifest_counts_and_checksums(spark):
    rows = [("a", 1, "x"), ("a", 2, None), ("b", 3, "y"), (None, 4, "z")]
    got = {r["k"]: (r["rows"], r["checksum"]) for r in io.manifest(spark.createDataFrame(rows, "k string, n int, s string").repartition(3), ["k"]).collect()}
    want = {}
    for r in rows:
        n, c = want.get(r[0], (0, 0))
        want[r[0]] = (n + 1, c + zlib.crc32("|".join(str(x) for x in r if x is not None).encode()))
    assert got == want


def test_hash_sample_is_repeatable_and_even(spark):
    df = spark.range(20_000).withColumn("v", F.col("id") * 2)
    a = sorted(r["id"] for r in clean.hash_sample(df, ["id"], 500, 7).collect())
    assert a == sorted(r["id"] for r in clean.hash_sample(df.repartition(9), ["id"], 500, 7).collect()) and len(set(a)) == 500
    assert a != sorted(r["id"] for r in clean.hash_sample(df, ["id"], 500, 8).collect())
    counts = np.histogram(a, 10, (0, 20_000))[0]
    assert counts.min() > 25 and counts.max() < 80
    assert clean.hash_sample(df.limit(30), ["id"], 500, 7).count() == 30


def test_phenology_of_a_known_curve(spark):
    day = np.arange(200)
    v = np.where((day >= 60) & (day < 140), 10.0, 2.0)
    df = spark.createDataFrame([("a", int(t), float(x)) for t, x in zip(day, v)], "k string, t long, v double")
    r = windows.phenology(df, ["k"], "t", "v").first()
    assert abs(r["above_start"] - 60) <= 1 and abs(r["above_end"] - 139) <= 1  # seven-day means cross half of the range there
    assert abs(r["rise"] - 60) <= 4 and abs(r["fall"] - 140) <= 4


def test_balanced_folds_against_the_greedy_rule(spark):
    rng = np.random.default_rng(0)
    rows = [(f"g{i:02d}", int(w)) for i, w in enumerate(rng.integers(1, 50, 23))]
    df = spark.createDataFrame([(g, 1) for g, w in rows for _ in range(w)], "g string, w int")
    load, want = [0] * 4, {}
    for g, w in sorted(rows, key=lambda x: (-x[1], x[0])):
        want[g] = int(np.argmin(load))
        load[want[g]] += w
    assert {r["g"]: r["fold"] for r in split.balanced_folds(df, "g", "w", 4).collect()} == want


def test_stratified_folds_keep_groups_and_share_labels(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), "rare" if g < 5 else "common") for g in rng.integers(0, 40, 900)]
    folds = {r["g"]: r["fold"] for r in split.stratified_folds(spark.createDataFrame(rows, "g int, label string"), "g", "label", 5).collect()}
    assert set(folds) == {g for g, _ in rows} and set(folds.values()) == set(range(5))
    assert sorted(folds[g] for g in range(5)) == list(range(5))  # the rare label's groups are spread
    sizes = np.bincount([folds[g] for g, _ in rows], minlength=5)
    assert sizes.max() < 1.5 * sizes.min()


def test_kmeans_finds_separate_groups(spark):
    rng = np.random.default_rng(2)
    centre = [(0, 0), (50, 100), (-40, 60), (30, -120)]
    rows = [(i, float(centre[i % 4][0] + rng.normal()), float(centre[i % 4][1] + rng.normal())) for i in range(80)]
    got = {r["id"]: r["grp"] for r in ml.kmeans_groups(spark.createDataFrame(rows, "id int, lat double, lon double"), 4).collect()}
    assert len(set(got.values())) == 4 and all(got[i] == got[i % 4] for i in got)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    data = [(i, float(a), float(b), float(c), float(10 * a + 3 * (b > 0.5) + rng.normal(0, 0.1)), i % 3) for i, (a, b, c) in enumerate(rng.random((240, 3)))]
    return spark.createDataFrame(data, "id int, a double, b double, c double, y double, fold int").coalesce(1).cache()


def test_out_of_fold_rows_come_from_models_that_did_not_see_them(rows):
    got = {r["id"]: r["prediction"] for r in ml.out_of_fold(rows, ["a", "b"], "y", "fold", 3, numTrees=3, maxDepth=3).collect()}
    for k in range(3):
        model = ml.fit(rows.where(F.col("fold") != k), ["a", "b"], "y", numTrees=3, maxDepth=3)
        own = {r["id"]: r["prediction"] for r in ml.predict(model, rows.where(F.col("fold") == k)).collect()}
        assert own == {i: got[i] for i in own}
    assert len(got) == 240


def test_search_returns_what_it_tried(spark, rows):
    tried = ml.search(rows, ["a", "b"], "y", "fold", 3, {"numTrees": [2, 4], "maxDepth": [1, 4]})
    assert [r["rank"] for r in tried] == [1, 2, 3, 4] and [r["error"] for r in tried] == sorted(r["error"] for r in tried)
    assert tried[0]["params"]["maxDepth"] == 4 and {tuple(sorted(r["params"].items())) for r in tried} == {(("maxDepth", d), ("numTrees", n)) for d in (1, 4) for n in (2, 4)}
    errors = []
    for k in range(3):
        p = ml.predict(ml.fit(rows.where(F.col("fold") != k), ["a", "b"], "y", **tried[0]["params"]), rows.where(F.col("fold") == k)).collect()
        errors.append(np.sqrt(np.mean([(r["y"] - r["prediction"]) ** 2 for r in p])))
    assert tried[0]["error"] == pytest.approx(np.mean(errors)) and tried[0]["deviation"] == pytest.approx(np.std(errors))
    drawn = ml.search(rows, ["a"], "y", "fold", 2, {"maxDepth": [1, 2, 3], "numTrees": [1, 2]}, draws=2, seed=5)
    assert len(drawn) == 2 and [r["params"] for r in drawn] == [r["params"] for r in ml.search(rows, ["a"], "y", "fold", 2, {"maxDepth": [1, 2, 3], "numTrees": [1, 2]}, draws=2, seed=5)]
    _, params, error = ml.grid_search(rows, ["a", "b"], "y", "fold", 3, [{"numTrees": 2, "maxDepth": 1}, {"numTrees": 2, "maxDepth": 4}])
    assert params == {"numTrees": 2, "maxDepth": 4} and error == pytest.approx(next(r["error"] for r in tried if r["params"] == params))
    assert ml.search_table(spark, tried).count() == 4


def test_search_reads_its_rows_once_however_many_settings(spark, rows):
    read = spark.sparkContext.accumulator(0)

    def look(y):
        read.add(1)
        return y

    df = rows.withColumn("y", F.udf(look, "double")("y"))
    tried = ml.search(df, ["a", "b"], "y", "fold", 3, {"numTrees": [1, 2], "maxDepth": [1, 2]})
    assert 240 <= read.value <= 720 and len(tried) == 4  # a filter may look at the label once more
    dealt = ml.search(rows.repartition(5), ["a", "b"], "y", "fold", 3, {"numTrees": [1, 2], "maxDepth": [1, 2]})
    assert [r["error"] for r in dealt] == pytest.approx([r["error"] for r in tried])


def test_trees_from_sums_by_vector(spark, rows, monkeypatch):
    """Boosted trees are those of the rows; a forest's samples draw each row a Poisson number of times."""
    few = rows.withColumn("a", F.round("a", 1)).withColumn("b", F.round("b", 1))
    sums = ml.fit(few, ["a", "b"], "y", "boosted", maxIter=3, maxDepth=3)
    monkeypatch.setattr(ml, "VECTORS", 0)
    whole = ml.fit(few, ["a", "b"], "y", "boosted", maxIter=3, maxDepth=3)
    one, other = ({r["id"]: r["prediction"] for r in ml.predict(m, few).collect()} for m in (sums, whole))
    assert len(one) == 240 and one == pytest.approx(other)
    big = spark.range(40_000).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("y"))
    got = ml.by_vector(big, ["a"], "y", [], 2).collect()
    assert sum(r["_n"] for r in got) == 40_000 and len(got) == 7
    assert all(abs(r[f"_w{t}"] / r["_n"] - 1) < 0.06 and abs(r[f"_s{t}"] / r[f"_w{t}"] - r["_y"]) < 0.2 for r in got for t in (0, 1)) and got[0]["_w0"] != got[0]["_w1"]
    times = np.bincount([r[0] for r in big.select(ml._drawn(F.xxhash64("id"))).collect()], minlength=4) / 40_000
    assert times[:4] == pytest.approx(np.exp(-1) / np.array([1, 1, 2, 6]), abs=0.01)


def test_forward_selection_takes_what_helps(rows):
    steps = ml.forward_selection(rows, {"noise": ["c"], "main": ["a"], "step": ["b"]}, [], "y", "fold", 3, numTrees=5, maxDepth=5)
    assert [s[0] for s in steps][:2] == ["main", "step"] and all(x[1] > y[1] for x, y in zip(steps, steps[1:]))


def test_batch_scoring_is_the_median_of_its_models(rows):
    models = {f"m{k}": ml.fit(rows, ["a", "b"], "y", numTrees=k, maxDepth=2) for k in (1, 2, 3)}
    got = ml.score(rows, models, ["id"]).collect()
    assert len(got) == 240 and all(r["ensemble"] == pytest.approx(np.median([r["m1"], r["m2"], r["m3"]])) for r in got)


def test_scoring_reads_its_rows_once(rows):
    models = {f"m{k}": ml.fit(rows, ["a", "b"], "y", "boosted", maxIter=k, maxDepth=2) for k in (1, 2)}
    holes = rows.withColumn("a", F.when(F.col("id") % 5 != 0, F.col("a"))).withColumn("b", F.when(F.col("id") % 7 != 0, F.col("b")).otherwise(float("nan")))
    scored = ml.score(holes, models, ["id"])
    assert "Union" not in scored._jdf.queryExecution().optimizedPlan().toString()
    full = {r["id"]: r for r in ml.score(rows, models, ["id"]).collect()}
    got = {r["id"]: r for r in scored.collect()}
    assert len(got) == 240 and all(r == full[i] if i % 5 and i % 7 else r["m1"] is r["m2"] is r["ensemble"] is None for i, r in got.items())


def test_header_and_grid_vocabularies(spark):
    df = spark.createDataFrame([("x", 1.0, 2.0, 3.0, 4)], "`SITE-code` string, Lat double, latitude double, `Elevation (m)` double, other int")
    assert vocabulary.standard_header(df, vocabulary.SITE).columns == ["si_code", "Lat", "si_lat", "si_elev", "other"]
    taken = df.withColumn("si_elev", F.lit(0.0))
    assert "Elevation (m)" in vocabulary.standard_header(taken, vocabulary.SITE).columns
    g = spark.createDataFrame([(1.0, 5, 1, 0, 280.0), (1.0, 5, 5, 0, 281.0), (1.0, 5, 5, 1, 290.0), (2.0, 5, 1, 0, 270.0)], "lat double, valid_time long, expver int, number int, T2M double")
    out = vocabulary.standard_grid(g)
    assert sorted(out.columns) == ["2m_temperature", "latitude", "time"] and [tuple(r) for r in out.collect()] == [(1.0, 5, 281.0)]


def test_bearing_search_against_walking_the_circles(spark):
    """The first known cell on circles of growing radius, eight bearings each, the point's own cell first."""
    import math

    from gridloom.operators import joins

    rng = np.random.default_rng(9)
    cells = {(float(a), float(o)): float(rng.random()) for a, o in {(int(x), int(y)) for x, y in rng.integers(-6, 7, (40, 2))}}
    points = [(i, float(a), float(o)) for i, (a, o) in enumerate(rng.uniform(-6, 6, (30, 2)))]

    def walk(lat, lon, km, bearing):
        d, a, b = km / 6371, math.radians(lat), math.radians(bearing)
        y = math.asin(math.sin(a) * math.cos(d) + math.cos(a) * math.sin(d) * math.cos(b))
        x = math.radians(lon) + math.atan2(math.sin(b) * math.sin(d) * math.cos(a), math.cos(d) - math.sin(a) * math.sin(y))
        return math.degrees(y), math.degrees(x)

    radii = (60.0, 150.0, 300.0)
    got = {r["id"]: (r["v"], r["km"]) for r in joins.bearing_search(spark.createDataFrame(points, "id int, lat double, lon double"), spark.createDataFrame([(a, o, v) for (a, o), v in cells.items()], "clat double, clon double, v double"), ["id"], 1.0, radii, 8, "v").collect()}
    for i, lat, lon in points:
        want = (None, None)
        for km, bearing in [(0.0, 0.0)] + [(r, 45.0 * b) for r in radii for b in range(8)]:
            a, o = walk(lat, lon, km, bearing)
            if (v := cells.get((float(round(a)), float(round(o))))) is not None:
                want = (v, km)
                break
        assert got[i] == want
