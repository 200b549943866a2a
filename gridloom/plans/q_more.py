"""Queries that put several operators together: point sampling, applicability of a model, grid feature tables, calibration curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import scalars
from gridloom.operators import aoa, fill, joins, split
from gridloom.sources.shared import kept

from .base import GRID, OBS, grid, near, obs, query, rounded, table
from .q_grid import _SC, _STD, _sc, _vectors
from .q_misc import _SITES, _sites


@query("b31_region_extraction", f"WITH {GRID} SELECT product, lat, lon, day, v FROM grid WHERE lat BETWEEN -30 AND 30 AND lon BETWEEN -60 AND 90 AND day // 7 = 2818")
def b31(spark, d):
    return grid(spark, d).where("lat between -30 and 30 and lon between -60 and 90 and day div 7 = 2818")


@query("c12_nearest_grid_point", f"WITH {_SITES}, n AS (SELECT id, least(greatest(ceil((lat + 89.75) / 2.5 - 0.5), 0), 71) AS i, least(greatest(ceil(((lon + 360) % 360) / 2.5 - 0.5), 0), 143) AS j FROM sites) SELECT id, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(-89.75 + i * 2.5, 3) AS glat, round(j * 2.5, 3) AS glon FROM n")
def c12(spark, d):
    return rounded(joins.nearest_grid_point(_sites(spark, d), (-89.75, 2.5, 72), (0.0, 2.5, 144)).select("id", "i", "j", "glat", "glon"), 3)


@query("c14_bearing_search")
def c14(spark, d):
    cells = grid(spark, d).groupBy(F.col("lat").alias("clat"), F.col("lon").alias("clon")).agg(F.max("v").alias("v"))
    return rounded(joins.bearing_search(_sites(spark, d), cells, ["id"], 1.0, (60.0, 120.0, 240.0), 8, "v").select("id", "v", "km"))


@query("c27_monthly_layer", f"WITH {GRID}, w AS (SELECT lat, lon, day // 7 AS wk, avg(v) AS lai FROM grid WHERE product = 'click' GROUP BY 1, 2, 3), g AS (SELECT lat, lon, day, day // 7 AS wk, v FROM grid WHERE product = 'view') SELECT g.lat, g.lon, g.day, round(w.lai, 4) AS lai FROM g ASOF LEFT JOIN w ON g.lat = w.lat AND g.lon = w.lon AND g.wk >= w.wk")
def c27(spark, d):
    k = grid(spark, d)
    layer = k.where("product = 'click'").groupBy("lat", "lon", F.expr("day div 7").alias("wk")).agg(F.avg("v").alias("lai"))
    cells = k.where("product = 'view'").select("lat", "lon", "day", F.expr("day div 7").alias("wk"))
    return rounded(joins.asof(cells, layer, ["lat", "lon"], "wk", ["lai"], "backward").select("lat", "lon", "day", "lai"))


@query("c30_point_sampled_features", f"""WITH {GRID}, {_SITES}, c AS (SELECT DISTINCT lat AS clat, lon AS clon FROM grid WHERE product = 'view'), m AS (SELECT id, clat, clon, row_number() OVER (PARTITION BY id ORDER BY round(pow(lat - clat, 2) + pow(lon - clon, 2), 9), clat, clon) AS r FROM sites JOIN c ON abs(lat - clat) <= 10 AND abs(lon - clon) <= 10 WHERE pow(lat - clat, 2) + pow(lon - clon, 2) <= 100)
 SELECT id, day, v FROM m JOIN grid g ON r = 1 AND g.product = 'view' AND g.lat = clat AND g.lon = clon""")
def c30(spark, d):
    k = grid(spark, d).where("product = 'view'")
    near = joins.nearest_cell(_sites(spark, d), k.select(F.col("lat").alias("clat"), F.col("lon").alias("clon")).distinct(), ["id"], 1.0, 10.0, [])
    return near.select("id", F.col("clat").alias("lat"), F.col("clon").alias("lon")).join(k, ["lat", "lon"]).select("id", "day", "v")


@query("d76_mean_pairwise_distance", f"WITH {_STD} SELECT round(avg(list_distance(a.x, b.x)), 3) AS d_bar FROM z a JOIN z b ON a.id < b.id")
def d76(spark, d):
    v = _vectors(spark, d)
    return spark.createDataFrame([(round(aoa.mean_distance(v, "x", *aoa.statistics(v, "x")) + 1e-9, 3),)], "d_bar double")


@query("d76_sampled_mean_distance")
def d76_sampled(spark, d):
    v = _vectors(spark, d)
    m, e = aoa.sampled_mean_distance(v, "x", *aoa.statistics(v, "x"), sample=500)
    return spark.createDataFrame([(round(m, 3), round(e, 3))], "d_bar double, error double")


_DIX = f"{_STD}, db AS (SELECT avg(list_distance(a.x, b.x)) AS d FROM z a JOIN z b ON a.id < b.id), di AS (SELECT a.id, min(list_distance(a.x, b.x)) / (SELECT d FROM db) AS di FROM z a JOIN z b ON a.fold <> b.fold GROUP BY 1)"


def _di(spark, d):
    v = _vectors(spark, d)
    m, s = aoa.statistics(v, "x")
    d_bar = aoa.mean_distance(v, "x", m, s)
    di = kept(aoa.nearest_distance(v, v, "x", m, s, fold="fold").select("id", (F.col("nearest") / d_bar).alias("di")), "di")
    return v, m, s, d_bar, di


@query("d77_training_di", f"WITH {_DIX} SELECT id, round(di, 3) AS di FROM di")
def d77(spark, d):
    return rounded(_di(spark, d)[-1], 3)


@query("d79_prediction_di", f"WITH {_DIX}, t AS (SELECT quantile_cont(di, 0.75) + 1.5 * (quantile_cont(di, 0.75) - quantile_cont(di, 0.25)) AS t FROM di), p AS (SELECT a.id, min(list_distance(list_transform(a.x, lambda e: e * 1.3), b.x)) / (SELECT d FROM db) AS di FROM z a JOIN z b ON b.id % 3 = 0 WHERE a.id % 3 <> 0 GROUP BY 1) SELECT id, round(di, 3) AS di, di <= t AS inside FROM p, t")
def d79(spark, d):
    v, m, s, d_bar, di = _di(spark, d)
    # features pushed away from the cloud: scaled by 1.3 after standardising
    far = v.where("id % 3 <> 0").withColumn("x", F.zip_with("x", F.zip_with(F.array(*map(F.lit, m.tolist())), F.array(*map(F.lit, s.tolist())), lambda a, b: F.struct(a.alias("m"), b.alias("s"))), lambda x, c: c.m + 1.3 * (x - c.m)))
    p = aoa.nearest_distance(far, v.where("id % 3 = 0"), "x", m, s).select("id", (F.col("nearest") / d_bar).alias("di"))
    return rounded(p.crossJoin(F.broadcast(aoa.threshold(di))).select("id", "di", (F.col("di") <= F.col("threshold")).alias("inside")), 3)


@query("d82_reference_build", f"WITH {_DIX} SELECT count(*) AS n, (SELECT round(d, 3) FROM db) AS d_bar, round(quantile_cont(di, 0.75) + 1.5 * (quantile_cont(di, 0.75) - quantile_cont(di, 0.25)), 3) AS threshold, round(min(di), 3) AS min_di FROM di")
def d82(spark, d):
    v, _, _, d_bar, di = _di(spark, d)
    one = di.agg(F.count("*").alias("n"), F.min("di").alias("min_di")).withColumn("d_bar", F.lit(d_bar))
    return rounded(one.crossJoin(aoa.threshold(di)).select("n", "d_bar", "threshold", "min_di"), 3)


@query("d83_training_matrix", f"WITH {_SITES}, g AS (SELECT id, CAST(dense_rank() OVER (ORDER BY floor((lat - (SELECT min(lat) FROM sites)) / 20), floor((lon - (SELECT min(lon) FROM sites)) / 20)) AS INT) AS grp FROM sites) SELECT l_orderkey, l_linenumber, grp, l_quantity, CAST(l_returnflag = 'A' AS INT) AS flag_a, CAST(l_returnflag = 'N' AS INT) AS flag_n FROM lineitem JOIN g ON l_suppkey = id WHERE l_quantity > 10 AND l_tax > 0")
def d83(spark, d):
    g = split.grid_groups(_sites(spark, d), 20.0).select(F.col("id").alias("l_suppkey"), "grp")
    li = table(spark, d, "lineitem").where("l_quantity > 10 and l_tax > 0")
    flags = [(F.col("l_returnflag") == k).cast("int").alias(f"flag_{k.lower()}") for k in ("A", "N")]
    return li.join(joins.small(g), "l_suppkey").select("l_orderkey", "l_linenumber", "grp", "l_quantity", *flags)


@query("d89_grid_feature_table", f"""WITH {GRID}, st AS (SELECT DISTINCT lat, lon, CAST(lat + lon AS BIGINT) % 3 AS pft FROM grid WHERE product = 'click'), acc AS (SELECT lat, lon, day - 1 AS day, v AS rain FROM grid WHERE product = 'click')
 SELECT g.lat, g.lon, g.day, g.v AS ta, coalesce(rain, 0) AS rain, CAST(pft = 0 AS INT) AS pft_a, CAST(pft = 1 AS INT) AS pft_b, round(sin(2 * pi() * (g.day % 365) / 365.25), 5) AS year_sin FROM grid g JOIN st ON g.lat = st.lat AND g.lon = st.lon LEFT JOIN acc ON acc.lat = g.lat AND acc.lon = g.lon AND acc.day = g.day WHERE product = 'view' AND pft IN (0, 1)""")
def d89(spark, d):
    k = grid(spark, d)
    static = k.where("product = 'click'").select("lat", "lon").distinct().withColumn("pft", (F.col("lat") + F.col("lon")).cast("long") % 3)
    rain = k.where("product = 'click'").select("lat", "lon", (F.col("day") - 1).alias("day"), F.col("v").alias("rain"))
    j = k.where("product = 'view'").select("lat", "lon", "day", F.col("v").alias("ta")).join(static, ["lat", "lon"]).join(rain, ["lat", "lon", "day"], "left")
    year_sin, _ = scalars.cyclic(F.col("day") % 365, 365.25)
    out = j.select("lat", "lon", "day", "ta", F.coalesce("rain", F.lit(0.0)).alias("rain"), *((F.col("pft") == i).cast("int").alias(f"pft_{n}") for i, n in ((0, "a"), (1, "b"))), year_sin.alias("year_sin")).where("pft_a + pft_b = 1")
    return out.withColumn("year_sin", near("year_sin", 5))


@query("f15_bin_calibration", f"WITH {_SC}, b AS (SELECT CAST(floor(q / 5) AS BIGINT) AS bin, avg(disc) AS y FROM sc GROUP BY 1) SELECT id, round(y, 5) AS calibrated FROM sc JOIN b ON bin = CAST(floor(q / 5) AS BIGINT)")
def f15(spark, d):
    s = _sc(spark, d).withColumn("bin", F.floor(F.col("q") / 5))
    curve = s.groupBy("bin").agg(F.avg("disc").alias("y")).withColumn("k", F.lit(1))
    # empty bins between full ones take their neighbours' line
    full = fill.interpolate_time(joins.forward_fill(curve.select("k", "bin", "y"), ["k"], "bin", ["y"], 1), ["k"], "bin", "y").select("bin", "y")
    return rounded(s.join(F.broadcast(full), "bin").select("id", F.col("y").alias("calibrated")), 5)


@query("g1_sorted_shift", f"WITH {OBS} SELECT event_id, lag(event_id) OVER (PARTITION BY sensor ORDER BY sec, event_id) AS previous FROM obs")
def g1(spark, d):
    from pyspark.sql import Window

    return obs(spark, d).select("event_id", F.lag("event_id").over(Window.partitionBy("sensor").orderBy("sec", "event_id")).alias("previous"))


@query("h3_component_extremes", f"WITH {_SC} SELECT id, round(sqrt(pow(greatest(abs(t), abs(t - 3)), 2) + pow(greatest(abs(dew), abs(dew - 2)), 2)), 4) AS ws_max, round(greatest(0.6108 * exp(17.27 * (t + 5) / (t + 5 + 237.3)) - 0.6108 * exp(17.27 * least(dew, t + 5) / (least(dew, t + 5) + 237.3)), 0), 4) AS vpd_max FROM sc")
def h3(spark, d):
    hi = lambda a, b: F.greatest(F.abs(a), F.abs(b))
    ws = scalars.wind_speed(hi(F.col("t"), F.col("t") - 3), hi(F.col("dew"), F.col("dew") - 2))
    return rounded(_sc(spark, d).select("id", ws.alias("ws_max"), scalars.vapour_deficit(F.col("t") + 5, F.col("dew")).alias("vpd_max")))


@query("h15_interaction_features", f"WITH {_SC} SELECT id, round(q * disc, 5) AS vpd_x_rad, round(q * q, 4) AS q_squared, round(ln(1 + tax), 6) AS log_tax, round(greatest(t - 5, 0), 4) AS degree_days, round(q * (1 - exp(-0.5 * disc * 10)), 4) AS absorbed FROM sc")
def h15(spark, d):
    q, disc, tax, t = (F.col(c) for c in ("q", "disc", "tax", "t"))
    s = _sc(spark, d).select("id", (q * disc).alias("vpd_x_rad"), (q * q).alias("q_squared"), F.log1p(tax).alias("log_tax"), F.greatest(t - 5, F.lit(0.0)).alias("degree_days"), (q * (1 - F.exp(-0.5 * disc * 10))).alias("absorbed"))
    return s.select("id", F.round(F.col("vpd_x_rad") + 1e-9, 5).alias("vpd_x_rad"), F.round(F.col("q_squared") + 1e-9, 4).alias("q_squared"), F.round(F.col("log_tax") + 1e-9, 6).alias("log_tax"), F.round(F.col("degree_days") + 1e-9, 4).alias("degree_days"), F.round(F.col("absorbed") + 1e-9, 4).alias("absorbed"))


@query("k13_feature_matrix", f"WITH {_SC}, {_SITES}, g AS (SELECT id AS site, CAST(dense_rank() OVER (ORDER BY floor((lat - (SELECT min(lat) FROM sites)) / 20), floor((lon - (SELECT min(lon) FROM sites)) / 20)) AS INT) AS grp, cls FROM sites) SELECT l_orderkey * 10 + l_linenumber AS id, grp, cls, l_quantity AS q, round(ln(1 + l_extendedprice), 5) AS target FROM lineitem JOIN g ON l_suppkey = site WHERE l_discount > 0")
def k13(spark, d):
    g = split.grid_groups(_sites(spark, d), 20.0).select(F.col("id").alias("l_suppkey"), "grp", "cls")
    li = table(spark, d, "lineitem").where("l_discount > 0").join(joins.small(g), "l_suppkey")
    return rounded(li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "grp", "cls", F.col("l_quantity").alias("q"), scalars.transforms(F.col("l_extendedprice"))["log1p"].alias("target")), 5)

