"""Queries over predictions, gridded products and feature vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import scalars
from gridloom.operators import aoa, grid as g, joins, skill

from .base import DAILY, GRID, OBS, SCORED, daily, grid, obs, query, rounded, scored, table

_SUMS = f"""{SCORED}, sums AS (SELECT method, grp, size, rep, count(*) AS n_points, sum((y - yhat) * (y - yhat)) AS ss_res, sum(abs(y - yhat)) AS sum_abs_err, sum(y) AS sum_true, sum(y * y) AS sum_true_sq FROM scored GROUP BY 1, 2, 3, 4)"""
_POOL = "count(*) AS reps, sum(n_points) AS np, sum(ss_res) AS ss, sum(sum_abs_err) AS sa, sum(sum_true) AS st, sum(sum_true_sq) AS sq"
_SKILL = f"{_SUMS}, p AS (SELECT method, size, {_POOL} FROM sums GROUP BY 1, 2), pooled AS (SELECT method, size, CAST(np AS BIGINT) AS n_points, CASE WHEN sq - st * st / np > 1e-12 THEN 1 - ss / (sq - st * st / np) END AS r2, sqrt(ss / np) AS rmse, sa / np AS mae FROM p)"


def _sums(spark, d):
    return skill.error_sums(scored(spark, d), ["method", "grp", "size", "rep"])


def _pooled(spark, d):
    return skill.pooled(_sums(spark, d), ["method", "size"])


@query("d33_error_sums", f"WITH {_SUMS} SELECT method, grp, size, rep, n_points, round(ss_res, 2) AS ss_res, round(sum_abs_err, 2) AS sum_abs_err, round(sum_true, 2) AS sum_true, round(sum_true_sq, 1) AS sum_true_sq FROM sums")
def d33(spark, d):
    s = _sums(spark, d)
    return rounded(s.withColumn("sum_true_sq", F.round(F.col("sum_true_sq") + 1e-9, 1)), 2)


@query("d34_pooled_metrics", f"WITH {_SKILL} SELECT method, size, n_points, round(r2, 4) AS r2, round(rmse, 4) AS rmse, round(mae, 4) AS mae FROM pooled")
def d34(spark, d):
    return rounded(_pooled(spark, d))


@query("d35_benchmark_ranking", f"WITH {_SKILL} SELECT * FROM (SELECT method, size, round(rmse, 4) AS rmse, row_number() OVER (PARTITION BY size ORDER BY -rmse DESC, method) AS rank FROM pooled) WHERE rank <= 2")
def d35(spark, d):
    r = skill.rank_methods(_pooled(spark, d).withColumn("score", -F.col("rmse")), ["size"], "method", "score", 2)
    return rounded(r.select("method", "size", "rmse", F.col("rank").cast("long").alias("rank")))


@query("d36_reliability_threshold", f"WITH {_SKILL}, b AS (SELECT size, min(mae) AS best FROM pooled GROUP BY 1) SELECT min(size) FILTER (best > 25) AS threshold FROM b")
def d36(spark, d):
    return skill.reliability_threshold(_pooled(spark, d).withColumn("score", -F.col("mae")).withColumn("k", F.lit(1)), ["k"], "size", "score", -25.0).select("threshold")


@query("f10_select_method", f"WITH {_SKILL}, ok AS (SELECT method, max(size) AS max_size FROM pooled WHERE -mae >= -40 AND size <= 4 GROUP BY 1) SELECT method, max_size FROM ok ORDER BY max_size DESC, method LIMIT 1")
def f10(spark, d):
    return skill.select_method(_pooled(spark, d).withColumn("score", -F.col("mae")).withColumn("k", F.lit(1)), ["k"], "method", "size", "score", -40.0, 4).select("method", "max_size")


_G = "count(*) AS n, round(CASE WHEN var_pop(y) > 0 THEN 1 - avg((yhat - y) * (yhat - y)) / var_pop(y) END, 4) AS r2, round(sqrt(avg((yhat - y) * (yhat - y))), 4) AS rmse, round(avg(abs(yhat - y)), 4) AS mae, round(avg(yhat - y), 4) AS bias, round(avg(y), 4) AS mean_true, round(avg(yhat), 4) AS mean_pred"


@query("d37_metrics_by_group", f"WITH {SCORED} SELECT site, {_G} FROM scored GROUP BY 1 HAVING count(*) >= 10")
def d37(spark, d):
    return rounded(skill.by_group(scored(spark, d), ["site"]))


@query("d38_worst_sites", f"WITH {SCORED}, m AS (SELECT site, {_G} FROM scored GROUP BY 1 HAVING count(*) >= 10) SELECT site, rmse FROM m ORDER BY rmse DESC, site LIMIT 10")
def d38(spark, d):
    return rounded(skill.by_group(scored(spark, d), ["site"])).select("site", "rmse").orderBy(F.desc("rmse"), "site").limit(10)


@query("d39_fold_mean_and_pooled", f"WITH {SCORED}, f AS (SELECT fold, sqrt(avg((y - yhat) * (y - yhat))) AS rmse FROM scored GROUP BY 1) SELECT round(avg(rmse), 4) AS mean_rmse, round(stddev_pop(rmse), 4) AS std_rmse, (SELECT round(sqrt(avg((y - yhat) * (y - yhat))), 4) FROM scored) AS pooled_rmse FROM f")
def d39(spark, d):
    sums = skill.error_sums(scored(spark, d), ["fold"])
    a = sums.agg(F.avg(F.sqrt(F.col("ss_res") / F.col("n_points"))).alias("mean_rmse"), F.stddev_pop(F.sqrt(F.col("ss_res") / F.col("n_points"))).alias("std_rmse"), F.sqrt(F.sum("ss_res") / F.sum("n_points")).alias("pooled_rmse"))
    return rounded(a)


@query("d40_efficiency", f"""WITH {SCORED}, e AS (SELECT method, corr(y, yhat) AS r, stddev_pop(yhat) / stddev_pop(y) AS alpha, avg(yhat) / avg(y) AS beta, 1 - avg((yhat - y) * (yhat - y)) / var_pop(y) AS nse, avg(abs(yhat - y)) AS mae FROM scored GROUP BY ROLLUP (method))
 SELECT coalesce(method, 'all') AS method, round(r, 4) AS r, round(alpha, 4) AS alpha, round(beta, 4) AS beta, round(nse, 4) AS nse, round(mae, 4) AS mae, round(1 - sqrt((r - 1) * (r - 1) + (alpha - 1) * (alpha - 1) + (beta - 1) * (beta - 1)), 4) AS kge FROM e""")
def d40(spark, d):
    s = scored(spark, d)
    both = s.withColumn("method", F.explode(F.array("method", F.lit("all"))))
    return rounded(skill.efficiency(both, ["method"]))


@query("d41_cross_seed_check", f"WITH {SCORED}, f AS (SELECT method, rep, avg(abs(y - yhat)) AS m FROM scored GROUP BY 1, 2) SELECT method, round(avg(m), 4) AS mean, round(stddev_samp(m), 4) AS std, avg(m) <= 30 AS passed FROM f GROUP BY 1")
def d41(spark, d):
    f = skill.pooled(_sums(spark, d), ["method", "rep"]).groupBy("method").agg(F.avg("mae").alias("mean"), F.stddev_samp("mae").alias("std"))
    return rounded(f.withColumn("passed", F.col("mean") <= 30))


@query("d42_standardization", f"WITH {SCORED} SELECT round(avg(y), 4) AS mean_y, round(stddev_pop(y), 4) AS std_y, round(avg(yhat) FILTER (yhat > 20), 4) AS mean_pos, round(stddev_pop(yhat) FILTER (yhat > 20), 4) AS std_pos FROM scored")
def d42(spark, d):
    p = F.when(F.col("yhat") > 20, F.col("yhat"))
    return rounded(scored(spark, d).agg(F.avg("y").alias("mean_y"), F.stddev_pop("y").alias("std_y"), F.avg(p).alias("mean_pos"), F.stddev_pop(p).alias("std_pos")))


@query("d43_fold_distribution", f"WITH {SCORED} SELECT fold, count(*) AS n, round(avg(y), 4) AS mean, round(stddev_samp(y), 4) AS std, round(quantile_cont(y, 0.25), 4) AS p25, round(quantile_cont(y, 0.5), 4) AS p50, round(quantile_cont(y, 0.75), 4) AS p75 FROM scored GROUP BY 1")
def d43(spark, d):
    q = F.expr("percentile(y, array(0.25, 0.5, 0.75))")
    a = scored(spark, d).groupBy("fold").agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.stddev_samp("y").alias("std"), q.alias("q"))
    return rounded(a.select("fold", "n", "mean", "std", *(F.col("q")[i].alias(n) for i, n in enumerate(("p25", "p50", "p75")))))


@query("d44_ks_statistic", f"""WITH {SCORED}, c AS (SELECT grp, y, count(*) FILTER (fold = 0) AS a, count(*) FILTER (fold <> 0) AS b FROM scored GROUP BY 1, 2), r AS (SELECT grp, abs(sum(a) OVER w / sum(a) OVER (PARTITION BY grp) - sum(b) OVER w / sum(b) OVER (PARTITION BY grp)) AS g FROM c WINDOW w AS (PARTITION BY grp ORDER BY y))
 SELECT grp, round(max(g), 4) AS ks, (SELECT round(avg(y) FILTER (fold = 0) - avg(y) FILTER (fold <> 0), 4) FROM scored s WHERE s.grp = r.grp) AS mean_shift, (SELECT round(stddev_samp(y) FILTER (fold = 0) - stddev_samp(y) FILTER (fold <> 0), 4) FROM scored s WHERE s.grp = r.grp) AS std_shift FROM r GROUP BY grp""")
def d44(spark, d):
    return rounded(skill.ks_statistic(scored(spark, d), ["grp"], "y", F.col("fold") == 0))


@query("d45_median_ensemble", f"WITH {SCORED} SELECT id, round(CASE WHEN size = 2 THEN (yhat + y) / 2 ELSE list_median([yhat, y, yhat * 1.1]) END, 4) AS m FROM scored")
def d45(spark, d):
    s = scored(spark, d).withColumn("a", F.col("yhat")).withColumn("b", F.col("y")).withColumn("c", F.when(F.col("size") != 2, F.col("yhat") * 1.1))
    return rounded(s.select("id", skill.median_of(["a", "b", "c"]).alias("m")))


# ---- attributions: the embedding table as (sample, feature, contribution)

_ATT = "att AS (SELECT vec_id AS sample, label AS class, unnest(generate_series(0, len(embedding) - 1)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"


def _att(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("sample"), F.col("label").alias("class"), F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double")).withColumn("i", F.col("i").cast("long"))


@query("d46_collapse_one_hot", f"WITH {_ATT} SELECT sample, CASE WHEN i < 6 THEN 'class' ELSE 'f' || i END AS feature, round(sum(x), 4) AS total, round(sum(abs(x)), 4) AS abs_total FROM att GROUP BY 1, 2")
def d46(spark, d):
    f = F.when(F.col("i") < 6, "class").otherwise(F.concat(F.lit("f"), F.col("i").cast("string")))
    return rounded(_att(spark, d).groupBy("sample", f.alias("feature")).agg(F.sum("x").alias("total"), F.sum(F.abs("x")).alias("abs_total")))


@query("d47_collapse_lags", f"WITH {_ATT} SELECT sample, 'f' || (i // 4) AS base, round(sum(x), 4) AS total, round(sum(x) FILTER (i % 4 = 0), 4) AS latest FROM att GROUP BY 1, 2")
def d47(spark, d):
    named = _att(spark, d).withColumn("name", F.concat(F.lit("f"), F.expr("string(i div 4)"), F.lit("_t-"), (F.col("i") % 4).cast("string")))
    base, lag = F.regexp_extract("name", r"^(.*)_t-(\d+)$", 1), F.regexp_extract("name", r"_t-(\d+)$", 1)
    return rounded(named.groupBy("sample", base.alias("base")).agg(F.sum("x").alias("total"), F.sum(F.when(lag == "0", F.col("x"))).alias("latest")))


@query("d48_class_feature_report", f"WITH {_ATT} SELECT class, i AS feature, count(*) AS n, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, round(avg(abs(x)), 4) AS mean_abs, round(median(x), 4) AS median, round(min(x), 4) AS min, round(max(x), 4) AS max, round(100.0 * count(*) FILTER (x > 0) / count(*), 2) AS positive_pct FROM att GROUP BY 1, 2")
def d48(spark, d):
    a = _att(spark, d).groupBy("class", F.col("i").alias("feature")).agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.avg(F.abs("x")).alias("mean_abs"), F.median("x").alias("median"), F.min("x").alias("min"), F.max("x").alias("max"), (100 * F.count_if(F.col("x") > 0) / F.count("*")).alias("positive_pct"))
    return rounded(a.withColumn("positive_pct", F.round(F.col("positive_pct") + 1e-9, 2)))


@query("d49_top_features", f"WITH {_ATT}, m AS (SELECT class, i AS feature, round(avg(abs(x)), 6) AS mean_abs FROM att GROUP BY 1, 2) SELECT class, feature, mean_abs, rank FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY mean_abs DESC, feature) AS rank FROM m) WHERE rank <= 5")
def d49(spark, d):
    m = rounded(_att(spark, d).groupBy("class", F.col("i").alias("feature")).agg(F.avg(F.abs("x")).alias("mean_abs")), 6)
    return skill.rank_methods(m, ["class"], "feature", "mean_abs").withColumn("rank", F.col("rank").cast("long"))


@query("d94_category_totals", f"WITH {_ATT}, m AS (SELECT i, avg(abs(x)) AS v FROM att GROUP BY 1) SELECT CASE WHEN i < 6 THEN 'class' WHEN i < 20 THEN 'climate' ELSE 'soil' END AS category, round(sum(v), 4) AS total FROM m GROUP BY 1")
def d94(spark, d):
    m = _att(spark, d).groupBy("i").agg(F.avg(F.abs("x")).alias("v"))
    c = F.when(F.col("i") < 6, "class").when(F.col("i") < 20, "climate").otherwise("soil")
    return rounded(m.groupBy(c.alias("category")).agg(F.sum("v").alias("total")))


@query("d51_hourly_drivers", f"WITH {OBS}, h AS (SELECT unnest(generate_series(0, 23)) AS hour), m AS (SELECT kind, hr % 24 AS hour, avg(value) AS v FROM obs GROUP BY 1, 2) SELECT k.kind, h.hour, round(v, 4) AS mean FROM h CROSS JOIN (SELECT DISTINCT kind FROM obs) k LEFT JOIN m ON m.kind = k.kind AND m.hour = h.hour")
def d51(spark, d):
    o = obs(spark, d)
    hours = o.select("kind").distinct().select("kind", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))).alias("hour"))
    return rounded(hours.join(o.groupBy("kind", (F.col("hr") % 24).alias("hour")).agg(F.avg("value").alias("mean")), ["kind", "hour"], "left"))


# ---- gridded products


@query("d52_cell_z_score", f"WITH {GRID} SELECT product, lat, lon, day, round(CASE WHEN count(v) OVER w >= 3 AND stddev_pop(v) OVER w > 1e-10 THEN (v - avg(v) OVER w) / stddev_pop(v) OVER w END, 4) AS z FROM grid WINDOW w AS (PARTITION BY product, lat, lon)")
def d52(spark, d):
    return rounded(g.z_score(grid(spark, d), ["product", "lat", "lon"], "v", 3).drop("v"))


@query("d53_anomaly", f"WITH {GRID} SELECT product, lat, lon, day, round(v - avg(v) OVER (PARTITION BY product, lat, lon, day % 7), 4) AS anomaly FROM grid")
def d53(spark, d):
    a = g.anomaly(grid(spark, d).withColumn("m", F.col("day") % 7), ["product", "lat", "lon"], "m", "v")
    return rounded(a.select("product", "lat", "lon", "day", "anomaly"))


@query("d54_amplitude", f"WITH {GRID} SELECT product, lat, lon, day, round((v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0), 4) AS scaled FROM grid WINDOW w AS (PARTITION BY product, lat, lon)")
def d54(spark, d):
    return rounded(g.amplitude(grid(spark, d), ["product", "lat", "lon"], "v").drop("v"))


_CORR = f"""{GRID}, o AS (SELECT *, v - avg(v) OVER w AS dv, stddev_pop(v) OVER w AS s FROM grid WINDOW w AS (PARTITION BY product, lat, lon)),
 corr AS (SELECT a.product, a.lat, a.lon, count(*) AS n, CASE WHEN count(*) >= 3 THEN avg(a.dv * b.dv) / CASE WHEN min(a.s * b.s) > 1e-12 THEN min(a.s * b.s) END END AS r FROM o a JOIN o b ON a.lat = b.lat AND a.lon = b.lon AND a.day = b.day WHERE a.product <> 'view' AND b.product = 'view' GROUP BY 1, 2, 3)"""


def _corr(spark, d):
    return g.cell_correlation(grid(spark, d), "view", "v", "day", 3)


@query("d55_cell_correlation", f"WITH {_CORR} SELECT product, lat, lon, n, round(r, 4) AS r FROM corr")
def d55(spark, d):
    return rounded(_corr(spark, d))


@query("d56_cell_rmse", f"WITH {GRID} SELECT a.product, a.lat, a.lon, round(sqrt(avg((a.v - b.v) * (a.v - b.v))), 4) AS rmse FROM grid a JOIN grid b ON a.lat = b.lat AND a.lon = b.lon AND a.day = b.day WHERE a.product <> 'view' AND b.product = 'view' GROUP BY 1, 2, 3")
def d56(spark, d):
    p = g.pair_products(grid(spark, d), "view", "v", ["lat", "lon", "day"])
    return rounded(p.groupBy("product", "lat", "lon").agg(F.sqrt(F.avg(F.pow(F.col("a") - F.col("b"), 2))).alias("rmse")))


_PFT = "CASE WHEN {0}lat < -20 THEN 'EBF' WHEN {0}lat < 30 THEN 'DBF' ELSE 'ENF' END"


@query("d57_class_metrics", f"WITH {GRID} SELECT a.product, {_PFT.format('a.')} AS pft, count(*) AS n, round(sqrt(avg((a.v - b.v) * (a.v - b.v))), 4) AS rmse, round(avg(abs(a.v - b.v)), 4) AS mae, round(avg(a.v - b.v), 4) AS bias FROM grid a JOIN grid b ON a.lat = b.lat AND a.lon = b.lon AND a.day = b.day WHERE a.product <> 'view' AND b.product = 'view' GROUP BY 1, 2 HAVING count(*) >= 5")
def d57(spark, d):
    p = g.pair_products(grid(spark, d), "view", "v", ["lat", "lon", "day"]).withColumn("pft", F.expr(_PFT.format("")))
    e = F.col("a") - F.col("b")
    return rounded(p.groupBy("product", "pft").agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias")).where("n >= 5"))


@query("d58_zonal_amplitude", f"WITH {GRID}, m AS (SELECT product, lat, lon, day // 7 AS w, avg(v) AS v FROM grid GROUP BY 1, 2, 3, 4), a AS (SELECT product, lat, lon, max(v) - min(v) AS amp FROM m GROUP BY 1, 2, 3) SELECT product, CAST(floor((lat + 60) / 5) AS BIGINT) AS band, round(avg(amp), 4) AS amplitude FROM a GROUP BY 1, 2")
def d58(spark, d):
    m = grid(spark, d).groupBy("product", "lat", "lon", F.expr("day div 7").alias("w")).agg(F.avg("v").alias("v"))
    a = m.groupBy("product", "lat", "lon").agg((F.max("v") - F.min("v")).alias("amp"))
    return rounded(a.groupBy("product", F.floor((F.col("lat") + 60) / 5).alias("band")).agg(F.avg("amp").alias("amplitude")))


@query("d59_peak_of_profile", f"WITH {GRID}, p AS (SELECT product, {_PFT.format('')} AS pft, day % 7 AS m, round(avg(v), 6) AS v FROM grid GROUP BY 1, 2, 3) SELECT product, pft, arg_max(m, struct_pack(v := v, m := -m)) AS peak FROM p GROUP BY 1, 2")
def d59(spark, d):
    p = rounded(grid(spark, d).groupBy("product", F.expr(_PFT.format("")).alias("pft"), (F.col("day") % 7).alias("m")).agg(F.avg("v").alias("v")), 6)
    return p.groupBy("product", "pft").agg(F.max_by("m", F.struct("v", -F.col("m"))).alias("peak"))


_TREND = f"""{DAILY}, an AS (SELECT site, n % 3 AS product, day // 365 AS year, avg(q) AS v FROM daily GROUP BY 1, 2, 3), sp AS (SELECT min(day // 365) AS y0, max(day // 365) - min(day // 365) + 1 AS n FROM daily),
 slopes AS (SELECT site, product, sum((year - y0 - (n - 1) / 2.0) * (v - mv)) / min(n * (n * n - 1) / 12.0) AS slope FROM (SELECT *, avg(v) OVER (PARTITION BY site, product) AS mv FROM an) CROSS JOIN sp GROUP BY 1, 2)"""


def _slopes(spark, d):
    k = daily(spark, d).withColumn("product", F.col("n") % 3).withColumn("year", F.expr("day div 365"))
    return g.trend(k, ["site", "product"], "year", "q")


@query("d61_trend_agreement", f"WITH {_TREND} SELECT site, round(greatest(count(*) FILTER (slope > 0), count(*) FILTER (slope < 0)) / count(slope), 4) AS agreement FROM slopes GROUP BY 1")
def d61(spark, d):
    return rounded(g.sign_agreement(_slopes(spark, d), ["site"]))


@query("d61_trend_slopes", f"WITH {_TREND} SELECT site, product, round(slope, 4) AS slope FROM slopes")
def d61s(spark, d):
    return rounded(_slopes(spark, d))


@query("d62_consensus_map", f"WITH {_CORR}, c AS (SELECT lat, lon, avg(r) AS mean_r, stddev_pop(r) AS std_r, CAST(count(*) FILTER (r > 0.5) AS BIGINT) AS n_high, count(*) AS n FROM corr WHERE r IS NOT NULL GROUP BY 1, 2) SELECT lat, lon, round(mean_r, 4) AS mean_r, round(std_r, 4) AS std_r, n_high, n, CASE WHEN n_high / n >= 0.75 THEN 3 WHEN n_high / n >= 0.5 THEN 2 ELSE 1 END AS zone FROM c")
def d62(spark, d):
    return rounded(g.consensus(_corr(spark, d)))


@query("d63_product_ranking", f"WITH {_CORR}, m AS (SELECT {_PFT.format('')} AS pft, product, round(avg(r), 6) AS r FROM corr WHERE r IS NOT NULL GROUP BY 1, 2) SELECT pft, product, r, rank FROM (SELECT *, row_number() OVER (PARTITION BY pft ORDER BY r DESC, product) AS rank, count(*) OVER (PARTITION BY pft) AS c FROM m) WHERE c >= 2")
def d63(spark, d):
    m = rounded(_corr(spark, d).where("r is not null").groupBy(F.expr(_PFT.format("")).alias("pft"), "product").agg(F.avg("r").alias("r")), 6)
    many = m.groupBy("pft").agg(F.count("*").alias("c")).where("c >= 2")
    return skill.rank_methods(m.join(many, "pft", "left_semi"), ["pft"], "product", "r", 99).withColumn("rank", F.col("rank").cast("long"))


@query("d65_triple_collocation", f"""WITH {DAILY}, t AS (SELECT q AS a, q * 0.9 + price / 20000 AS b, q * 1.1 + disc * 50 AS c FROM daily), m AS (SELECT count(*) AS n, var_pop(a) AS aa, var_pop(b) AS bb, var_pop(c) AS cc, covar_pop(a, b) AS ab, covar_pop(a, c) AS ac, covar_pop(b, c) AS bc FROM t),
 e AS (SELECT n, greatest(aa - ab * ac / bc, 0) AS ea, greatest(bb - ab * bc / ac, 0) AS eb, greatest(cc - ac * bc / ab, 0) AS ec FROM m), i AS (SELECT *, CASE WHEN ea > 1e-12 THEN 1 / ea ELSE 0 END AS ia, CASE WHEN eb > 1e-12 THEN 1 / eb ELSE 0 END AS ib, CASE WHEN ec > 1e-12 THEN 1 / ec ELSE 0 END AS ic FROM e)
 SELECT n, round(ea, 3) AS err_a, round(eb, 3) AS err_b, round(ec, 3) AS err_c, round(ia / (ia + ib + ic), 3) AS weight_a, round(ib / (ia + ib + ic), 3) AS weight_b, round(ic / (ia + ib + ic), 3) AS weight_c FROM i""")
def d65(spark, d):
    t = daily(spark, d).selectExpr("q as a", "q * 0.9 + price / 20000 as b", "q * 1.1 + disc * 50 as c")
    return rounded(g.triple_collocation(t, "a", "b", "c"), 3)


_BOX = "(VALUES ('north', 20.0, 80.0, -180.0, 180.0), ('south', -60.0, 0.0, -90.0, 90.0))"


@query("d66_regions", f"WITH {GRID} SELECT name, product, day, round(avg(v), 4) AS mean, count(v) AS n FROM grid JOIN {_BOX} b(name, a0, a1, o0, o1) ON lat BETWEEN a0 AND a1 AND lon BETWEEN o0 AND o1 GROUP BY 1, 2, 3")
def d66(spark, d):
    boxes = spark.createDataFrame([("north", 20.0, 80.0, -180.0, 180.0), ("south", -60.0, 0.0, -90.0, 90.0)], "name string, lat0 double, lat1 double, lon0 double, lon1 double")
    return rounded(g.regions(grid(spark, d), boxes, ["product", "day"], "v"))


@query("d67_taylor_statistics", f"WITH {GRID} SELECT a.product, round(stddev_pop(a.v), 4) AS sigma, round(stddev_pop(b.v), 4) AS sigma_ref, round(corr(a.v, b.v), 4) AS r, round(acos(corr(a.v, b.v)), 4) AS angle FROM grid a JOIN grid b ON a.lat = b.lat AND a.lon = b.lon AND a.day = b.day WHERE a.product <> 'view' AND b.product = 'view' GROUP BY 1")
def d67(spark, d):
    p = g.pair_products(grid(spark, d), "view", "v", ["lat", "lon", "day"])
    return rounded(p.groupBy("product").agg(F.stddev_pop("a").alias("sigma"), F.stddev_pop("b").alias("sigma_ref"), F.corr("a", "b").alias("r"), F.acos(F.corr("a", "b")).alias("angle")))


@query("d68_dominant_class", f"WITH {GRID}, p AS (SELECT lat, lon, avg(v) FILTER (product = 'click') AS click, avg(v) FILTER (product = 'error') AS error, avg(v) FILTER (product = 'view') AS view FROM grid GROUP BY 1, 2) SELECT lat, lon, CASE WHEN click = greatest(click, error, view) THEN 'click' WHEN error = greatest(click, error, view) THEN 'error' WHEN view = greatest(click, error, view) THEN 'view' END AS dominant FROM p")
def d68(spark, d):
    p = grid(spark, d).groupBy("lat", "lon").pivot("product", ["click", "error", "view"]).agg(F.avg("v"))
    return p.select("lat", "lon", g.dominant_class(["click", "error", "view"]).alias("dominant"))


@query("d69_variability_map", f"WITH {GRID} SELECT product, lat, lon, round(stddev_pop(v), 4) AS std FROM grid GROUP BY 1, 2, 3")
def d69(spark, d):
    return rounded(grid(spark, d).groupBy("product", "lat", "lon").agg(F.stddev_pop("v").alias("std")))


@query("d70_grid_binning", f"WITH {GRID} SELECT day, CAST(floor((90 - lat + 1e-6) / 2.5) AS BIGINT) AS row, CAST(floor((lon + 180 + 1e-6) / 2.5) AS BIGINT) AS col, round(avg(v), 4) AS v FROM grid GROUP BY 1, 2, 3")
def d70(spark, d):
    return rounded(g.bin_points(grid(spark, d), "day", "v", 90.0, -180.0, 2.5))


@query("d71_daily_cell_maximum", f"WITH {OBS} SELECT hr // 24 AS day, sensor, round(max(value), 4) AS v FROM obs GROUP BY 1, 2")
def d71(spark, d):
    return rounded(obs(spark, d).groupBy(F.expr("hr div 24").alias("day"), "sensor").agg(F.max("value").alias("v")))


@query("d72_composites", f"WITH {GRID} SELECT lat, lon, round(avg(v), 4) AS mean, round(median(v), 4) AS median, round(min(v), 4) AS min, round(max(v), 4) AS max, round(stddev_samp(v), 4) AS std, count(v) AS n FROM grid GROUP BY 1, 2")
def d72(spark, d):
    return rounded(g.composites(grid(spark, d), ["lat", "lon"], "v"))


@query("d74_coarsen", f"WITH {GRID} SELECT product, day, floor(lat / 10) * 10 AS lat, floor(lon / 10) * 10 AS lon, round(sum(v * cos(radians(g.lat))) / sum(cos(radians(g.lat))), 4) AS v FROM grid g GROUP BY 1, 2, 3, 4")
def d74(spark, d):
    c = g.coarsen(grid(spark, d), ["product", "day"], "v", 10.0)
    return rounded(c.withColumn("lat", F.col("lat").cast("double")).withColumn("lon", F.col("lon").cast("double")))


@query("c24_product_reference_join", f"WITH {GRID} SELECT a.product, a.lat, a.lon, a.day, a.v AS a, b.v AS b FROM grid a JOIN grid b ON a.lat = b.lat AND a.lon = b.lon AND a.day = b.day WHERE a.product <> 'view' AND b.product = 'view'")
def c24(spark, d):
    return g.pair_products(grid(spark, d), "view", "v", ["lat", "lon", "day"])


@query("c11_nearest_cell", f"WITH {GRID}, c AS (SELECT DISTINCT lat AS clat, lon AS clon FROM grid WHERE product = 'view'), p AS (SELECT s_suppkey AS id, CAST(s_suppkey * 29 % 130 - 55 AS DOUBLE) + 0.3 AS lat, CAST(s_suppkey * 41 % 350 - 175 AS DOUBLE) + 0.4 AS lon FROM supplier),"
       " m AS (SELECT p.id, clat, clon, round(pow(lat - clat, 2) + pow(lon - clon, 2), 9) AS d2 FROM p JOIN c ON abs(lat - clat) <= 10 AND abs(lon - clon) <= 10), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, clat, clon) AS r FROM m WHERE d2 <= 100) SELECT p.id, b.clat, b.clon FROM p LEFT JOIN b ON b.id = p.id AND r = 1")
def c11(spark, d):
    cells = grid(spark, d).where("product = 'view'").select(F.col("lat").alias("clat"), F.col("lon").alias("clon")).distinct()
    p = table(spark, d, "supplier").selectExpr("s_suppkey as id", "cast(s_suppkey * 29 % 130 - 55 as double) + 0.3 as lat", "cast(s_suppkey * 41 % 350 - 175 as double) + 0.4 as lon")
    return joins.nearest_cell(p, cells, ["id"], 1.0, 10.0, []).select("id", "clat", "clon")


@query("c15_station_matching", """WITH a AS (SELECT s_suppkey AS id, CAST(s_suppkey * 29 % 130 - 55 AS DOUBLE) AS lat, CAST(s_suppkey * 41 % 350 - 175 AS DOUBLE) AS lon FROM supplier), b AS (SELECT c_custkey AS id, CAST(c_custkey * 17 % 130 - 55 AS DOUBLE) + 0.25 AS lat, CAST(c_custkey * 13 % 350 - 175 AS DOUBLE) + 0.25 AS lon FROM customer),
 j AS (SELECT a.id AS id_a, b.id AS id_b, round(2 * 6371.0 * asin(sqrt(least(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2), 1.0))), 4) AS km FROM a JOIN b ON abs(a.lat - b.lat) <= 150 / 111.0) SELECT id_a, id_b, km FROM j WHERE km <= 150""")
def c15(spark, d):
    a = table(spark, d, "supplier").selectExpr("s_suppkey as id", "cast(s_suppkey * 29 % 130 - 55 as double) as lat", "cast(s_suppkey * 41 % 350 - 175 as double) as lon")
    b = table(spark, d, "customer").selectExpr("c_custkey as id", "cast(c_custkey * 17 % 130 - 55 as double) + 0.25 as lat", "cast(c_custkey * 13 % 350 - 175 as double) + 0.25 as lon")
    return joins.stations_within(a, b, 150.0)


# ---- area of applicability

_VEC = "v AS (SELECT vec_id AS id, label AS fold, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("fold"), F.col("embedding").cast("array<double>").alias("x"))


_STD = f"""{_VEC}, l AS (SELECT id, fold, unnest(generate_series(1, len(x))) AS i, unnest(x) AS x FROM v), st AS (SELECT i, avg(x) AS m, stddev_samp(x) AS s FROM l GROUP BY 1),
 z AS (SELECT id, any_value(fold) AS fold, list(CASE WHEN s > 0 THEN (x - m) / s ELSE 0 END ORDER BY i) AS x FROM l JOIN st USING (i) GROUP BY id)"""


@query("d75_feature_statistics", f"WITH {_STD} SELECT i - 1 AS feature, round(m, 5) AS mean, round(s, 5) AS std FROM st")
def d75(spark, d):
    a = _vectors(spark, d).select(F.posexplode("x").alias("feature", "x")).groupBy(F.col("feature").cast("long").alias("feature")).agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))
    return rounded(a, 5)


@query("c16_nearest_other_fold", f"WITH {_STD} SELECT a.id, round(min(list_distance(a.x, b.x)), 3) AS nearest FROM z a JOIN z b ON a.fold <> b.fold GROUP BY 1")
def c16(spark, d):
    v = _vectors(spark, d)
    return rounded(aoa.nearest_distance(v, v, "x", *aoa.statistics(v, "x"), fold="fold"), 3)


@query("c17_nearest_training", f"WITH {_STD} SELECT a.id, round(min(list_distance(a.x, b.x)), 3) AS nearest FROM z a JOIN z b ON b.id % 3 = 0 WHERE a.id % 3 <> 0 GROUP BY 1")
def c17(spark, d):
    v = _vectors(spark, d)
    return rounded(aoa.nearest_distance(v.where("id % 3 <> 0"), v.where("id % 3 = 0"), "x", *aoa.statistics(v, "x")), 3)


@query("d78_threshold", f"WITH {_STD}, n AS (SELECT a.id, min(list_distance(a.x, b.x)) AS di FROM z a JOIN z b ON a.fold <> b.fold GROUP BY 1) SELECT round(quantile_cont(di, 0.75) + 1.5 * (quantile_cont(di, 0.75) - quantile_cont(di, 0.25)), 3) AS threshold FROM n")
def d78(spark, d):
    v = _vectors(spark, d)
    return rounded(aoa.threshold(aoa.nearest_distance(v, v, "x", *aoa.statistics(v, "x"), fold="fold"), "nearest"), 3)


_DI = f"{OBS}, di AS (SELECT sensor, hr // 168 AS wk, hr // 24 % 3 AS m, k AS di, k <= 80 AS inside FROM obs WHERE k IS NOT NULL)"
_MON = f"{_DI}, mon AS (SELECT sensor, wk, m, median(di) AS median_di, avg(di) AS mean_di, coalesce(stddev_samp(di), 0) AS std_di, avg(CAST(inside AS INT)) AS inside, count(*) AS n FROM di GROUP BY 1, 2, 3)"


def _mon(spark, d):
    o = obs(spark, d).where("k is not null").withColumn("wk", F.expr("hr div 168")).withColumn("m", F.expr("hr div 24 % 3")).withColumn("inside", F.col("k") <= 80)
    return aoa.monthly(o, ["sensor", "wk", "m"], "k", "inside")


@query("d80_monthly_summary", f"WITH {_MON} SELECT sensor, wk, m, round(median_di, 4) AS median_di, round(mean_di, 4) AS mean_di, round(std_di, 4) AS std_di, round(inside, 4) AS inside, n FROM mon")
def d80(spark, d):
    return rounded(_mon(spark, d))


@query("d81_roll_up", f"WITH {_MON} SELECT sensor, wk, m, round(median(median_di), 4) AS median_di, round(avg(mean_di), 4) AS mean_di, CAST(sum(n) AS BIGINT) AS n FROM mon GROUP BY GROUPING SETS ((sensor, wk), (sensor, m), (sensor))")
def d81(spark, d):
    return rounded(aoa.roll_up(_mon(spark, d), ["sensor"], "wk", "m"))


# ---- scalar functions

_SC = "sc AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity AS q, l_discount AS disc, l_tax AS tax, l_quantity - 10 AS t, l_quantity - 12 - l_discount * 40 AS dew, l_suppkey % 130 - 60.0 AS lat, l_partkey % 365 + 1.0 AS doy FROM lineitem)"


def _sc(spark, d):
    return table(spark, d, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber as id", "l_quantity as q", "l_discount as disc", "l_tax as tax", "l_quantity - 10 as t", "l_quantity - 12 - l_discount * 40 as dew", "cast(l_suppkey % 130 - 60 as double) as lat", "cast(l_partkey % 365 + 1 as double) as doy")


_ES = "(0.6108 * exp(17.27 * {0} / ({0} + 237.3)))"


@query("h2_vapour_deficit", f"WITH {_SC} SELECT id, round(greatest({_ES.format('t')} - {_ES.format('least(dew, t)')}, 0), 5) AS vpd, round(least(100 * {_ES.format('least(dew, t)')} / {_ES.format('t')}, 100), 4) AS rh FROM sc")
def h2(spark, d):
    s = _sc(spark, d)
    return s.select("id", F.round(scalars.vapour_deficit(F.col("t"), F.col("dew")) + 1e-9, 5).alias("vpd"), F.round(scalars.relative_humidity(F.col("t"), F.col("dew")) + 1e-9, 4).alias("rh"))


@query("h4_wind_and_photons", f"WITH {_SC} SELECT id, round(sqrt(q * q + t * t), 4) AS ws, round(greatest(t * 2.04, 0), 4) AS ppfd FROM sc")
def h4(spark, d):
    return rounded(_sc(spark, d).select("id", scalars.wind_speed(F.col("q"), F.col("t")).alias("ws"), scalars.photon_flux(F.col("t")).alias("ppfd")))


_GA = "(2 * pi() * (doy - 1) / 365)"
_DEC = f"(0.006918 - 0.399912 * cos({_GA}) + 0.070257 * sin({_GA}) - 0.006758 * cos(2 * {_GA}) + 0.000907 * sin(2 * {_GA}) - 0.002697 * cos(3 * {_GA}) + 0.00148 * sin(3 * {_GA}))"


@query("h5_extraterrestrial", f"WITH {_SC}, a AS (SELECT id, radians(lat) AS phi, {_DEC} AS dec, doy FROM sc), b AS (SELECT *, acos(least(greatest(-tan(phi) * tan(dec), -1), 1)) AS ws FROM a) SELECT id, round(24 * 60 / pi() * 0.0820 * (1 + 0.033 * cos(2 * pi() * doy / 365)) * (ws * sin(phi) * sin(dec) + cos(phi) * cos(dec) * sin(ws)), 4) AS ra FROM b")
def h5(spark, d):
    return rounded(_sc(spark, d).select("id", scalars.extraterrestrial(F.col("lat"), F.col("doy"), F.lit(365.0)).alias("ra")))


@query("h6_day_length", f"WITH {_SC}, a AS (SELECT id, radians(lat) AS l, asin(0.39795 * cos(0.2163108 + 2 * atan(0.9671396 * tan(0.00860 * (doy - 186))))) AS phi FROM sc) SELECT id, round(24 - 24 / pi() * acos(least(greatest((sin(radians(0.8333)) + sin(l) * sin(phi)) / (cos(l) * cos(phi)), -1), 1)), 4) AS hours FROM a")
def h6(spark, d):
    return rounded(_sc(spark, d).select("id", scalars.day_length(F.col("lat"), F.col("doy")).alias("hours")))


@query("h7_solar_elevation", f"WITH {_SC}, a AS (SELECT id, radians(lat) AS phi, {_DEC} AS dec, q FROM sc) SELECT id, round(degrees(asin(sin(phi) * sin(dec) + cos(phi) * cos(dec) * cos(radians(15 * (q / 50 * 24 - 12))))), 4) AS elevation FROM a")
def h7(spark, d):
    return rounded(_sc(spark, d).select("id", scalars.solar_elevation(F.col("lat"), F.col("doy"), F.lit(365.0), F.col("q") / 50 * 24).alias("elevation")))


@query("h9_cyclic_encoding", f"WITH {OBS} SELECT event_id, round(sin(2 * pi() * sec / 86400.0), 5) AS day_sin, round(cos(2 * pi() * sec / 86400.0), 5) AS day_cos FROM obs")
def h9(spark, d):
    s, c = scalars.cyclic(F.col("sec"), 86400.0)
    return rounded(obs(spark, d).select("event_id", s.alias("day_sin"), c.alias("day_cos")), 5)


@query("h10_rain_over_demand", f"WITH {_SC} SELECT id, round(CASE WHEN tax > 1e-6 THEN least(greatest(disc / tax, 0), 10) WHEN disc < 1e-6 THEN 0 ELSE 10 END, 4) AS ratio FROM sc")
def h10(spark, d):
    return rounded(_sc(spark, d).select("id", scalars.rain_over_demand(F.col("disc"), F.col("tax")).alias("ratio")))


@query("h11_soil_hydraulics", f"WITH {_SC}, a AS (SELECT id, q / 100 AS s, disc * 4 AS c, tax * 50 AS o FROM sc), b AS (SELECT id, -0.024 * s + 0.487 * c + 0.006 * o + 0.005 * s * o - 0.013 * c * o + 0.068 * s * c + 0.031 AS w, -0.251 * s + 0.195 * c + 0.011 * o + 0.006 * s * o - 0.027 * c * o + 0.452 * s * c + 0.299 AS f FROM a) SELECT id, round(w + 0.14 * w - 0.02, 5) AS wilting, round(f + 1.283 * f * f - 0.374 * f - 0.015, 5) AS capacity FROM b")
def h11(spark, d):
    h = scalars.hydraulics(F.col("q") / 100, F.col("disc") * 4, F.col("tax") * 50)
    return rounded(_sc(spark, d).select("id", *(c.alias(n) for n, c in h.items())), 5)


@query("h12_extractable_water", f"WITH {_SC} SELECT id, round(least(greatest((q / 100 - 0.1) / (0.3 - 0.1), 0), 1.5), 4) AS rew FROM sc")
def h12(spark, d):
    return rounded(_sc(spark, d).select("id", scalars.extractable_water(F.col("q") / 100, F.lit(0.1), F.lit(0.3)).alias("rew")))


@query("h13_reference_evapotranspiration", f"WITH {_SC}, a AS (SELECT id, t, 4098 * ({_ES.format('t')}) / pow(t + 237.3, 2) AS dl, 0.000665 * 101.3 * pow((293 - 0.0065 * 100) / 293, 5.26) AS g, {_ES.format('t')} AS es FROM sc) SELECT id, round(greatest((0.408 * dl * 12 + g * 900 / (t + 273) * 2 * (es - es * 0.6)) / (dl + g * (1 + 0.34 * 2)), 0), 4) AS et0 FROM a")
def h13(spark, d):
    es = scalars.saturation_pressure(F.col("t"))
    return rounded(_sc(spark, d).select("id", scalars.reference_et(F.col("t"), F.lit(12.0), F.lit(2.0), es, es * 0.6, F.lit(100.0)).alias("et0")))


@query("h17_compass", f"WITH {_SC} SELECT id, CASE WHEN disc * 100 < 1 THEN 'flat' ELSE ['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][CAST(floor((q * 9 % 360 + 22.5) / 45) AS INT) % 8 + 1] END AS aspect FROM sc")
def h17(spark, d):
    return _sc(spark, d).select("id", scalars.compass(F.col("q") * 9, F.col("disc") * 100).alias("aspect"))


@query("h18_texture", f"WITH {_SC} SELECT id, CASE WHEN disc * 500 >= 40 THEN 'clay' WHEN q * 2 >= 70 THEN 'sandy' WHEN disc * 500 >= 27 AND q * 2 < 45 THEN 'clay loam' WHEN q * 2 < 20 THEN 'silty' ELSE 'loam' END AS texture FROM sc")
def h18(spark, d):
    return _sc(spark, d).select("id", scalars.texture(F.col("q") * 2, F.col("disc") * 500).alias("texture"))


@query("h19_quality_bits", f"WITH {OBS} SELECT event_id, CAST(k AS BIGINT) & 12 = 0 AS good FROM obs")
def h19(spark, d):
    return obs(spark, d).select("event_id", scalars.quality_bits(F.col("k").cast("long"), 12).alias("good"))


@query("h20_zone_shift", f"WITH {OBS} SELECT event_id, sec - CASE sensor % 3 WHEN 0 THEN 7200 WHEN 1 THEN -18000 ELSE 0 END AS utc FROM obs")
def h20(spark, d):
    code = F.when(F.col("sensor") % 3 == 0, "UTC+02:00").when(F.col("sensor") % 3 == 1, "UTC-05:00").otherwise("UTC")
    return obs(spark, d).select("event_id", (F.col("sec") - scalars.zone_shift(code, {"UTC": 0, "UTC+02:00": 2, "UTC-05:00": -5})).cast("long").alias("utc"))


@query("h22_tile_index", f"WITH {GRID} SELECT DISTINCT lat, lon, CAST(least(greatest(floor((90 - lat) / 5), 0), 35) AS BIGINT) AS tile_row, CAST(least(greatest(floor((lon + 180) / 5), 0), 71) AS BIGINT) AS tile_col FROM grid")
def h22(spark, d):
    r, c = scalars.tile(F.col("lat"), F.col("lon"))
    return grid(spark, d).select("lat", "lon", r.alias("tile_row"), c.alias("tile_col")).distinct()


@query("a15_longitude_wrap", f"WITH {GRID} SELECT product, day, lat, (lon + 540) % 360 - 180 AS lon, v FROM (SELECT product, day, lat, lon + 180 AS lon, v FROM grid)")
def a15(spark, d):
    return grid(spark, d).withColumn("lon", scalars.wrap_longitude(F.col("lon") + 180)).select("product", "day", "lat", "lon", "v")


@query("h25_target_transforms", f"WITH {_SC} SELECT id, round(ln(1 + q), 5) AS log1p, round(sqrt(q), 5) AS sqrt, round((pow(q + 1e-6, 0.5) - 1) / 0.5, 5) AS box_cox, round((pow(q + 1, 0.5) - 1) / 0.5, 5) AS yeo_johnson, round(q, 5) AS back FROM sc")
def h25(spark, d):
    t = scalars.transforms(F.col("q"))
    return rounded(_sc(spark, d).select("id", *(c.alias(n) for n, c in t.items()), scalars.inverse_log1p(F.log1p("q")).alias("back")), 5)
