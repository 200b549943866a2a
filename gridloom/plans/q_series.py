"""Queries over sensor series: resampling, cleaning, windows, gaps, filling, joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.operators import clean, fill, joins, resample, stats, windows

from .base import DAILY, HOURLY, OBS, daily, hourly, near, obs, query, rounded, table

DAY = "hr % 24 BETWEEN 6 AND 20"


@query("s0_hourly_quality_daily", f"""WITH {HOURLY}, m AS (SELECT sensor, hr, value, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s FROM hourly WINDOW w AS (PARTITION BY sensor, hr // 720)),
 c AS (SELECT sensor, hr, CASE WHEN coalesce(abs(value - m) > 2.0 * s, false) THEN NULL ELSE value END AS value, coalesce(abs(value - m) > 2.0 * s, false) AS o FROM m)
 SELECT sensor, hr // 24 AS day, round(avg(value), 4) AS mean, round(min(value), 4) AS min, round(max(value), 4) AS max, count(value) AS n_valid, CAST(count(*) FILTER (o) AS BIGINT) AS n_outlier FROM c GROUP BY 1, 2""")
def s0(spark: SparkSession, d: str) -> DataFrame:
    h = hourly(spark, d).withColumn("month", F.expr("hr div 720"))
    o = windows.outliers_by_month(h, ["sensor", "month"], "value", 2.0).withColumn("value", F.when(~F.col("outlier"), F.col("value")))
    return rounded(o.groupBy("sensor", F.expr("hr div 24").alias("day")).agg(F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("n_valid"), F.count_if("outlier").alias("n_outlier")))


# ---- cleaning


@query("b1_coercing_cast", "SELECT event_id, TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'NA' WHEN event_id % 5 = 0 THEN 'x1' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS value FROM events")
def b1(spark, d):
    e = table(spark, d, "events").withColumn("raw", F.when(F.col("event_id") % 7 == 0, "NA").when(F.col("event_id") % 5 == 0, "x1").otherwise(F.col("value").cast("string")))
    return e.select("event_id", clean.number("raw").alias("value"))


@query("b2_first_of_duplicates", f"WITH {OBS} SELECT sensor, hr, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY sensor, hr ORDER BY sec, event_id) AS r FROM obs) WHERE r = 1")
def b2(spark, d):
    return clean.first_of_duplicates(obs(spark, d), ["sensor", "hr"], ["sec", "event_id"]).select("sensor", "hr", "event_id", "value")


@query("b2_duplicate_report", f"WITH {OBS} SELECT sensor, hr, count(*) AS n FROM obs GROUP BY 1, 2 HAVING count(*) > 1")
def b2r(spark, d):
    return clean.duplicate_report(obs(spark, d), ["sensor", "hr"])


@query("b3_sensor_flag_mask", f"WITH {OBS} SELECT event_id, CASE WHEN k > 90 THEN NULL WHEN value - 5 < 0 THEN NULL ELSE round(value - 5, 4) END AS value FROM obs")
def b3(spark, d):
    o = obs(spark, d).withColumn("value", F.col("value") - 5).withColumn("flag", F.when(F.col("k") > 90, "OUT_WARN;RANGE_WARN").otherwise("OK"))
    return rounded(o.select("event_id", clean.flag_mask("value", F.col("flag").contains("RANGE_WARN")).alias("value")))


@query("b4_environment_flag_mask", f"WITH {OBS} SELECT event_id, CASE WHEN k > 90 THEN NULL WHEN value - 5 < 0 THEN 0.0 ELSE round(value - 5, 4) END AS value FROM obs")
def b4(spark, d):
    o = obs(spark, d).withColumn("value", F.col("value") - 5)
    return rounded(o.select("event_id", clean.flag_mask("value", F.col("k") > 90, True).alias("value")))


_LOG = [(1, "2024-01-02;2024-01-05", "2024-01-03;2024-01-06"), (2, "2024-01-04", "2024-01-09;2024-01-10"), (3, "2024-01-08", "2024-01-07")]
_LOG_SQL = """rules AS (SELECT * FROM (VALUES (1, 0, 9, '2024-01-02', '2024-01-03'), (1, 0, 9, '2024-01-05', '2024-01-06'), (2, 10, 19, '2024-01-04', '2024-01-09')) t(id, lo, hi, s, e)),
 spans AS (SELECT id, lo, hi, epoch(CAST(s AS TIMESTAMP)) AS s, epoch(CAST(e AS TIMESTAMP)) AS e FROM rules)"""


def _rules(spark: SparkSession) -> DataFrame:
    log = spark.createDataFrame(_LOG, "entry_id int, start_time string, end_time string")
    p = clean.removal_periods(log)
    lo = F.when(F.col("entry_id") == 1, 0).otherwise(10)
    return p.select(F.explode(F.sequence(lo.cast("long"), (lo + 9).cast("long"))).alias("site"), F.lit(None).cast("string").alias("sensor"), F.unix_seconds("period_start").alias("start"), F.unix_seconds("period_end").alias("end"))


@query("b5_removal_periods", f"WITH {OBS}, {_LOG_SQL} SELECT sensor, count(*) AS n FROM obs JOIN spans ON sensor BETWEEN lo AND hi AND sec BETWEEN s AND e GROUP BY 1")
def b5(spark, d):
    o = obs(spark, d).select(F.col("sensor").alias("site"), "sec")
    return joins.in_intervals(o, _rules(spark), ["site"], "sec", "start", "end").where("matched").groupBy(F.col("site").alias("sensor")).agg(F.count("*").alias("n"))


@query("b6_apply_removals", f"WITH {OBS}, {_LOG_SQL}, m AS (SELECT sensor, kind, value, EXISTS (SELECT 1 FROM spans WHERE sensor BETWEEN lo AND hi AND sec BETWEEN s AND e) AS hit FROM obs)"
       " SELECT sensor, kind, count(*) AS n, CAST(count(*) FILTER (hit AND value IS NOT NULL) AS BIGINT) AS removed, round(avg(CASE WHEN NOT hit THEN value END), 4) AS mean FROM m GROUP BY 1, 2")
def b6(spark, d):
    o = obs(spark, d).select(F.col("sensor").alias("site"), F.col("kind").alias("sensor"), F.col("sec").alias("t"), "value")
    r = clean.apply_removals(o, _rules(spark), "value")
    return rounded(r.groupBy(F.col("site").alias("sensor"), F.col("sensor").alias("kind")).agg(F.count("*").alias("n"), F.count_if("removed").alias("removed"), F.avg("value").alias("mean")))


@query("b7_site_skip", f"WITH {OBS} SELECT sensor, count(*) AS n FROM obs WHERE sensor % 10 <> 3 GROUP BY 1")
def b7(spark, d):
    o = obs(spark, d)
    skip = o.select("sensor").where("sensor % 10 = 3").distinct()
    return o.join(skip, "sensor", "left_anti").groupBy("sensor").agg(F.count("*").alias("n"))


_LABEL = "CASE p_partkey % 8 WHEN 0 THEN NULL WHEN 1 THEN 'Control' WHEN 2 THEN 'Irrigation' WHEN 3 THEN 'Pre Irrigation' WHEN 4 THEN 'Increment cores' WHEN 5 THEN 'drought_1' WHEN 6 THEN 'Post-thinning' ELSE 'Elevated CO2' END"
_CLASS_SQL = f"""lab AS (SELECT p_partkey, p_brand, {_LABEL} AS l FROM part), cls AS (SELECT *, CASE WHEN l IS NULL THEN 'keep' WHEN regexp_matches(lower(l), 'control|ambient|pre irrigat|untreated|reference') THEN 'control'
 WHEN regexp_matches(lower(l), 'core|sampl') THEN 'sampling' WHEN regexp_matches(lower(l), 'drought|irrig|thin|fertil|elevated|girdl|exclusion|burn') THEN 'drop' ELSE 'keep' END AS c FROM lab)"""


@query("b8_label_class", f"WITH {_CLASS_SQL} SELECT p_partkey, c AS class FROM cls")
def b8(spark, d):
    return table(spark, d, "part").select("p_partkey", clean.label_class(F.expr(_LABEL)).alias("class"))


@query("b9_drop_by_treatment", f"WITH {_CLASS_SQL} SELECT l_suppkey, count(*) AS n, CAST(count(*) FILTER (c = 'drop' AND l_suppkey % 9 <> 0) AS BIGINT) AS dropped FROM lineitem JOIN cls ON l_partkey = p_partkey GROUP BY 1")
def b9(spark, d):
    p = table(spark, d, "part").select("p_partkey", clean.label_class(F.expr(_LABEL)).alias("class"))
    j = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").join(joins.small(p), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if((F.col("class") == "drop") & (F.col("l_suppkey") % 9 != 0)).alias("dropped"))


@query("b10_method_correction", "SELECT l_suppkey, round(sum(l_quantity * CASE WHEN p_size % 3 = 0 THEN 1 WHEN p_brand LIKE '%1%' THEN exp(0.519) WHEN p_brand LIKE '%2%' THEN exp(0.493) ELSE 1 END), 3) AS corrected FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def b10(spark, d):
    p = table(spark, d, "part").select("p_partkey", clean.method_factor(F.when(F.col("p_brand").contains("1"), "HD").when(F.col("p_brand").contains("2"), "CHD"), F.when(F.col("p_size") % 3 == 0, "TRUE")).alias("f"))
    j = table(spark, d, "lineitem").join(joins.small(p), F.col("l_partkey") == F.col("p_partkey"))
    return rounded(j.groupBy("l_suppkey").agg(F.sum(F.col("l_quantity") * F.col("f")).alias("corrected")), 3)


@query("b13_per_area", "SELECT l_suppkey, round(avg(CASE WHEN p_size - 5 > 0 THEN l_quantity / (p_size - 5) END), 4) AS density, CAST(count(*) FILTER (p_size <= 5) AS BIGINT) AS n_without FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def b13(spark, d):
    j = table(spark, d, "lineitem").join(joins.small(table(spark, d, "part").select("p_partkey", (F.col("p_size") - 5).alias("area"))), F.col("l_partkey") == F.col("p_partkey"))
    return rounded(j.groupBy("l_suppkey").agg(F.avg(clean.per_area(F.col("l_quantity"), F.col("area"))).alias("density"), F.count_if(F.col("area") <= 0).alias("n_without")))


@query("b15_daytime_filter", f"WITH {HOURLY} SELECT sensor, count(*) AS n, round(avg(value), 4) AS mean FROM hourly WHERE value > 10 GROUP BY 1")
def b15(spark, d):
    return rounded(hourly(spark, d).where("value > 10").groupBy("sensor").agg(F.count("*").alias("n"), F.avg("value").alias("mean")))


@query("b16_hour_window_night_zero", f"WITH {HOURLY} SELECT sensor, hr // 24 AS day, round(sum(CASE WHEN {DAY} THEN value ELSE 0 END), 4) AS total FROM hourly WHERE (hr // 24) % 7 < 5 GROUP BY 1, 2")
def b16(spark, d):
    h = hourly(spark, d).where("(hr div 24) % 7 < 5").withColumn("value", F.when(F.expr(DAY), F.col("value")).otherwise(0))
    return rounded(h.groupBy("sensor", F.expr("hr div 24").alias("day")).agg(F.sum("value").alias("total")))


@query("b18_zero_mask", "SELECT l_suppkey, CAST(count(*) FILTER (abs(l_discount) <= 1e-10 AND abs(l_tax) <= 1e-10) AS BIGINT) AS n_all, CAST(count(*) FILTER (abs(l_discount) <= 1e-10 OR abs(l_tax) <= 1e-10) AS BIGINT) AS n_any FROM lineitem GROUP BY 1")
def b18(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(clean.all_near_zero(["l_discount", "l_tax"])).alias("n_all"), F.count_if(clean.all_near_zero(["l_discount", "l_tax"], every=False)).alias("n_any"))


@query("b21_sanity_pass_counts", f"WITH {OBS} SELECT kind, count(*) AS n, CAST(count(*) FILTER (value BETWEEN 0 AND 50) AS BIGINT) AS in_range, CAST(count(*) FILTER (k <= 90) AS BIGINT) AS unflagged FROM obs GROUP BY 1")
def b21(spark, d):
    return clean.pass_counts(obs(spark, d), {"in_range": F.col("value").between(0, 50), "unflagged": F.col("k") <= 90}, ["kind"])


@query("b22_prediction_validation", f"""WITH {HOURLY}, s AS (SELECT sensor, value, k, abs(value - lag(value) OVER (PARTITION BY sensor ORDER BY hr)) AS st FROM (SELECT *, CAST(hr % 24 AS DOUBLE) AS k FROM hourly))
 SELECT sensor, coalesce(min(value) >= 0, true) AS non_negative, coalesce(max(st) <= 50, true) AS smooth, coalesce(abs(corr(value, k)) >= 0.05, false) AS responsive FROM s GROUP BY 1""")
def b22(spark, d):
    h = hourly(spark, d).withColumn("k", (F.col("hr") % 24).cast("double"))
    step = windows.largest_step(h, ["sensor"], "hr", "value")
    g = h.where("value is not null").groupBy("sensor").agg(F.min("value").alias("lo"), F.corr("value", "k").alias("r"))
    j = step.join(g, "sensor", "left")
    return j.select("sensor", F.coalesce(F.col("lo") >= 0, F.lit(True)).alias("non_negative"), F.coalesce(F.col("max_step") <= 50, F.lit(True)).alias("smooth"), F.coalesce(F.abs("r") >= 0.05, F.lit(False)).alias("responsive"))


@query("b25_finite_rows", f"WITH {OBS} SELECT event_id, value, round(100 / k, 6) AS inv FROM obs WHERE value IS NOT NULL AND k <> 0 AND k IS NOT NULL")
def b25(spark, d):
    o = obs(spark, d).select("event_id", "value", F.when(F.col("k") == 0, float("inf")).otherwise(F.try_divide(F.lit(100.0), F.col("k"))).alias("inv"))
    return rounded(clean.finite(o, ["value", "inv"]), 6)


@query("b26_drop_all_missing", f"WITH {OBS} SELECT event_id FROM obs WHERE value IS NOT NULL OR event_id % 3 = 0")
def b26(spark, d):
    o = obs(spark, d).withColumn("other", F.when(F.col("event_id") % 3 == 0, 1))
    return o.dropna("all", subset=["value", "other"]).select("event_id")


@query("b27_seeded_subsample")
def b27(spark, d):
    return clean.hash_sample(obs(spark, d).select("event_id", "value"), ["event_id"], 500, 7)


# ---- resampling


@query("d1_calendar_resample", f"""WITH {OBS}, g AS (SELECT sensor, unnest(generate_series(min(hr), max(hr))) AS hr FROM obs GROUP BY 1), a AS (SELECT sensor, hr, avg(value) AS m, sum(value) AS s, arg_min(value, sec) FILTER (value IS NOT NULL) AS f FROM obs GROUP BY 1, 2)
 SELECT sensor, hr, round(m, 4) AS mean, round(coalesce(s, 0), 4) AS total, count(f) OVER (PARTITION BY sensor, hr) AS has_first FROM g LEFT JOIN a USING (sensor, hr)""")
def d1(spark, d):
    r = resample.calendar(obs(spark, d), ["sensor"], "hr", 1, {"mean": ("mean", "value"), "total": ("sum", "value"), "f": ("first", "value")})
    return rounded(r.select("sensor", "hr", "mean", "total", F.col("f").isNotNull().cast("long").alias("has_first")))


@query("d2_daily_statistics", f"""WITH {HOURLY}, g AS (SELECT sensor, unnest(generate_series(min(hr) // 24 * 24, max(hr), 24)) AS hr FROM hourly GROUP BY 1),
 a AS (SELECT sensor, hr // 24 * 24 AS hr, avg(value) AS m, min(value) AS mi, max(value) AS ma, sum(value) AS s, arg_min(value, hr) FILTER (value IS NOT NULL) AS f FROM hourly GROUP BY 1, 2)
 SELECT sensor, hr, round(m, 4) AS value, round(mi, 4) AS value_min, round(ma, 4) AS value_max, round(coalesce(s, 0), 4) AS value_sum, round(f, 4) AS first_value FROM g LEFT JOIN a USING (sensor, hr)""")
def d2(spark, d):
    h = hourly(spark, d).withColumn("first_value", F.col("value"))
    return rounded(resample.multi_statistics(h, ["sensor"], "hr", 24, ["value"], ["first_value"]))


@query("d3_means_with_suffix", f"WITH {OBS} SELECT sensor, hr // 24 AS day, round(avg(value), 4) AS value_mean, round(sum(k), 4) AS precip_k_sum FROM obs GROUP BY 1, 2")
def d3(spark, d):
    o = obs(spark, d).withColumn("precip_k", F.col("k")).withColumn("day", F.expr("hr div 24"))
    return rounded(resample.means_with_suffix(o, ["sensor", "day"], ["value", "precip_k"]))


@query("d4_accumulate_to_hours", f"WITH {OBS} SELECT sensor, sec // 3600 * 3600 AS sec, round(sum(value), 4) AS value FROM obs GROUP BY 1, 2")
def d4(spark, d):
    return rounded(resample.accumulate(obs(spark, d), ["sensor"], "sec", 3600, "value"))


_KINDS = ["click", "error", "purchase", "signup", "view"]


@query("d5_long_to_wide", f"WITH {OBS} SELECT sensor, hr // 24 AS day, " + ", ".join(f"round(avg(value) FILTER (kind = '{k}'), 4) AS {k}" for k in _KINDS) + " FROM obs GROUP BY 1, 2")
def d5(spark, d):
    return rounded(resample.to_wide(obs(spark, d).withColumn("day", F.expr("hr div 24")), ["sensor", "day"], "kind", "value", _KINDS))


@query("d6_wide_to_long", f"WITH {OBS} SELECT sensor, hr // 24 AS day, kind, round(avg(value), 4) AS value FROM obs WHERE kind IN ({', '.join(repr(k) for k in _KINDS)}) GROUP BY 1, 2, 3 HAVING avg(value) IS NOT NULL")
def d6(spark, d):
    return resample.to_long(d5(spark, d), ["sensor", "day"], _KINDS, "kind")


@query("d7_collapse_duplicates", f"WITH {OBS} SELECT sensor, sec, round(avg(value), 4) AS value FROM obs GROUP BY 1, 2")
def d7(spark, d):
    return rounded(resample.collapse(obs(spark, d), ["sensor", "sec"], "value"))


@query("d8_site_mean", f"WITH {OBS}, n AS (SELECT sensor % 10 AS site, count(DISTINCT sensor) AS c FROM obs GROUP BY 1) SELECT site, hr, round(CASE WHEN count(value) >= greatest(1, floor(0.1 * max(c))) THEN avg(value) END, 4) AS value FROM obs JOIN n ON sensor % 10 = site GROUP BY 1, 2")
def d8(spark, d):
    o = obs(spark, d).withColumn("site", F.col("sensor") % 10)
    n = o.groupBy("site").agg(F.count_distinct("sensor").alias("c"))
    return rounded(resample.site_mean(o.join(F.broadcast(n), "site"), ["site", "hr"], "value", F.col("c"), 0.1))


@query("d9_daily_monthly_means", f"WITH {DAILY} SELECT site, day // 30 AS month, round(avg(q), 4) AS q FROM daily GROUP BY 1, 2")
def d9(spark, d):
    return rounded(resample.collapse(daily(spark, d).withColumn("month", F.expr("day div 30")), ["site", "month"], "q"))


_D10 = f"{DAILY}, k AS (SELECT site, day, q FROM daily)"


@query("d10_composites_to_daily", f"""WITH {_D10}, g AS (SELECT site, unnest(generate_series(min(day), max(day))) AS day FROM k GROUP BY 1),
 p AS (SELECT g.site, g.day, q, max(CASE WHEN q IS NOT NULL THEN g.day END) OVER (PARTITION BY g.site ORDER BY g.day) AS pd, min(CASE WHEN q IS NOT NULL THEN g.day END) OVER (PARTITION BY g.site ORDER BY g.day DESC) AS nd FROM g LEFT JOIN k USING (site, day))
 SELECT p.site, p.day, round(CASE WHEN pd = nd THEN a.q ELSE a.q + (b.q - a.q) * (p.day - pd) / (nd - pd) END, 4) AS q FROM p JOIN k a ON a.site = p.site AND a.day = pd JOIN k b ON b.site = p.site AND b.day = nd""")
def d10(spark, d):
    return rounded(resample.composites_to_daily(daily(spark, d), ["site"], "day", "q"))


@query("d11_annual_to_hourly", "SELECT s_suppkey AS site, unnest(generate_series(0, 8759)) AS hr, s_acctbal AS value FROM supplier")
def d11(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("site"), F.lit(0).cast("long").alias("a"), F.lit(8759).cast("long").alias("b"), F.col("s_acctbal").alias("value"))
    return resample.spread_year(s, ["site"], "a", "b", "value", "hr").select("site", "hr", "value")


@query("d93_average_shared_plants", f"WITH {OBS} SELECT sensor // 3 AS plant, hr, round(avg(value), 4) AS value FROM obs GROUP BY 1, 2")
def d93(spark, d):
    return rounded(resample.collapse(obs(spark, d).withColumn("plant", F.expr("sensor div 3")), ["plant", "hr"], "value"))


# ---- windows


@query("e1_adaptive_centred", f"""WITH {HOURLY}, n AS (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY hr) - 1 AS i, count(*) OVER (PARTITION BY sensor) AS n FROM hourly),
 b AS (SELECT *, CASE WHEN n <= 24 THEN 0 WHEN i + 13 < 24 THEN 0 WHEN i - 12 > n - 24 THEN n - 24 ELSE greatest(0, i - 12) END AS lo, CASE WHEN n <= 24 THEN n WHEN i + 13 < 24 THEN 24 WHEN i - 12 > n - 24 THEN n ELSE least(n, i + 13) END AS hi FROM n)
 SELECT sensor, hr, round(avg(value) OVER (PARTITION BY sensor ORDER BY i ROWS BETWEEN i - lo PRECEDING AND hi - 1 - i FOLLOWING), 4) AS mean FROM b""")
def e1(spark, d):
    return rounded(windows.centred(hourly(spark, d), ["sensor"], "hr", 24, {"mean": lambda w: F.avg("value").over(w)}).select("sensor", "hr", "mean"))


@query("e2_outliers_by_month", f"WITH {HOURLY}, m AS (SELECT sensor, hr, value, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s FROM hourly WINDOW w AS (PARTITION BY sensor, hr // 720)) SELECT sensor, hr, coalesce(abs(value - m) > 2 * s, false) AS outlier FROM m")
def e2(spark, d):
    h = hourly(spark, d).withColumn("month", F.expr("hr div 720"))
    return windows.outliers_by_month(h, ["sensor", "month"], "value", 2.0).select("sensor", "hr", "outlier")


_E5 = "ROWS BETWEEN 24 PRECEDING AND 23 FOLLOWING"


@query("e5_outliers_global_fallback", f"""WITH {HOURLY}, m AS (SELECT sensor, hr, value, count(value) OVER w AS c, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s, avg(value) OVER (PARTITION BY sensor) AS gm, stddev_samp(value) OVER (PARTITION BY sensor) AS gs
 FROM hourly WINDOW w AS (PARTITION BY sensor ORDER BY hr {_E5})) SELECT sensor, hr, coalesce(abs(value - coalesce(CASE WHEN c >= 24 THEN m END, gm)) > 2 * coalesce(CASE WHEN c >= 24 THEN s END, gs), false) AS outlier FROM m""")
def e5(spark, d):
    return windows.outliers_global_fallback(hourly(spark, d), ["sensor"], "hr", "value", 48, 2.0).select("sensor", "hr", "outlier")


def _centred_sql(width: int, value: str = "value") -> str:
    """CTEs up to ``cen`` with the adaptive centred mean m and population deviation s of a column of ``src``."""
    h = width // 2
    return f"""n AS (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY hr) - 1 AS i, count(*) OVER (PARTITION BY sensor) AS n FROM src),
 b AS (SELECT *, CASE WHEN n <= {width} THEN 0 WHEN i + {h} + 1 < {width} THEN 0 WHEN i - {h} > n - {width} THEN n - {width} ELSE greatest(0, i - {h}) END AS lo, CASE WHEN n <= {width} THEN n WHEN i + {h} + 1 < {width} THEN {width} WHEN i - {h} > n - {width} THEN n ELSE least(n, i + {h} + 1) END AS hi FROM n),
 cen AS (SELECT *, avg({value}) OVER (PARTITION BY sensor ORDER BY i ROWS BETWEEN i - lo PRECEDING AND hi - 1 - i FOLLOWING) AS m, stddev_pop({value}) OVER (PARTITION BY sensor ORDER BY i ROWS BETWEEN i - lo PRECEDING AND hi - 1 - i FOLLOWING) AS s FROM b)"""


_E3 = f"WITH {HOURLY}, src AS (SELECT sensor, hr, value FROM hourly), {_centred_sql(24)}, z AS (SELECT *, CASE WHEN s = 0 THEN avg(s) OVER (PARTITION BY sensor) ELSE s END AS sd FROM cen) SELECT sensor, hr, coalesce(abs(value - m) > 2 * sd, false) AS outlier FROM z"


def _half(is_day: str, n_std: float) -> str:
    return f"(WITH src AS (SELECT sensor, hr, CASE WHEN {is_day} THEN value END AS value FROM hourly), {_centred_sql(24)}, z AS (SELECT *, CASE WHEN s = 0 THEN avg(s) OVER (PARTITION BY sensor) ELSE s END AS sd FROM cen) SELECT sensor, hr, coalesce(abs(value - m) > {n_std} * sd, false) AS o FROM z)"


@query("e3_outliers_rolling", _E3)
def e3(spark, d):
    return windows.outliers_rolling(hourly(spark, d), ["sensor"], "hr", "value", 24, 2.0).select("sensor", "hr", "outlier")


_E4 = f"""WITH {HOURLY}, src AS (SELECT sensor, hr, value FROM hourly), {_centred_sql(24)}, l AS (SELECT sensor, hr, value, list(value) FILTER (value IS NOT NULL) OVER (PARTITION BY sensor ORDER BY i ROWS BETWEEN i - lo PRECEDING AND hi - 1 - i FOLLOWING) AS l FROM b),
 m AS (SELECT *, list_aggregate(l, 'median') AS med FROM l) SELECT sensor, hr, coalesce(abs(value - med) > 3 * list_aggregate(list_transform(l, lambda x: abs(x - med)), 'median') / 0.6745, false) AS outlier FROM m"""


@query("e4_outliers_mad", _E4)
def e4(spark, d):
    return windows.outliers_mad(hourly(spark, d), ["sensor"], "hr", "value", 24, 3.0).select("sensor", "hr", "outlier")


@query("e6_day_night_outliers", f"WITH {HOURLY} SELECT sensor, hr, a.o OR b.o AS outlier FROM {_half(DAY, 2.5)} a JOIN {_half(f'NOT ({DAY})', 2.0)} b USING (sensor, hr)")
def e6(spark, d):
    return windows.day_night_outliers(hourly(spark, d), ["sensor"], "hr", "value", F.expr(DAY), 24, 2.5, 2.0).select("sensor", "hr", "outlier")


@query("e7_variability", f"WITH {HOURLY}, src AS (SELECT sensor, hr, value FROM hourly), {_centred_sql(12)} SELECT sensor, hr, coalesce(value IS NOT NULL AND (s / m > 1.0 OR s > 30.0), false) AS unstable FROM cen")
def e7(spark, d):
    return windows.variability(hourly(spark, d), ["sensor"], "hr", "value", 12, 1.0, 30.0).select("sensor", "hr", "unstable")


@query("e8_baseline_drift", f"""WITH {HOURLY}, q AS (SELECT *, CASE WHEN {DAY} THEN NULL ELSE value END AS nv, row_number() OVER (PARTITION BY sensor ORDER BY hr) AS i FROM hourly), rn AS (SELECT *, CASE WHEN count(nv) OVER w >= 2 THEN quantile_cont(nv, 0.1) OVER w END AS m FROM q WINDOW w AS (PARTITION BY sensor ORDER BY hr ROWS BETWEEN 36 PRECEDING AND 36 FOLLOWING)),
 nb AS (SELECT *, max(CASE WHEN m IS NOT NULL THEN i END) OVER (PARTITION BY sensor ORDER BY i) AS pi, min(CASE WHEN m IS NOT NULL THEN i END) OVER (PARTITION BY sensor ORDER BY i DESC) AS ni FROM rn), pv AS (SELECT nb.*, a.m AS p, b.m AS x FROM nb LEFT JOIN rn a ON a.sensor = nb.sensor AND a.i = nb.pi LEFT JOIN rn b ON b.sensor = nb.sensor AND b.i = nb.ni)
 SELECT sensor, hr, round(CASE WHEN value IS NOT NULL THEN greatest(value - coalesce(greatest(coalesce(CASE WHEN pi = ni THEN p ELSE p + (x - p) * (i - pi) / (ni - pi) END, p, x), 0), 0), 0) END, 4) AS corrected FROM pv""")
def e8(spark, d):
    return rounded(windows.baseline(hourly(spark, d), ["sensor"], "hr", "value", ~F.expr(DAY), 72, 0.1, 2).select("sensor", "hr", "corrected"))


@query("e9_window_points", f"WITH {OBS}, x AS (SELECT sensor, sec - lag(sec) OVER (PARTITION BY sensor ORDER BY sec) AS dd FROM obs) SELECT sensor, quantile_cont(dd, 0.5) AS step, CAST(greatest(floor(604800 / quantile_cont(dd, 0.5)), 1) AS BIGINT) AS points FROM x GROUP BY 1 HAVING quantile_cont(dd, 0.5) > 0")
def e9(spark, d):
    return windows.window_points(obs(spark, d), ["sensor"], "sec", 604800).where("step > 0")


@query("e10_rolling", f"""WITH {DAILY} SELECT site, day, {', '.join(f"round(CASE WHEN count(q) OVER w{n} >= 2 THEN {f}(q) OVER w{n} END, 4) AS q_{k}_{n}" for n in (3, 7, 14) for k, f in (('mean', 'avg'), ('std', 'stddev_samp'), ('sum', 'sum')))}
 FROM daily WINDOW {', '.join(f'w{n} AS (PARTITION BY site ORDER BY day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)' for n in (3, 7, 14))}""")
def e10(spark, d):
    out = daily(spark, d).select("site", "day", "q")
    for n in (3, 7, 14):
        out = windows.rolling(out, ["site"], "day", "q", n, 2)
    return rounded(out.drop("q"))


_ISL = f"{HOURLY}, isl AS (SELECT *, hr - row_number() OVER (PARTITION BY sensor, value IS NULL ORDER BY hr) AS g FROM hourly)"


@query("e11_gap_detection", f"WITH {_ISL} SELECT sensor, min(hr) AS gap_start, max(hr) AS gap_end, count(*) AS size FROM isl WHERE value IS NULL GROUP BY sensor, g")
def e11(spark, d):
    return windows.gaps(hourly(spark, d), ["sensor"], "hr", "value")


@query("e12_segments", f"""WITH {OBS}, x AS (SELECT sensor, sec, event_id, sum(CASE WHEN sec - p > 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY sensor ORDER BY sec, event_id) AS s FROM (SELECT *, lag(sec) OVER (PARTITION BY sensor ORDER BY sec, event_id) AS p FROM obs))
 SELECT sensor, s AS segment, count(*) AS n, min(sec) AS seg_start FROM x GROUP BY 1, 2 HAVING count(*) >= 3""")
def e12(spark, d):
    s = windows.segments(obs(spark, d), ["sensor"], "sec", 86400, 3)
    return s.where("segment is not null").groupBy("sensor", "segment").agg(F.count("*").alias("n"), F.min("sec").alias("seg_start"))


@query("e13_segments_relative", f"""WITH {OBS}, l AS (SELECT sensor, sec, sec - lag(sec) OVER (PARTITION BY sensor ORDER BY sec) AS dd FROM obs), m AS (SELECT *, quantile_cont(dd, 0.5) OVER (PARTITION BY sensor) AS med FROM l),
 x AS (SELECT sensor, sec, sum(CASE WHEN dd > 3 * med THEN 1 ELSE 0 END) OVER (PARTITION BY sensor ORDER BY sec) AS s FROM m) SELECT sensor, s AS segment, count(*) AS n FROM x GROUP BY 1, 2 HAVING count(*) >= 2""")
def e13(spark, d):
    s = windows.segments_relative(obs(spark, d), ["sensor"], "sec", 3.0, 2)
    return s.where("segment is not null").groupBy("sensor", "segment").agg(F.count("*").alias("n"))


@query("e14_longest_run", f"WITH {_ISL}, r AS (SELECT sensor, min(hr) AS run_start, max(hr) AS run_end, count(*) AS length FROM isl WHERE value IS NOT NULL GROUP BY sensor, g) SELECT sensor, run_start, run_end, length FROM (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY length DESC, run_start) AS k FROM r WHERE length >= 2) WHERE k = 1")
def e14(spark, d):
    return windows.longest_run(hourly(spark, d), ["sensor"], "hr", "value", 2)


@query("e15_lag_features", f"WITH {DAILY} SELECT site, day, round(lag(q, 1) OVER w, 4) AS q_lag1, round(lag(q, 7) OVER w, 4) AS q_lag7, round(lead(q, 1) OVER w, 4) AS q_lead1, round(q - lag(q) OVER w, 4) AS q_diff FROM daily WINDOW w AS (PARTITION BY site ORDER BY day)")
def e15(spark, d):
    return rounded(windows.lag_features(daily(spark, d).select("site", "day", "q"), ["site"], "day", "q", (1, 7, -1)).drop("q"))


@query("e16_lag_matrix", f"""WITH {DAILY} SELECT site, day, a AS "q_t-2", b AS "q_t-1", q AS "q_t-0" FROM (SELECT *, lag(q, 2) OVER w AS a, lag(q, 1) OVER w AS b, row_number() OVER w AS r FROM daily WINDOW w AS (PARTITION BY site ORDER BY day)) WHERE r >= 3""")
def e16(spark, d):
    return windows.lag_matrix(daily(spark, d).select("site", "day", "q"), ["site"], "day", ["q"], 3).drop("q")


@query("e17_training_windows", f"""WITH {_ISL}, v AS (SELECT sensor, g, hr, value FROM isl WHERE value IS NOT NULL), x AS (SELECT sensor, hr, lead(value, 1) OVER w AS label, lead(hr, 1) OVER w AS target, count(*) OVER (PARTITION BY sensor, g ORDER BY hr ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c,
 sum(value) OVER (PARTITION BY sensor, g ORDER BY hr ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s FROM v WINDOW w AS (PARTITION BY sensor, g ORDER BY hr)) SELECT sensor, hr, target, round(label, 4) AS label, round(s, 4) AS input_sum FROM x WHERE c = 3 AND label IS NOT NULL""")
def e17(spark, d):
    h = windows.islands(hourly(spark, d), ["sensor"], "hr", F.col("value").isNotNull()).where("value is not null")
    t = windows.training_windows(h, ["sensor", "_island"], "hr", "value", "value", 3, 1)
    return rounded(t.select("sensor", "hr", "target", "label", F.aggregate("inputs", F.lit(0.0), lambda a, x: a + x).alias("input_sum")))


@query("e18_prediction_windows", f"WITH {DAILY} SELECT site, day, target, c AS n FROM (SELECT site, day, lead(day, 2) OVER (PARTITION BY site ORDER BY day) AS target, count(*) OVER (PARTITION BY site ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c FROM daily) WHERE c = 5 AND target IS NOT NULL")
def e18(spark, d):
    t = windows.training_windows(daily(spark, d), ["site"], "day", "q", "q", 5, 2)
    return t.select("site", "day", "target", F.size("inputs").cast("long").alias("n"))


@query("e19_since_last_event", f"WITH {DAILY}, x AS (SELECT *, sum(CASE WHEN q > 40 THEN 1 ELSE 0 END) OVER (PARTITION BY site ORDER BY day) AS g FROM daily) SELECT site, day, row_number() OVER (PARTITION BY site, g ORDER BY day) - 1 AS since FROM x")
def e19(spark, d):
    return windows.since_last(daily(spark, d), ["site"], "day", F.col("q") > 40, "since").select("site", "day", F.col("since").cast("long"))


@query("e20_floored_sum", f"WITH {DAILY}, x AS (SELECT site, day, q, sum(coalesce(q - 25, 0)) OVER (PARTITION BY site ORDER BY day) AS s FROM daily) SELECT site, day, round(s - least(0, min(s) OVER (PARTITION BY site ORDER BY day)), 3) AS deficit FROM x")
def e20(spark, d):
    return rounded(windows.floored_sum(daily(spark, d).withColumn("x", F.col("q") - 25), ["site"], "day", "x", "deficit").select("site", "day", "deficit"), 3)


@query("e21_site_z_score", f"WITH {DAILY} SELECT site, day, round((q - avg(q) OVER w) / stddev_samp(q) OVER w, 4) AS z FROM daily WINDOW w AS (PARTITION BY site)")
def e21(spark, d):
    return rounded(windows.z_score(daily(spark, d), ["site"], "q", "z").select("site", "day", "z"))


@query("e22_relative_range", f"WITH {DAILY}, x AS (SELECT site, day, q, quantile_cont(q, 0.05) OVER w AS lo, quantile_cont(q, 0.95) OVER w AS hi FROM daily WINDOW w AS (PARTITION BY site)) SELECT site, day, round(least(greatest((q - lo) / (hi - lo), 0), 1), 4) AS rel FROM x")
def e22(spark, d):
    return rounded(windows.relative_range(daily(spark, d), ["site"], "q", 0.05, 0.95, "rel").select("site", "day", "rel"))


@query("e23_active_season", f"""WITH {DAILY}, m AS (SELECT site, day, avg(q) OVER (PARTITION BY site ORDER BY day ROWS BETWEEN 7 PRECEDING AND 6 FOLLOWING) AS m FROM daily), x AS (SELECT *, quantile_cont(m, 0.05) OVER w AS a, quantile_cont(m, 0.5) OVER w AS b, quantile_cont(m, 0.95) OVER w AS c FROM m WINDOW w AS (PARTITION BY site))
 SELECT site, day, (c - a) / b < 0.3 OR m > 0.2 * c AS season FROM x""")
def e23(spark, d):
    return windows.active_season(daily(spark, d), ["site"], "day", "q").select("site", "day", "season")


@query("e24_season_index", f"WITH {DAILY} SELECT site, day, round(avg(least(greatest((q - 10) / 30, 0), 1) * least(greatest(disc / 0.1, 0), 1)) OVER (PARTITION BY site ORDER BY day ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING), 4) AS gsi FROM daily")
def e24(spark, d):
    return rounded(windows.season_index(daily(spark, d), ["site"], "day", windows.ramp(F.col("q"), 10, 40) * windows.ramp(F.col("disc"), 0, 0.1)).select("site", "day", "gsi"))


_YEAR = f"{DAILY}, y AS (SELECT *, day // 365 AS year FROM daily)"


@query("e25_warm_season", f"""WITH {_YEAR}, r AS (SELECT *, row_number() OVER (PARTITION BY site, year ORDER BY day) - row_number() OVER (PARTITION BY site, year, q > 20 ORDER BY day) AS g FROM y), k AS (SELECT *, row_number() OVER (PARTITION BY site, year, q > 20, g ORDER BY day) AS k FROM r)
 SELECT site, year, min(day) FILTER (q > 20 AND k >= 5) AS season_start, max(day) FILTER (q > 20 AND k >= 5) AS season_end FROM k GROUP BY 1, 2""")
def e25(spark, d):
    y = daily(spark, d).withColumn("year", F.expr("day div 365"))
    return windows.warm_season(y, ["site", "year"], "day", F.col("q") > 20)


@query("e26_degree_day_season", f"""WITH {_YEAR}, c AS (SELECT site, year, day, sum(greatest(q - 20, 0)) OVER (PARTITION BY site, year ORDER BY day) / nullif(sum(greatest(q - 20, 0)) OVER (PARTITION BY site, year), 0) AS p FROM y)
 SELECT site, year, min(day) FILTER (p BETWEEN 0.05 AND 0.95) AS season_start, max(day) FILTER (p BETWEEN 0.05 AND 0.95) AS season_end FROM c GROUP BY 1, 2""")
def e26(spark, d):
    y = daily(spark, d).withColumn("year", F.expr("day div 365"))
    g = windows.degree_day_season(y.withColumn("_keep", F.lit(1)), ["site", "year"], "day", F.col("q") - 20)
    return g


@query("e27_phenology", f"""WITH {_YEAR}, s AS (SELECT site, year, day, avg(q) OVER (PARTITION BY site, year ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS s FROM y),
 x AS (SELECT *, floor((s - lag(s) OVER (PARTITION BY site, year ORDER BY day)) * 1e6 + 0.5) AS st, min(s) OVER (PARTITION BY site, year) AS lo, max(s) OVER (PARTITION BY site, year) AS hi FROM s)
 SELECT site, year, min(day) FILTER (s > lo + 0.5 * (hi - lo)) AS above_start, max(day) FILTER (s > lo + 0.5 * (hi - lo)) AS above_end, arg_min(day, struct_pack(a := coalesce(-st, 1e300), b := day)) AS rise, arg_min(day, struct_pack(a := coalesce(st, 1e300), b := day)) AS fall FROM x GROUP BY 1, 2""")
def e27(spark, d):
    return windows.phenology(daily(spark, d).withColumn("year", F.expr("day div 365")), ["site", "year"], "day", "q")


@query("e28_moisture_season", f"WITH {DAILY} SELECT site, day, avg(q) OVER w > 25.0001 AND sum(disc) OVER w / sum(n) OVER w > 0.0490001 AS moist FROM daily WINDOW w AS (PARTITION BY site ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)")
def e28(spark, d):
    return windows.moisture_season(daily(spark, d), ["site"], "day", "q", "disc", "n", 25.0001, 0.0490001).select("site", "day", "moist")


@query("e30_flux_from_total", f"WITH {HOURLY}, x AS (SELECT sensor, hr, value, value - lag(value) OVER (PARTITION BY sensor ORDER BY hr) AS dd FROM hourly) SELECT sensor, hr, round(least(greatest(CASE WHEN dd < 0 THEN value ELSE dd END / 3600, 0), 1500), 6) AS flux FROM x WHERE dd IS NOT NULL")
def e30(spark, d):
    return rounded(windows.flux_from_total(hourly(spark, d), ["sensor"], "hr", "value", 3600).withColumn("d", F.col("value") - F.lag("value").over(Window.partitionBy("sensor").orderBy("hr"))).where("d is not null").select("sensor", "hr", "flux"), 6)


_E31 = "CASE " + " ".join(f"WHEN n >= 7 AND {c} THEN list_inner_product({v}, {[float(x) for x in windows.local_weights(7)[p]]}::DOUBLE[])" for c, v, p in [(f"i = {k + 1}", "l[1:7]", k) for k in range(3)] + [(f"i = n - {k}", "l[n - 6:n]", 6 - k) for k in range(3)]) + " WHEN n >= 7 THEN list_inner_product(l[i - 3:i + 3], [-2, 3, 6, 7, 6, 3, -2]::DOUBLE[]) / 21 ELSE q END"


@query("e31_savitzky_golay", f"WITH {DAILY}, a AS (SELECT site, list(q ORDER BY day)::DOUBLE[] AS l, count(*) AS n FROM daily GROUP BY 1), x AS (SELECT site, day, q, row_number() OVER (PARTITION BY site ORDER BY day) AS i FROM daily) SELECT site, day, round({_E31}, 4) AS smooth FROM x JOIN a USING (site)")
def e31(spark, d):
    return rounded(windows.savitzky_golay(daily(spark, d), ["site"], "day", "q", 7).select("site", "day", "smooth"))


@query("e32_abrupt_change", f"WITH {DAILY} SELECT site, round(max(x), 4) AS max_step FROM (SELECT site, abs(q - lag(q) OVER (PARTITION BY site ORDER BY day)) AS x FROM daily) GROUP BY 1")
def e32(spark, d):
    return rounded(windows.largest_step(daily(spark, d), ["site"], "day", "q"))


@query("e33_padded_sequences", f"WITH {DAILY}, x AS (SELECT site, day, row_number() OVER (PARTITION BY site ORDER BY day) AS r, first_value(q) OVER (PARTITION BY site ORDER BY day) AS f, sum(q) OVER (PARTITION BY site ORDER BY day ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS s FROM daily) SELECT site, day, 24 AS n, round(s + f * greatest(0, 24 - r), 3) AS total FROM x")
def e33(spark, d):
    s = windows.sequences(daily(spark, d).select("site", "day", "q"), ["site"], "day", "q")
    return rounded(s.select("site", "day", F.size("sequence").alias("n"), F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x).alias("total")), 3)


# ---- filling

_NB_TAIL = """rn AS (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY hr) AS i FROM hourly),
 nb AS (SELECT *, max(CASE WHEN value IS NOT NULL THEN i END) OVER (PARTITION BY sensor ORDER BY i) AS pi, min(CASE WHEN value IS NOT NULL THEN i END) OVER (PARTITION BY sensor ORDER BY i DESC) AS ni FROM rn),
 pv AS (SELECT nb.*, a.value AS p, b.value AS x FROM nb LEFT JOIN rn a ON a.sensor = nb.sensor AND a.i = nb.pi LEFT JOIN rn b ON b.sensor = nb.sensor AND b.i = nb.ni)"""
_NB = f"{HOURLY}, {_NB_TAIL}"


@query("f1_linear_fill", f"WITH {_NB} SELECT sensor, hr, round(greatest(coalesce(CASE WHEN pi = ni THEN p ELSE p + (x - p) * (i - pi) / (ni - pi) END, p, x), 0), 4) AS filled FROM pv WHERE coalesce(p, x) IS NOT NULL")
def f1(spark, d):
    return rounded(fill.linear(hourly(spark, d), ["sensor"], "hr", "value").where("filled is not null").select("sensor", "hr", "filled"))


@query("f2_nearest_fill", f"WITH {_NB} SELECT sensor, hr, round(CASE WHEN i - pi <= ni - i THEN p ELSE x END, 4) AS filled FROM pv WHERE p IS NOT NULL AND x IS NOT NULL")
def f2(spark, d):
    return rounded(fill.nearest(hourly(spark, d), ["sensor"], "hr", "value").where("filled is not null").select("sensor", "hr", "filled"))


_AKIMA = f"""WITH {_NB}, k AS (SELECT sensor, i AS x, value AS y, (lead(value) OVER w - value) / (lead(i) OVER w - i) AS m, count(*) OVER (PARTITION BY sensor) AS c FROM rn WHERE value IS NOT NULL WINDOW w AS (PARTITION BY sensor ORDER BY i)),
 a AS (SELECT *, lag(m, 1) OVER w AS p1, lag(m, 2) OVER w AS p2, lead(m, 1) OVER w AS n1 FROM k WINDOW w AS (PARTITION BY sensor ORDER BY x)), b AS (SELECT * REPLACE (coalesce(m, 2 * p1 - p2) AS m), m AS seg FROM a), e AS (SELECT * REPLACE (coalesce(p1, 2 * m - n1) AS p1) FROM b),
 g AS (SELECT * REPLACE (coalesce(n1, 2 * m - p1) AS n1, coalesce(p2, 2 * p1 - m) AS p2) FROM e), h AS (SELECT *, CASE WHEN abs(n1 - m) + abs(p1 - p2) > 1e-9 THEN (abs(n1 - m) * p1 + abs(p1 - p2) * m) / (abs(n1 - m) + abs(p1 - p2)) ELSE (p1 + m) / 2 END AS t FROM g),
 s AS (SELECT *, lead(x) OVER w - x AS hh, lead(t) OVER w AS t1 FROM h WINDOW w AS (PARTITION BY sensor ORDER BY x)), n4 AS (SELECT sensor, count(value) AS c FROM rn GROUP BY 1),
 z AS (SELECT pv.sensor, hr, CASE WHEN value IS NOT NULL THEN value WHEN n4.c < 4 THEN coalesce(CASE WHEN pi = ni THEN p ELSE p + (pv.x - p) * (i - pi) / (ni - pi) END, p, pv.x)
  WHEN hh IS NOT NULL THEN y + t * (i - s.x) + (3 * seg - 2 * t - t1) / hh * (i - s.x) ** 2 + (t + t1 - 2 * seg) / hh ** 2 * (i - s.x) ** 3 END AS z FROM pv JOIN n4 ON n4.sensor = pv.sensor LEFT JOIN s ON s.sensor = pv.sensor AND s.x = pv.pi)
 SELECT sensor, hr, CASE WHEN z IS NOT NULL THEN round(greatest(z, 0), 4) END AS filled FROM z"""


@query("f3_akima_fill", _AKIMA)
def f3(spark, d):
    return rounded(fill.akima(hourly(spark, d), ["sensor"], "hr", "value").select("sensor", "hr", "filled"))


def _then_linear(source: str) -> str:
    return f"{HOURLY}, {_then_tail(source)}"


def _then_tail(source: str) -> str:
    return f"""st AS ({source}), rn AS (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY hr) AS i FROM st),
 nb AS (SELECT *, max(CASE WHEN m IS NOT NULL THEN i END) OVER (PARTITION BY sensor ORDER BY i) AS pi, min(CASE WHEN m IS NOT NULL THEN i END) OVER (PARTITION BY sensor ORDER BY i DESC) AS ni FROM rn),
 pv AS (SELECT nb.*, a.m AS p, b.m AS x FROM nb LEFT JOIN rn a ON a.sensor = nb.sensor AND a.i = nb.pi LEFT JOIN rn b ON b.sensor = nb.sensor AND b.i = nb.ni)"""


_LIN = "SELECT sensor, hr, round(greatest(coalesce(CASE WHEN pi = ni THEN p ELSE p + (x - p) * (i - pi) / (ni - pi) END, p, x), 0), 4) AS filled FROM pv WHERE coalesce(p, x) IS NOT NULL"


@query("f4_mean_diurnal_fill", f"WITH {_then_linear('SELECT sensor, hr, coalesce(value, avg(value) OVER (PARTITION BY sensor, hr % 24 ORDER BY hr RANGE BETWEEN 168 PRECEDING AND 168 FOLLOWING)) AS m FROM hourly')} {_LIN}")
def f4(spark, d):
    return rounded(fill.mean_diurnal(hourly(spark, d), ["sensor"], "hr", "value").where("filled is not null").select("sensor", "hr", "filled"))


@query("f5_rolling_mean_fill", f"WITH {_then_linear('SELECT sensor, hr, coalesce(value, CASE WHEN count(value) OVER w >= 12 THEN avg(value) OVER w END) AS m FROM hourly WINDOW w AS (PARTITION BY sensor ORDER BY hr ROWS BETWEEN 24 PRECEDING AND 23 FOLLOWING)')} {_LIN}")
def f5(spark, d):
    return rounded(fill.rolling_mean(hourly(spark, d), ["sensor"], "hr", "value").where("filled is not null").select("sensor", "hr", "filled"))


def _every_day(spark, d):
    """site, day, q: every day between a site's first and last, and one span of twenty days in twelve without values."""
    c = resample.calendar(daily(spark, d), ["site"], "day", 1, {"q": ("mean", "q")})
    return c.withColumn("q", F.when(F.expr("day div 20 % 12 <> 0"), F.col("q")))


EVERY_DAY = f"""{DAILY}, every AS (SELECT site AS sensor, day AS hr, CASE WHEN day // 20 % 12 <> 0 THEN q END AS value FROM (SELECT site, unnest(generate_series(min(day), max(day))) AS day FROM daily GROUP BY site) LEFT JOIN daily USING (site, day))"""
_DAILY_LIN = _LIN.replace("sensor, hr", "sensor AS site, hr AS day")


@query("f4_mean_weekday_fill", f"WITH {EVERY_DAY}, {_then_tail('SELECT sensor, hr, coalesce(value, avg(value) OVER (PARTITION BY sensor, hr % 7 ORDER BY hr RANGE BETWEEN 7 PRECEDING AND 7 FOLLOWING)) AS m FROM every')} {_DAILY_LIN}")
def f4_daily(spark, d):
    return rounded(fill.mean_diurnal(_every_day(spark, d), ["site"], "day", "q", daily=True).where("filled is not null").select("site", "day", "filled"))


@query("f5_rolling_mean_daily", f"WITH {EVERY_DAY}, {_then_tail('SELECT sensor, hr, coalesce(value, CASE WHEN count(value) OVER w >= 1 THEN avg(value) OVER w END) AS m FROM every WINDOW w AS (PARTITION BY sensor ORDER BY hr ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)')} {_DAILY_LIN}")
def f5_daily(spark, d):
    return rounded(fill.rolling_mean(_every_day(spark, d), ["site"], "day", "q", daily=True).where("filled is not null").select("site", "day", "filled"))


@query("f6_seasonal_fill")
def f6(spark, d):
    return rounded(fill.seasonal(hourly(spark, d), ["sensor"], "hr", "value").where("filled is not null").select("sensor", "hr", "filled"))


@query("f7_fill_features", f"WITH {HOURLY} SELECT sensor, hr, lag(value, 1) OVER w AS lag_1, lag(value, 24) OVER w AS lag_24, hr % 24 AS hour, round(avg(value) OVER (PARTITION BY sensor ORDER BY hr ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 4) AS roll_mean, CASE WHEN {DAY} THEN 1 ELSE 0 END AS daytime FROM hourly WINDOW w AS (PARTITION BY sensor ORDER BY hr)")
def f7(spark, d):
    x = fill.lag_features(hourly(spark, d), ["sensor"], "hr", "value").select("sensor", "hr", "lag_1", "lag_24", "hour", "roll_mean", "daytime")
    return x.withColumn("roll_mean", near("roll_mean", 4))


def _rows_with_spans(spark, d):
    """site, i, day, v: a site's days with items in order, one span of twenty days in twelve without values."""
    i = F.row_number().over(Window.partitionBy("site").orderBy("day"))
    return daily(spark, d).select("site", "day", i.alias("i"), F.when(F.expr("day div 20 % 12 <> 0"), F.col("q")).alias("v"))


_F9 = f"""WITH {DAILY}, s AS (SELECT site, day, row_number() OVER (PARTITION BY site ORDER BY day) AS i, CASE WHEN day // 20 % 12 <> 0 THEN q END AS v FROM daily),
 f AS (SELECT *, list(v) OVER w AS l, count(v) OVER w AS c, avg(v) OVER r AS rm, coalesce(stddev_samp(v) OVER r, 0) AS rs, DATE '1970-01-01' + CAST(day AS INT) AS dt FROM s WINDOW w AS (PARTITION BY site ORDER BY i ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), r AS (PARTITION BY site ORDER BY i ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
 x AS (SELECT site, i, v, list_concat(l, [CAST(dayofyear(dt) AS DOUBLE), CAST(month(dt) AS DOUBLE), rm, rs]) AS x FROM f WHERE c = 24),
 sp AS (SELECT site, p, avg(e) AS m, stddev_pop(e) AS sd FROM (SELECT site, unnest(range(1, 29)) AS p, unnest(x) AS e FROM x WHERE v IS NOT NULL) GROUP BY 1, 2),
 sz AS (SELECT site, list(m ORDER BY p) AS m, list(CASE WHEN sd > 0 THEN sd ELSE 1 END ORDER BY p) AS sd FROM sp GROUP BY 1), tn AS (SELECT site FROM x WHERE v IS NOT NULL GROUP BY 1 HAVING count(*) >= 50),
 z AS (SELECT x.site, i, v, list_transform(range(1, 29), lambda p: (x[p] - m[p]) / sd[p]) AS z FROM x JOIN sz USING (site) JOIN tn USING (site)), kk AS (SELECT site, least(10, greatest(1, floor(count(v) * 0.1))) AS k FROM s GROUP BY 1),
 nn AS (SELECT a.site, a.i, b.v, row_number() OVER (PARTITION BY a.site, a.i ORDER BY list_distance(a.z, b.z), b.i) AS r FROM z a JOIN z b ON a.site = b.site AND a.v IS NULL AND b.v IS NOT NULL),
 pr AS (SELECT nn.site, nn.i, avg(v) AS p FROM nn JOIN kk ON nn.site = kk.site AND r <= k GROUP BY 1, 2), m AS (SELECT s.site AS sensor, s.i AS hr, coalesce(v, p) AS m FROM s LEFT JOIN pr ON pr.site = s.site AND pr.i = s.i)"""


@query("f9_nearest_rows_fill", f"{_F9}, {_then_tail('SELECT sensor, hr, m FROM m')} {_LIN.replace('sensor, hr', 'sensor AS site, hr AS i')}")
def f9(spark, d):
    s = _rows_with_spans(spark, d)
    when = F.date_from_unix_date(F.col("day").cast("int"))
    return rounded(fill.nearest_in_lags(s, ["site"], "i", "v", F.lit(0), F.dayofyear(when), F.month(when)).where("filled is not null").select("site", "i", "filled"))


_LINE = "greatest(coalesce(CASE WHEN pi = ni THEN p ELSE p + (x - p) * (i - pi) / (ni - pi) END, p, x), 0)"
_F11A = f"WITH {_NB_TAIL} SELECT sensor, hr, {_LINE} AS a FROM pv"
_F11B = f"WITH {_then_tail('SELECT sensor, hr, coalesce(value, avg(value) OVER (PARTITION BY sensor, hr % 24 ORDER BY hr RANGE BETWEEN 168 PRECEDING AND 168 FOLLOWING)) AS m FROM hourly')} SELECT sensor, hr, {_LINE} AS b FROM pv"


@query("f11_two_step_fill", f"WITH {_ISL}, z AS (SELECT *, CASE WHEN value IS NULL THEN count(*) OVER (PARTITION BY sensor, g, value IS NULL) END AS size FROM isl) SELECT sensor, hr, round(CASE WHEN value IS NOT NULL THEN value WHEN size <= 3 THEN a WHEN size <= 24 THEN b END, 4) AS filled FROM z LEFT JOIN ({_F11A}) USING (sensor, hr) LEFT JOIN ({_F11B}) USING (sensor, hr)")
def f11(spark, d):
    return rounded(fill.fill_small_gaps(hourly(spark, d), ["sensor"], "hr", "value").select("sensor", "hr", "filled"))


@query("f12_fill_mask", f"WITH {HOURLY} SELECT sensor, hr, value IS NULL AND count(value) OVER (PARTITION BY sensor ORDER BY hr) > 0 AND count(value) OVER (PARTITION BY sensor ORDER BY hr DESC) > 0 AS was_filled FROM hourly")
def f12(spark, d):
    return fill.nearest(hourly(spark, d), ["sensor"], "hr", "value").select("sensor", "hr", fill.gap_mask("value", "filled").alias("was_filled"))


@query("f14_climatology_fill", f"WITH {_YEAR} SELECT site, day, round(coalesce(CASE WHEN day % 5 <> 0 THEN q END, avg(CASE WHEN day % 5 <> 0 THEN q END) OVER (PARTITION BY site, (day % 365) // 4)), 4) AS filled FROM y")
def f14(spark, d):
    y = daily(spark, d).withColumn("v", F.when(F.col("day") % 5 != 0, F.col("q")))
    return rounded(fill.bin_climatology(y, ["site"], F.col("day") % 365 + 1, "v").select("site", "day", "filled"))


# ---- joins


@query("c1_inner_on_time", f"WITH {OBS}, a AS (SELECT sensor, hr, avg(value) AS v FROM obs WHERE kind = 'view' GROUP BY 1, 2), b AS (SELECT sensor, hr, avg(value) AS e FROM obs WHERE kind = 'click' GROUP BY 1, 2) SELECT sensor, hr, round(v, 4) AS v, round(e, 4) AS e FROM a JOIN b USING (sensor, hr)")
def c1(spark, d):
    o = obs(spark, d)
    a = o.where("kind = 'view'").groupBy("sensor", "hr").agg(F.avg("value").alias("v"))
    return rounded(a.join(o.where("kind = 'click'").groupBy("sensor", "hr").agg(F.avg("value").alias("e")), ["sensor", "hr"]))


@query("c2_left_metadata", "SELECT l_orderkey, l_linenumber, p_brand AS species FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON l_partkey = p_partkey")
def c2(spark, d):
    p = table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("species"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(joins.small(p), "l_partkey", "left").drop("l_partkey")


@query("c3_static_attributes", "SELECT s_suppkey AS site, n_name AS stand, r_name AS biome, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3")
def c3(spark, d):
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    dim = s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("stand"), F.col("r_name").alias("biome"))
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n")).join(dim, "l_suppkey").withColumnRenamed("l_suppkey", "site")


_ASOF = f"{OBS}, l AS (SELECT event_id, sensor, sec FROM obs WHERE kind = 'purchase'), r AS (SELECT sensor, sec, max(k) AS k FROM obs WHERE kind = 'view' GROUP BY 1, 2)"
_NEAR = """p AS (SELECT l.*, (SELECT max(sec) FROM r WHERE r.sensor = l.sensor AND r.sec <= l.sec) AS b, (SELECT min(sec) FROM r WHERE r.sensor = l.sensor AND r.sec > l.sec) AS f FROM l),
 m AS (SELECT event_id, sensor, sec, CASE WHEN b IS NULL THEN f WHEN f IS NULL OR sec - b <= f - sec THEN b ELSE f END AS t FROM p)"""


def _asof(spark, d, **kw):
    o = obs(spark, d)
    left, right = o.where("kind = 'purchase'").select("event_id", "sensor", "sec"), o.where("kind = 'view'").groupBy("sensor", "sec").agg(F.max("k").alias("k"))
    return joins.asof(left, right, ["sensor"], "sec", ["k"], **kw).select("event_id", "sec_matched", "k")


@query("c4_nearest_asof", f"WITH {_ASOF}, {_NEAR} SELECT event_id, m.t AS sec_matched, r.k FROM m LEFT JOIN r ON r.sensor = m.sensor AND r.sec = m.t")
def c4(spark, d):
    return _asof(spark, d)


@query("c5_nearest_asof_tolerance", f"WITH {_ASOF}, {_NEAR} SELECT event_id, CASE WHEN abs(m.sec - m.t) <= 43200 THEN m.t END AS sec_matched, CASE WHEN abs(m.sec - m.t) <= 43200 THEN r.k END AS k FROM m LEFT JOIN r ON r.sensor = m.sensor AND r.sec = m.t")
def c5(spark, d):
    return _asof(spark, d, tolerance=43200)


@query("c6_backward_asof", f"WITH {_ASOF} SELECT event_id, r.sec AS sec_matched, r.k FROM l ASOF LEFT JOIN r ON l.sensor = r.sensor AND l.sec >= r.sec")
def c6(spark, d):
    return _asof(spark, d, direction="backward")


@query("c7_upsample_forward_fill", f"""WITH {_D10}, g AS (SELECT site, unnest(generate_series(min(day), max(day))) AS day FROM k GROUP BY 1) SELECT g.site, g.day, k.q FROM g ASOF JOIN k ON g.site = k.site AND g.day >= k.day""")
def c7(spark, d):
    return joins.forward_fill(daily(spark, d), ["site"], "day", ["q"], 1)


@query("c8_interval_join", f"WITH {OBS}, {_LOG_SQL} SELECT event_id, EXISTS (SELECT 1 FROM spans WHERE sensor BETWEEN lo AND hi AND sec BETWEEN s AND e) AS matched FROM obs")
def c8(spark, d):
    o = obs(spark, d).select("event_id", F.col("sensor").alias("site"), "sec")
    return joins.in_intervals(o, _rules(spark), ["site"], "sec", "start", "end").select("event_id", "matched")


@query("c9_strict_overlap", f"WITH {OBS}, a AS (SELECT sensor, hr // 24 AS day, bool_or(value IS NOT NULL) AS ok FROM obs WHERE kind = 'view' GROUP BY 1, 2), b AS (SELECT sensor, hr // 24 AS day, bool_and(value IS NOT NULL) AS ok FROM obs WHERE kind <> 'view' GROUP BY 1, 2) SELECT sensor, count(*) AS n_days FROM a JOIN b USING (sensor, day) WHERE a.ok AND b.ok GROUP BY 1")
def c9(spark, d):
    o = obs(spark, d).withColumn("day", F.expr("hr div 24"))
    a = o.where("kind = 'view'").groupBy("sensor", "day").agg(F.bool_or(F.col("value").isNotNull()).alias("any"))
    b = o.where("kind <> 'view'").groupBy("sensor", "day").agg(F.bool_and(F.col("value").isNotNull()).alias("all"))
    return a.join(b, ["sensor", "day"]).where("any and all").groupBy("sensor").agg(F.count("*").alias("n_days"))


@query("c18_time_overlap", f"WITH {OBS}, a AS (SELECT sensor, min(sec) AS s, max(sec) AS e FROM obs WHERE kind = 'view' GROUP BY 1), b AS (SELECT sensor, min(sec) AS s, max(sec) AS e FROM obs WHERE kind = 'click' GROUP BY 1) SELECT sensor FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.sensor = a.sensor AND a.s <= b.e AND b.s <= a.e)")
def c18(spark, d):
    o = obs(spark, d)
    a, b = (o.where(F.col("kind") == k).groupBy("sensor").agg(F.min("sec").alias("s"), F.max("sec").alias("e")) for k in ("view", "click"))
    return a.alias("a").join(b.alias("b"), F.expr("a.sensor = b.sensor and a.s <= b.e and b.s <= a.e"), "left_semi").select("sensor")


@query("c19_source_fallback", f"WITH {OBS}, s AS (SELECT sensor, CASE kind WHEN 'purchase' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS source, avg(value) AS v FROM obs GROUP BY 1, 2) SELECT sensor, min(source) AS source, round(arg_min(v, source), 4) AS v FROM s WHERE v IS NOT NULL GROUP BY 1")
def c19(spark, d):
    o = obs(spark, d)
    parts = [o.where(c).groupBy("sensor").agg(F.avg("value").alias("v")) for c in ("kind = 'purchase'", "kind = 'view'", "kind not in ('purchase', 'view')")]
    return rounded(joins.fallback(parts, ["sensor"], "v"))


@query("c22_full_outer_counts", f"WITH {_ISL}, h AS (SELECT sensor, count(DISTINCT g) AS n_hourly FROM isl WHERE value IS NULL GROUP BY 1), dd AS (SELECT sensor, count(*) AS n_daily FROM (SELECT sensor, hr // 24 FROM hourly GROUP BY 1, 2 HAVING count(value) = 0) GROUP BY 1) SELECT sensor, coalesce(n_hourly, 0) AS n_hourly, coalesce(n_daily, 0) AS n_daily FROM h FULL JOIN dd USING (sensor)")
def c22(spark, d):
    h = hourly(spark, d)
    a = windows.gaps(h, ["sensor"], "hr", "value").groupBy("sensor").agg(F.count("*").alias("n_hourly"))
    b = h.groupBy("sensor", F.expr("hr div 24").alias("day")).agg(F.count("value").alias("c")).where("c = 0").groupBy("sensor").agg(F.count("*").alias("n_daily"))
    return a.join(b, "sensor", "full").fillna(0)


@query("c23_reconciliation", f"WITH {OBS}, a AS (SELECT event_id, value FROM obs WHERE event_id % 10 <> 1), b AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN value + 1 ELSE value END AS value FROM obs WHERE event_id % 10 <> 2), j AS (SELECT a.event_id AS ia, b.event_id AS ib, a.value AS va, b.value AS vb FROM a FULL JOIN b ON a.event_id = b.event_id)"
       " SELECT CAST(count(*) FILTER (ia IS NOT NULL AND ib IS NOT NULL) AS BIGINT) AS n_both, CAST(count(*) FILTER (ib IS NULL) AS BIGINT) AS n_only_a, CAST(count(*) FILTER (ia IS NULL) AS BIGINT) AS n_only_b, CAST(count(*) FILTER (ia IS NOT NULL AND ib IS NOT NULL AND NOT coalesce(abs(va - vb) < 0.001, va IS NULL AND vb IS NULL)) AS BIGINT) AS n_differ FROM j")
def c23(spark, d):
    o = obs(spark, d).select("event_id", "value")
    return joins.reconcile(o.where("event_id % 10 <> 1"), o.where("event_id % 10 <> 2").withColumn("value", F.when(F.col("event_id") % 13 == 0, F.col("value") + 1).otherwise(F.col("value"))), ["event_id"], "value", 0.001)


@query("c28_previous_day_amounts", f"WITH {DAILY}, a AS (SELECT site, day - 1 AS day, q AS moved FROM daily) SELECT site, day, coalesce(moved, 0) AS moved FROM daily LEFT JOIN a USING (site, day)")
def c28(spark, d):
    k = daily(spark, d).select("site", "day", "q")
    return k.join(k.select("site", (F.col("day") - 1).alias("day"), F.col("q").alias("moved")), ["site", "day"], "left").select("site", "day", F.coalesce("moved", F.lit(0.0)).alias("moved"))


# ---- site summaries


@query("d12_site_statistics", f"""WITH {HOURLY}, m AS (SELECT *, avg(value) OVER (PARTITION BY sensor) AS mu, stddev_pop(value) OVER (PARTITION BY sensor) AS sg FROM hourly)
 SELECT sensor, count(*) AS n, count(value) AS n_valid, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, round(var_samp(value), 4) AS var, round(min(value), 4) AS min, round(max(value), 4) AS max,
 round(avg(pow((value - mu) / nullif(sg, 0), 3)), 3) AS skew, round(avg(pow((value - mu) / nullif(sg, 0), 4)) - 3, 3) AS kurtosis, CAST(count(*) FILTER (value = 0) AS BIGINT) AS n_zero, CAST(count(*) FILTER (value < 0) AS BIGINT) AS n_negative,
 {', '.join(f"round(quantile_cont(value, {q}), 4) AS {n}" for q, n in ((0.01, 'p01'), (0.05, 'p05'), (0.25, 'p25'), (0.5, 'median'), (0.75, 'p75'), (0.95, 'p95'), (0.99, 'p99')))},
 round(100.0 * (count(*) - count(value)) / count(*), 4) AS missing_pct, round(stddev_samp(value) / avg(value), 4) AS cv, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 4) AS iqr, round(max(value) - min(value), 4) AS range FROM m GROUP BY 1 HAVING stddev_pop(value) > 0""")
def d12(spark, d):
    s = stats.describe(hourly(spark, d), ["sensor"], "value").where("std > 0")
    return rounded(s.withColumn("skew", near("skew", 3)).withColumn("kurtosis", near("kurtosis", 3)))


@query("d19_site_years", f"WITH {DAILY}, x AS (SELECT site, day, day - lag(day) OVER (PARTITION BY site ORDER BY day) AS s FROM daily) SELECT site, round(coalesce(sum(s) FILTER (s <= 7), 0) / 365.25, 4) AS site_years, round(100.0 * coalesce(sum(s) FILTER (s <= 7), 0) / (max(day) - min(day)), 4) AS coverage_pct FROM x GROUP BY 1")
def d19(spark, d):
    return rounded(stats.site_years(daily(spark, d), ["site"], "day", 7, 365.25))


@query("d27_daily_completeness", f"WITH {HOURLY} SELECT sensor, hr // 24 AS day, CAST(count(*) FILTER ({DAY} AND value IS NOT NULL) AS BIGINT) AS valid, CAST(count(*) FILTER ({DAY}) AS BIGINT) AS expected, coalesce(count(*) FILTER ({DAY} AND value IS NOT NULL) >= 0.5 * nullif(count(*) FILTER ({DAY}), 0), false) AS kept FROM hourly GROUP BY 1, 2")
def d27(spark, d):
    return stats.daily_completeness(hourly(spark, d).withColumn("day", F.expr("hr div 24")), ["sensor", "day"], "value", F.expr(DAY), 0.5)


@query("d28_reversed_days", f"""WITH {OBS}, q AS (SELECT kind, hr // 24 AS day, hr % 24 BETWEEN 6 AND 20 AS dy, value, quantile_cont(value, 0.85) OVER (PARTITION BY kind, hr // 24) AS q FROM obs), g AS (SELECT kind, day, avg(value) FILTER (dy) AS md, avg(value) FILTER (NOT dy) AS mn, count(value) FILTER (dy) AS nd, count(value) FILTER (NOT dy) AS nn,
 count(*) FILTER (value >= q) AS t, count(*) FILTER (value >= q AND NOT dy) AS tn FROM q GROUP BY 1, 2) SELECT kind, day, round(md, 4) AS mean_day, round(mn, 4) AS mean_night, coalesce((nd >= 3 AND nn >= 3 AND 0.8 * md < mn - 0.5) OR (nd + nn >= 10 AND tn / t > 0.3), false) AS reversed FROM g""")
def d28(spark, d):
    o = obs(spark, d).withColumn("day", F.expr("hr div 24"))
    return rounded(stats.reversed_days(o, ["kind", "day"], "value", F.expr(DAY)))


@query("d29_source_agreement", f"WITH {OBS}, a AS (SELECT sensor, hr, avg(value) AS a FROM obs WHERE kind = 'view' GROUP BY 1, 2), b AS (SELECT sensor, hr, avg(value) AS b FROM obs WHERE kind = 'click' GROUP BY 1, 2), j AS (SELECT sensor % 10 AS site, a, b FROM a JOIN b USING (sensor, hr) WHERE a IS NOT NULL AND b IS NOT NULL)"
       " SELECT site, count(*) AS n, round(corr(a, b), 4) AS r, round(avg(b - a), 4) AS bias, round(sqrt(avg((b - a) * (b - a))), 4) AS rmse, round(avg(abs(b - a)), 4) AS mae, round(corr(a, b) * corr(a, b), 4) AS r2, coalesce(corr(a, b) * corr(a, b) >= 0.5, false) AS good FROM j GROUP BY 1 HAVING count(*) > 1")
def d29(spark, d):
    o = obs(spark, d)
    a, b = (o.where(F.col("kind") == k).groupBy("sensor", "hr").agg(F.avg("value").alias(n)) for k, n in (("view", "a"), ("click", "b")))
    return rounded(stats.agreement(a.join(b, ["sensor", "hr"]).withColumn("site", F.col("sensor") % 10), ["site"], "a", "b").where("n > 1"))


@query("d32_diurnal_lookup", f"WITH {OBS} SELECT sensor, hr % 24 AS hour, round(coalesce(avg(value) FILTER (value <> 0), 0), 4) AS lookup FROM obs GROUP BY 1, 2")
def d32(spark, d):
    return rounded(stats.diurnal_lookup(obs(spark, d).withColumn("hour", F.col("hr") % 24), ["sensor", "hour"], "value"))


@query("c21_lookup_join", f"WITH {OBS}, l AS (SELECT sensor % 20 AS s, hr % 24 AS hour, avg(value) AS v FROM obs WHERE hr % 48 < 24 GROUP BY 1, 2) SELECT event_id, round(coalesce(v, 0), 4) AS predicted FROM obs LEFT JOIN l ON sensor % 20 = s AND hr % 24 = hour WHERE hr % 48 >= 24")
def c21(spark, d):
    o = obs(spark, d).withColumn("s", F.col("sensor") % 20).withColumn("hour", F.col("hr") % 24)
    look = o.where("hr % 48 < 24").groupBy("s", "hour").agg(F.avg("value").alias("v"))
    return rounded(o.where("hr % 48 >= 24").join(joins.small(look), ["s", "hour"], "left").select("event_id", F.coalesce("v", F.lit(0.0)).alias("predicted")))


@query("d91_value_histogram", f"WITH {OBS} SELECT kind, CASE WHEN value < 0 THEN 0 WHEN value >= 100 THEN 21 ELSE CAST(floor(value / 5.0) + 1 AS BIGINT) END AS bin, count(*) AS n FROM obs WHERE value IS NOT NULL GROUP BY 1, 2")
def d91(spark, d):
    return stats.histogram(obs(spark, d), ["kind"], "value", 0.0, 100.0, 20)


@query("d25_min_max_scaling", f"WITH {OBS} SELECT event_id, round((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()), 3) AS value FROM obs")
def d25(spark, d):
    return stats.min_max_scale(obs(spark, d).select(F.col("event_id"), "value"), ["value"])


@query("g4_mode", "SELECT l_suppkey AS site, arg_min(p_brand, struct_pack(a := -c, b := p_brand)) AS mode, round(max(c) / sum(c), 4) AS share FROM (SELECT l_suppkey, p_brand, count(*) AS c FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) GROUP BY 1")
def g4(spark, d):
    j = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).withColumnRenamed("l_suppkey", "site")
    return rounded(stats.mode(j, ["site"], "p_brand"))
