"""Queries over sources, splits, models, census, set operations and the remaining summaries."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import scalars
from gridloom.operators import backtest, clean, fill, grid as g, joins, polygons, resample, skill, split, stats, windows
from gridloom.sources import io, vocabulary
from gridloom.streaming import incremental

from . import ml
from .base import DAILY, GRID, HOURLY, OBS, SCORED, daily, grid, hourly, near, obs, query, rounded, scored, table
from .q_series import _ISL, _LINE, DAY, _rows_with_spans, _then_tail


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the one that executors share; a temporary one only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ---- sources and sinks


@query("a1_sensor_csv_scan", f"WITH {OBS} SELECT 's' || (sensor % 3) AS site, kind AS sensor, round(avg(value), 4) AS mean, count(value) AS n FROM (SELECT sensor, event_id, kind, value FROM obs) WHERE kind IN ('click', 'view') GROUP BY 1, 2")
def a1(spark, d):
    path = scratch(spark, "csv")
    o = obs(spark, d)
    for k in range(3):  # three site files
        wide = o.where(f"sensor % 3 = {k}").select("event_id", *(F.coalesce(F.when(F.col("kind") == c, F.col("value")).cast("string"), F.lit("NA")).alias(c) for c in ("click", "view")))
        wide.write.option("header", True).csv(f"{path}/s{k}.csv")
    long = io.sensor_csv(spark, f"{path}/*.csv", "event_id", ["click", "view"], r"/(s\d)\.csv/")
    return rounded(long.groupBy("site", "sensor").agg(F.avg("value").alias("mean"), F.count("value").alias("n")))


@query("a2_environment_csv_scan", f"WITH {OBS} SELECT kind, count(*) AS n, round(avg(value), 4) AS ta, round(avg(k), 4) AS vpd FROM obs GROUP BY 1")
def a2(spark, d):
    path = scratch(spark, "csv")
    obs(spark, d).select("event_id", "kind", F.col("value").alias("ta"), F.col("k").alias("vpd")).write.option("header", True).option("nullValue", "NA").csv(path)
    e = io.site_csv(spark, path, "event_id long, kind string, ta double, vpd double")
    return rounded(e.groupBy("kind").agg(F.count("*").alias("n"), F.avg("ta").alias("ta"), F.avg("vpd").alias("vpd")))


@query("a3_read_by_extension", "SELECT count(*) AS n, round(sum(o_totalprice), 1) AS total FROM orders")
def a3(spark, d):
    return io.read_any(spark, f"{d}/orders.parquet").agg(F.count("*").alias("n"), (F.round(F.sum("o_totalprice"), 1)).alias("total"))


@query("a4_pruned_read", "SELECT l_suppkey, l_quantity FROM lineitem")
def a4(spark, d):
    return io.read_any(spark, f"{d}/lineitem.parquet", ["l_suppkey", "l_quantity"])


@query("a5_compressed_write", "SELECT l_returnflag, count(*) AS n, round(sum(l_tax), 3) AS tax FROM lineitem GROUP BY 1")
def a5(spark, d):
    path = scratch(spark, "out")
    io.write(table(spark, d, "lineitem").select("l_returnflag", "l_tax"), path)
    return rounded(spark.read.parquet(path).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_tax").alias("tax")), 3)


@query("a6_csv_to_parquet", "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1")
def a6(spark, d):
    csv, out = scratch(spark, "c") + ".csv", scratch(spark, "p")
    table(spark, d, "customer").write.option("header", True).csv(csv)
    io.write(io.read_any(spark, csv), out, compression="snappy")
    return rounded(spark.read.parquet(out).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("balance")), 2)


@query("a8_partition_selection", "SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, count(*) AS n FROM orders WHERE year(o_orderdate) = 1997 AND month(o_orderdate) <= 3 GROUP BY 1, 2")
def a8(spark, d):
    path = scratch(spark, "by")
    o = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").cast("long").alias("year"), F.month("o_orderdate").cast("long").alias("month"))
    io.write(o.repartition("year", "month"), path, by=["year", "month"])
    r = spark.read.schema("o_orderkey long, year long, month long").parquet(path).where("year = 1997 and month <= 3")
    return r.groupBy("year", "month").agg(F.count("*").alias("n"))


@query("a9_merge_parts", f"WITH {DAILY} SELECT site, day, q, CASE WHEN day % 2 = 0 THEN disc END AS disc FROM daily")
def a9(spark, d):
    k = daily(spark, d)
    return io.merge([k.where("day % 2 = 0").select("site", "day", "q", "disc"), k.where("day % 2 <> 0").select("site", "day", "q")], ["day", "site"])


@query("a10_incremental_months", "SELECT CAST(month(o_orderdate) AS BIGINT) AS month, count(*) AS n FROM orders GROUP BY 1")
def a10(spark, d):
    src, out, check = (scratch(spark, n) for n in ("src", "dst", "chk"))
    o = table(spark, d, "orders").select("o_orderkey", F.month("o_orderdate").cast("long").alias("month"))
    for part in ("month <= 6", "month > 6"):  # the second run sees new files only
        o.where(part).coalesce(1).write.mode("append").parquet(src)
        incremental.process_new(spark, src, "o_orderkey long, month long", out, check, lambda s: s)
    return spark.read.parquet(out).groupBy("month").agg(F.count("*").alias("n"))


@query("a11_biome_split_and_union", "SELECT r_name AS biome, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def a11(spark, d):
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    path = scratch(spark, "biome")
    io.write(s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select("s_suppkey", F.col("r_name").alias("biome")), path, by=["biome"])
    return spark.read.schema("s_suppkey long, biome string").parquet(path).groupBy("biome").agg(F.count("*").alias("n"))


@query("a12_vendor_columns", "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0.04 THEN l_tax ELSE l_discount END AS ta, CASE WHEN l_discount > 0.05 THEN l_discount ELSE l_quantity END AS vpd FROM lineitem")
def a12(spark, d):
    v = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_tax") > 0.04, F.col("l_tax")).alias("TA_F"), F.col("l_discount").alias("TA_1_1_1"), F.when(F.col("l_discount") > 0.05, F.col("l_discount")).alias("VPD_ERA"), F.col("l_quantity").alias("VPD_2_1_1"))
    return io.to_standard(v, {"l_orderkey": ["l_orderkey"], "l_linenumber": ["l_linenumber"], "ta": ["TA_F", "TA_ERA", "TA_1_1_1"], "vpd": ["VPD_F", "VPD_ERA", "VPD_2_1_1"]})


@query("a13_header_vocabulary", "SELECT s_suppkey AS si_code, s_acctbal AS si_elev FROM supplier")
def a13(spark, d):
    raw = table(spark, d, "supplier").withColumnsRenamed({"s_suppkey": "Site Code", "s_acctbal": "Elevation (m)"})
    return vocabulary.standard_header(raw, vocabulary.SITE).select("si_code", "si_elev")


@query("a16_variable_names", f"WITH {OBS} SELECT sensor, hr, max(value) AS temperature FROM obs WHERE event_id % 2 = 1 GROUP BY 1, 2")
def a16(spark, d):
    o = obs(spark, d).withColumn("expver", F.col("event_id") % 2).withColumn("number", F.lit(0)).withColumnsRenamed({"value": "t2m", "hr": "valid_time"})
    g = vocabulary.standard_grid(o)
    return g.groupBy("sensor", F.col("time").alias("hr")).agg(F.max("2m_temperature").alias("temperature"))


@query("a17_flexible_timestamps", f"WITH {OBS} SELECT event_id, CAST(sec // 60 * 60 AS BIGINT) AS sec FROM obs")
def a17(spark, d):
    o = obs(spark, d)
    text = F.when(F.col("sensor") % 2 == 0, F.date_format(F.timestamp_seconds("sec"), "yyyy-MM-dd HH:mm")).otherwise(F.date_format(F.timestamp_seconds("sec"), "dd/MM/yyyy HH:mm"))
    p = io.parse_times(o.select("event_id", (F.col("sensor") % 2).alias("file"), text.alias("txt")), ["file"], "txt", ["yyyy-MM-dd HH:mm", "MM.dd.yyyy", "dd/MM/yyyy HH:mm"])
    return p.select("event_id", F.unix_seconds("ts").alias("sec"))


@query("a18_synthesised_times", "SELECT s_suppkey, unnest(generate_series(0, s_suppkey % 5 * 60, 30)) AS t FROM supplier")
def a18(spark, d):
    m = table(spark, d, "supplier").select("s_suppkey", F.lit(0).cast("long").alias("a"), (F.col("s_suppkey") % 5 * 60).alias("b"), F.lit(30).cast("long").alias("s"))
    return io.synthesise_times(m, "a", "b", "s").select("s_suppkey", "t")


@query("a19_product_load", f"WITH {GRID} SELECT product, lat, lon, day, round(abs(v) * 0.0353, 5) AS v FROM grid WHERE lat BETWEEN -40 AND 60 AND day BETWEEN 19725 AND 19740")
def a19(spark, d):
    p = grid(spark, d).where("lat between -40 and 60 and day between 19725 and 19740")
    return p.select("product", "lat", "lon", "day", near(F.abs("v") * 0.0353, 5).alias("v"))


@query("a20_daily_cell_means", f"WITH {OBS} SELECT hr // 24 AS day, round_even(sensor * 0.25, 0) AS lat, round(avg(value), 4) AS v FROM obs GROUP BY 1, 2")
def a20(spark, d):
    return rounded(obs(spark, d).groupBy(F.expr("hr div 24").alias("day"), F.bround(F.col("sensor") * F.lit(0.25), 0).alias("lat")).agg(F.avg("value").alias("v")))


@query("a21_manifest")
def a21(spark, d):
    return io.manifest(daily(spark, d), ["site"])


@query("a24_time_from_parts", "SELECT l_orderkey, l_linenumber, CAST(epoch(make_date(2000 + l_linenumber, 1, 1)) AS BIGINT) + (l_partkey % 365) * 86400 + (l_suppkey % 24) * 3600 AS sec FROM lineitem")
def a24(spark, d):
    t = io.time_of_year(F.lit(2000) + F.col("l_linenumber"), F.col("l_partkey") % 365 + 1, F.col("l_suppkey") % 24)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.unix_seconds(t).alias("sec"))


@query("a25_yearly_parts", "SELECT 'site' || (o_orderkey % 4) AS site, count(*) AS n, CAST(count(DISTINCT year(o_orderdate)) AS BIGINT) AS years FROM orders GROUP BY 1")
def a25(spark, d):
    o = table(spark, d, "orders").select(F.concat(F.lit("site"), (F.col("o_orderkey") % 4).cast("string"), F.lit("_"), F.year("o_orderdate").cast("string")).alias("file"))
    path = scratch(spark, "years")
    io.write(o.withColumn("k", F.lit(1)), path, by=["file"])
    r = spark.read.schema("k int, file string").parquet(path)
    base = F.regexp_replace("file", r"_\d{4}$", "")
    return r.groupBy(base.alias("site")).agg(F.count("*").alias("n"), F.count_distinct("file").alias("years"))


# ---- cleaning, continued

_UNIT = "CASE p_partkey % 5 WHEN 0 THEN 'cm3 cm-2 h-1' WHEN 1 THEN 'g h-1' WHEN 2 THEN 'kg/h' WHEN 3 THEN 'L 30min' ELSE 'other' END"


@query("b11_unit_factors", f"SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 1000.0 WHEN 3 THEN 1000.0 END AS factor, CASE WHEN p_partkey % 5 = 3 THEN 30 END AS minutes FROM part")
def b11(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.expr(_UNIT).alias("unit"))
    u = F.col("unit")
    parsed = p.select("unit").distinct().withColumn("factor", F.when(u.rlike(r"^cm3 cm-2"), 1.0).when(u.rlike(r"^g\b"), 1.0).when(u.rlike(r"^kg\b"), 1000.0).when(u.rlike(r"^L\b"), 1000.0)).withColumn("minutes", F.expr("try_cast(regexp_extract(unit, '([0-9]+)min', 1) as int)"))
    return p.join(F.broadcast(parsed), "unit").select("p_partkey", "factor", "minutes")


@query("b12_unit_conversion", "SELECT l_suppkey, round(sum(l_quantity * CASE l_partkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 1000.0 ELSE 0.001 END), 3) AS total FROM lineitem GROUP BY 1")
def b12(spark, d):
    f = spark.createDataFrame([(0, 1.0), (1, 1000.0), (2, 0.001)], "u long, factor double")
    j = table(spark, d, "lineitem").withColumn("u", F.col("l_partkey") % 3).join(F.broadcast(f), "u")
    return rounded(j.groupBy("l_suppkey").agg(F.sum(F.col("l_quantity") * F.col("factor")).alias("total")), 3)


_EL = "degrees(asin(sin(radians(sensor * 37 % 138 - 60.0)) * sin(-0.4) + cos(radians(sensor * 37 % 138 - 60.0)) * cos(-0.4) * cos(radians(15 * (hr % 24 - 12)))))"


@query("b14_solar_daytime", f"WITH {HOURLY} SELECT sensor, CAST(count(*) FILTER ({_EL} > 0) AS BIGINT) AS n_day FROM hourly GROUP BY 1")
def b14(spark, d):
    lat = (F.col("sensor") * 37 % 138 - 60).cast("double")
    phi, h = F.radians(lat), F.radians(15 * (F.col("hr") % 24 - 12).cast("double"))
    el = F.degrees(F.asin(F.sin(phi) * F.sin(F.lit(-0.4)) + F.cos(phi) * F.cos(F.lit(-0.4)) * F.cos(h)))
    return hourly(spark, d).groupBy("sensor").agg(F.count_if(el > 0).alias("n_day"))


@query("b17_forest_cells", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) + (CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END) = 1 AND l_quantity >= 10")
def b17(spark, d):
    li = table(spark, d, "lineitem").withColumn("a", (F.col("l_discount") > 0.05).cast("int")).withColumn("b", (F.col("l_tax") > 0.04).cast("int"))
    return li.where("a + b = 1 and l_quantity >= 10").dropna(subset=["l_quantity"]).select("l_orderkey", "l_linenumber")


@query("b19_cell_table_mask", f"WITH {GRID} SELECT product, lat, lon, day, v FROM grid g WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT lat, lon FROM grid WHERE product = 'view' AND v > 30) c WHERE c.lat = g.lat AND c.lon = g.lon)")
def b19(spark, d):
    k = grid(spark, d)
    return k.join(k.where("product = 'view' and v > 30").select("lat", "lon").distinct(), ["lat", "lon"], "left_semi").select("product", "lat", "lon", "day", "v")


_POLY = """sites AS (SELECT s_suppkey AS id, CAST(s_suppkey * 29 % 130 - 55 AS DOUBLE) + 0.35 AS y, CAST(s_suppkey * 41 % 330 - 165 AS DOUBLE) + 0.45 AS x, s_suppkey % 5 AS k FROM supplier),
 e AS (SELECT id, unnest([{'x1': x - 7.3 - k, 'y1': y, 'x2': x, 'y2': y + 5.1 + k}, {'x1': x, 'y1': y + 5.1 + k, 'x2': x + 9.7, 'y2': y + 0.2}, {'x1': x + 9.7, 'y1': y + 0.2, 'x2': x, 'y2': y - 6.9}, {'x1': x, 'y1': y - 6.9, 'x2': x - 7.3 - k, 'y2': y},
  {'x1': x - 1.6, 'y1': y, 'x2': x, 'y2': y + 1.8}, {'x1': x, 'y1': y + 1.8, 'x2': x + 2.2, 'y2': y + 0.1}, {'x1': x + 2.2, 'y1': y + 0.1, 'x2': x, 'y2': y - 1.4}, {'x1': x, 'y1': y - 1.4, 'x2': x - 1.6, 'y2': y}]) AS e FROM sites),
 cand AS (SELECT id, CAST(floor(y + 90) AS BIGINT) + i AS row, CAST(floor(x + 180) AS BIGINT) + j AS col FROM sites, generate_series(-9, 11) a(i), generate_series(-14, 12) b(j)),
 inside AS (SELECT id, row, col FROM cand JOIN e USING (id) WHERE (e.y1 <= row - 89.5) <> (e.y2 <= row - 89.5) AND e.x1 + (row - 89.5 - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1) <= col - 179.5 GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1),
 crossed AS (SELECT DISTINCT id, row, col FROM cand JOIN e USING (id) WHERE greatest(0, least((col - 180 - e.x1) / (e.x2 - e.x1), (col - 179 - e.x1) / (e.x2 - e.x1)), least((row - 90 - e.y1) / (e.y2 - e.y1), (row - 89 - e.y1) / (e.y2 - e.y1)))
  <= least(1, greatest((col - 180 - e.x1) / (e.x2 - e.x1), (col - 179 - e.x1) / (e.x2 - e.x1)), greatest((row - 90 - e.y1) / (e.y2 - e.y1), (row - 89 - e.y1) / (e.y2 - e.y1))))"""
_WORLD = (-180.0, -90.0, 1.0)


def _polygons(spark, d):
    """Edges of a four-sided polygon with a hole around each supplier's place."""
    s = table(spark, d, "supplier").selectExpr("s_suppkey as id", "cast(s_suppkey * 29 % 130 - 55 as double) + 0.35d as y", "cast(s_suppkey * 41 % 330 - 165 as double) + 0.45d as x", "s_suppkey % 5 as k")
    at = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    outer = F.array(F.struct((F.col("x") - 7.3 - F.col("k")).alias("x"), F.col("y")), F.struct(F.col("x"), (F.col("y") + 5.1 + F.col("k")).alias("y")), at(9.7, 0.2), at(0.0, -6.9))
    return polygons.edges(s.select("id", F.array(outer, F.array(at(-1.6, 0.0), at(0.0, 1.8), at(2.2, 0.1), at(0.0, -1.4))).alias("rings")), ["id"], "rings")


@query("b19_cells_touched", f"WITH {_POLY} SELECT * FROM inside UNION SELECT * FROM crossed")
def b19_touched(spark, d):
    return polygons.cells_touched(_polygons(spark, d), ["id"], _WORLD)


@query("b19_polygon_mask", f"WITH {GRID}, {_POLY} SELECT product, lat, lon, day, v FROM grid WHERE EXISTS (SELECT 1 FROM inside WHERE row = floor(lat + 90) AND col = floor(lon + 180))")
def b19_mask(spark, d):
    return polygons.mask_cells(grid(spark, d), _polygons(spark, d), ["id"], _WORLD, "lon", "lat", touched=False).select("product", "lat", "lon", "day", "v")


@query("b20_cells_by_code", f"WITH {GRID} SELECT lat - 0.5 AS south, lat + 0.5 AS north, lon - 0.5 AS west, lon + 0.5 AS east FROM (SELECT DISTINCT lat, lon FROM grid WHERE CAST(lat + lon AS BIGINT) % 4 IN (1, 2))")
def b20(spark, d):
    c = grid(spark, d).where(((F.col("lat") + F.col("lon")).cast("long") % 4).isin(1, 2)).select("lat", "lon").distinct()
    return c.select((F.col("lat") - 0.5).alias("south"), (F.col("lat") + 0.5).alias("north"), (F.col("lon") - 0.5).alias("west"), (F.col("lon") + 0.5).alias("east"))


@query("b23_mapping_verification", f"WITH {SCORED} SELECT method, round(100 * avg(CASE WHEN abs(y - yhat) < 20 THEN 1.0 ELSE 0.0 END), 4) AS match_pct FROM scored GROUP BY 1")
def b23(spark, d):
    return rounded(scored(spark, d).groupBy("method").agg((100 * F.avg((F.abs(F.col("y") - F.col("yhat")) < 20).cast("double"))).alias("match_pct")))


@query("b24_region_crop", f"WITH {GRID} SELECT product, day, count(*) AS n FROM grid WHERE lat BETWEEN 0 AND 50 AND lon BETWEEN -100 AND 60 GROUP BY 1, 2")
def b24(spark, d):
    return grid(spark, d).where("lat between 0 and 50 and lon between -100 and 60").groupBy("product", "day").agg(F.count("*").alias("n"))


@query("b29_site_flags", f"""WITH {OBS}, s AS (SELECT sensor, avg(value) AS mean, max(value) AS max, 100.0 * count(*) FILTER (value = 0) / count(*) AS zp, 100.0 * (count(*) - count(value)) / count(*) AS mp FROM obs GROUP BY 1 HAVING count(value) > 2), z AS (SELECT *, abs(mean - avg(mean) OVER ()) / stddev_samp(mean) OVER () AS z FROM s)
 SELECT sensor, concat_ws(';', CASE WHEN z > 3 THEN 'extreme_mean' END, CASE WHEN zp > 50 THEN 'zeros' END, CASE WHEN max / mean > 20 THEN 'peaks' END, CASE WHEN mp > 50 THEN 'missing' END) AS reasons FROM z""")
def b29(spark, d):
    s = obs(spark, d).groupBy("sensor").agg(F.avg("value").alias("mean"), F.max("value").alias("max"), (100 * F.count_if(F.col("value") == 0) / F.count("*")).alias("zeros_pct"), (100 * (F.count("*") - F.count("value")) / F.count("*")).alias("missing_pct"), F.count("value").alias("c"), F.lit(0.0).alias("negatives_pct"), F.lit(0.0).alias("skew")).where("c > 2")
    return clean.site_flags(s).select("sensor", "reasons")


@query("b30_time_slice", f"WITH {OBS} SELECT event_id FROM obs WHERE sec BETWEEN epoch(TIMESTAMP '2024-01-05 06:00:00') AND epoch(TIMESTAMP '2024-01-12 00:00:00')")
def b30(spark, d):
    return obs(spark, d).where(F.timestamp_seconds("sec").between(F.lit("2024-01-05 06:00:00").cast("timestamp"), F.lit("2024-01-12 00:00:00").cast("timestamp"))).select("event_id")


@query("b32_propagate_mask", f"WITH {OBS} SELECT event_id, CASE WHEN value IS NOT NULL THEN k END AS static FROM obs")
def b32(spark, d):
    return obs(spark, d).select("event_id", F.when(F.col("value").isNotNull(), F.col("k")).alias("static"))


# ---- joins, continued


@query("c10_reindex_nearest", f"WITH {GRID}, r AS (SELECT DISTINCT lat + 0.3 AS lat, lon - 0.2 AS lon FROM grid WHERE product = 'click'), p AS (SELECT DISTINCT lat AS clat, lon AS clon FROM grid WHERE product = 'view'), m AS (SELECT r.lat, r.lon, clat, clon FROM r JOIN p ON pow(r.lat - clat, 2) + pow(r.lon - clon, 2) <= 0.25) SELECT round(r.lat, 2) AS lat, round(r.lon, 2) AS lon, m.clat, m.clon FROM r LEFT JOIN m ON m.lat = r.lat AND m.lon = r.lon")
def c10(spark, d):
    k = grid(spark, d)
    ref = k.where("product = 'click'").select((F.col("lat") + 0.3).alias("lat"), (F.col("lon") - 0.2).alias("lon")).distinct().withColumn("id", F.concat_ws("/", "lat", "lon"))
    cells = k.where("product = 'view'").select(F.col("lat").alias("clat"), F.col("lon").alias("clon")).distinct()
    return rounded(joins.nearest_cell(ref, cells, ["id"], 1.0, 0.5, []).select("lat", "lon", "clat", "clon"), 2)


@query("c13_ring_search", f"WITH {GRID}, c AS (SELECT CAST(lat AS BIGINT) AS r, CAST(lon AS BIGINT) AS c, max(v) AS v FROM grid GROUP BY 1, 2), p AS (SELECT s_suppkey AS id, s_suppkey * 29 % 130 - 55 AS r, s_suppkey * 41 % 350 - 175 AS c FROM supplier), m AS (SELECT p.id, c.v, greatest(abs(c.r - p.r), abs(c.c - p.c)) AS ring, c.r - p.r AS dy, c.c - p.c AS dx FROM p JOIN c ON abs(c.r - p.r) <= 3 AND abs(c.c - p.c) <= 3),"
       " b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ring, dy, dx) AS k FROM m) SELECT p.id, b.v, CAST(b.ring AS INT) AS ring FROM p LEFT JOIN b ON b.id = p.id AND k = 1")
def c13(spark, d):
    cells = grid(spark, d).groupBy(F.col("lat").cast("long").alias("row"), F.col("lon").cast("long").alias("col")).agg(F.max("v").alias("v"))
    p = table(spark, d, "supplier").selectExpr("s_suppkey as id", "s_suppkey * 29 % 130 - 55 as row", "s_suppkey * 41 % 350 - 175 as col")
    return joins.ring_search(p, cells, ["id"], 3, "v").select("id", "v", "ring")


@query("c20_column_to_plant", "SELECT c_custkey, coalesce(e.p_partkey, t.p_partkey) AS plant FROM customer LEFT JOIN part e ON c_custkey % 400 = e.p_partkey AND e.p_size > 25 LEFT JOIN part t ON c_custkey % 100 = t.p_partkey")
def c20(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("T"), (F.col("c_custkey") % 400).cast("string"), F.lit("_S"), (F.col("c_custkey") % 100).cast("string")).alias("col"))
    p = table(spark, d, "part").select("p_partkey", "p_size")
    tree, sensor = F.regexp_extract("col", r"^T(\d+)", 1).cast("long"), F.regexp_extract("col", r"_S(\d+)$", 1).cast("long")
    e = p.where("p_size > 25").select(F.col("p_partkey").alias("tree"), F.col("p_partkey").alias("e"))
    s = p.select(F.col("p_partkey").alias("sensor"), F.col("p_partkey").alias("s"))
    j = c.withColumn("tree", tree).withColumn("sensor", sensor).join(joins.small(e), "tree", "left").join(joins.small(s), "sensor", "left")
    return j.select("c_custkey", F.coalesce("e", "s").alias("plant"))


@query("c25_predictions_to_rows", f"WITH {SCORED}, p AS (SELECT site, avg(yhat) AS pred FROM scored GROUP BY 1) SELECT s_suppkey AS site, round(pred, 4) AS pred FROM supplier LEFT JOIN p ON site = s_suppkey")
def c25(spark, d):
    p = resample.collapse(scored(spark, d), ["site"], "yhat").withColumnRenamed("yhat", "pred")
    return rounded(table(spark, d, "supplier").select(F.col("s_suppkey").alias("site")).join(p, "site", "left"))


@query("c26_two_step_fallback", "SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, CASE WHEN c_custkey % 3 = 0 THEN 100.0 END) AS age FROM customer")
def c26(spark, d):
    c = table(spark, d, "customer")
    a, b = c.where("c_acctbal > 0").select("c_custkey", F.col("c_acctbal").alias("a")), c.where("c_custkey % 3 = 0").select("c_custkey", F.lit(100.0).alias("b"))
    return c.select("c_custkey").join(a, "c_custkey", "left").join(b, "c_custkey", "left").select("c_custkey", F.coalesce("a", "b").alias("age"))


@query("c29_daily_merge", f"WITH {OBS}, a AS (SELECT sensor, hr // 24 AS day, avg(value) AS v FROM obs WHERE kind = 'view' GROUP BY 1, 2), b AS (SELECT sensor, hr // 24 AS day, avg(k) AS e FROM obs GROUP BY 1, 2) SELECT sensor, day, round(v, 4) AS v, round(e, 4) AS e FROM a JOIN b USING (sensor, day)")
def c29(spark, d):
    o = obs(spark, d).withColumn("day", F.expr("hr div 24"))
    return rounded(o.where("kind = 'view'").groupBy("sensor", "day").agg(F.avg("value").alias("v")).join(o.groupBy("sensor", "day").agg(F.avg("k").alias("e")), ["sensor", "day"]))


# ---- summaries, continued


@query("d13_trait_statistics", "SELECT p_brand, count(*) AS n, CAST(count(*) FILTER (p_size > 10) AS BIGINT) AS n_estimable, round(avg(p_size), 4) AS mean_size, CAST(count(DISTINCT p_type) AS BIGINT) AS n_types FROM part GROUP BY 1")
def d13(spark, d):
    return rounded(table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.count_if(F.col("p_size") > 10).alias("n_estimable"), F.avg("p_size").alias("mean_size"), F.count_distinct("p_type").alias("n_types")))


@query("d14_environment_statistics", f"WITH {OBS}, u AS (SELECT sensor, 'value' AS var, value AS x FROM obs UNION ALL SELECT sensor, 'k', k FROM obs) SELECT sensor, var, count(x) AS n, round(avg(x), 4) AS mean, round(min(x), 4) AS min, round(max(x), 4) AS max FROM u GROUP BY 1, 2")
def d14(spark, d):
    u = obs(spark, d).select("sensor", "value", "k").unpivot(["sensor"], ["value", "k"], "var", "x")
    return rounded(u.groupBy("sensor", "var").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.min("x").alias("min"), F.max("x").alias("max")))


@query("d15_cross_site_summary", f"WITH {DAILY}, s AS (SELECT site, avg(q) AS m, count(*) AS n FROM daily GROUP BY 1) SELECT count(*) AS n_sites, CAST(sum(n) AS BIGINT) AS n_rows, round(avg(m), 4) AS mean, round(stddev_samp(m), 4) AS std FROM s")
def d15(spark, d):
    s = daily(spark, d).groupBy("site").agg(F.avg("q").alias("m"), F.count("*").alias("n"))
    return rounded(s.agg(F.count("*").alias("n_sites"), F.sum("n").alias("n_rows"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("std")))


@query("d16_biome_roll_up", "SELECT coalesce(r_name, 'all') AS biome, count(*) AS n, round(avg(s_acctbal), 4) AS mean FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name)")
def d16(spark, d):
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    j = s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])
    return rounded(j.rollup("r_name").agg(F.count("*").alias("n"), F.avg("s_acctbal").alias("mean")).select(F.coalesce("r_name", F.lit("all")).alias("biome"), "n", "mean"))


@query("d17_sensor_summary", f"WITH {OBS} SELECT sensor, kind, count(value) AS n, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.25), 4) AS p25, round(quantile_cont(value, 0.75), 4) AS p75, min(sec) AS first_sec, max(sec) AS last_sec FROM obs GROUP BY 1, 2")
def d17(spark, d):
    q = F.expr("percentile(value, array(0.25, 0.75))")
    a = obs(spark, d).groupBy("sensor", "kind").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), q.alias("q"), F.min("sec").alias("first_sec"), F.max("sec").alias("last_sec"))
    return rounded(a.select("sensor", "kind", "n", "mean", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p75"), "first_sec", "last_sec"))


@query("d18_filter_statistics", f"WITH {OBS} SELECT sensor, count(*) AS n, CAST(count(*) FILTER (k > 90) AS BIGINT) AS removed, round(100.0 * count(*) FILTER (k > 90) / count(*), 4) AS removed_pct FROM obs GROUP BY 1")
def d18(spark, d):
    r = F.count_if(F.col("k") > 90)
    return rounded(obs(spark, d).groupBy("sensor").agg(F.count("*").alias("n"), r.alias("removed"), (100 * r / F.count("*")).alias("removed_pct")))


@query("d20_best_file_per_site", f"WITH {DAILY}, x AS (SELECT site, n % 2 AS file, day, day - lag(day) OVER (PARTITION BY site, n % 2 ORDER BY day) AS s FROM daily), y AS (SELECT site, file, coalesce(sum(s) FILTER (s <= 7), 0) / 365.25 AS yrs FROM x GROUP BY 1, 2) SELECT site, file, round(yrs, 4) AS site_years FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY yrs DESC, file) AS r FROM y) WHERE r = 1")
def d20(spark, d):
    y = stats.site_years(daily(spark, d).withColumn("file", F.col("n") % 2), ["site", "file"], "day", 7, 365.25)
    best = skill.rank_methods(y, ["site"], "file", "site_years", 1)
    return rounded(best.select("site", "file", "site_years"))


@query("d21_joint_years", f"WITH {HOURLY}, v AS (SELECT sensor, hr, hr - lag(hr) OVER (PARTITION BY sensor ORDER BY hr) AS s FROM hourly WHERE value IS NOT NULL) SELECT sensor, round(count(*) * quantile_cont(s, 0.5) / 8766, 5) AS years FROM v GROUP BY 1 HAVING count(s) > 0")
def d21(spark, d):
    v = hourly(spark, d).where("value is not null").withColumn("s", F.col("hr") - F.lag("hr").over(Window.partitionBy("sensor").orderBy("hr")))
    return rounded(v.groupBy("sensor").agg((F.count("*") * F.expr("percentile(s, 0.5)") / 8766).alias("years"), F.count("s").alias("c")).where("c > 0").drop("c"), 5)


@query("d22_site_extents", f"WITH {OBS} SELECT sensor, min(sec) AS first_sec, max(sec) AS last_sec, CAST(sensor * 37 % 138 - 60 AS DOUBLE) AS lat FROM obs GROUP BY 1")
def d22(spark, d):
    return obs(spark, d).groupBy("sensor").agg(F.min("sec").alias("first_sec"), F.max("sec").alias("last_sec")).withColumn("lat", (F.col("sensor") * 37 % 138 - 60).cast("double"))


@query("d23_plant_to_site", "WITH j AS (SELECT l_suppkey AS site, p_size, p_brand, p_type FROM lineitem JOIN part ON l_partkey = p_partkey), m AS (SELECT site, p_type, count(*) AS c FROM j GROUP BY 1, 2) SELECT j.site, count(*) AS n, round(avg(p_size), 4) AS mean_dbh, round(stddev_samp(p_size), 4) AS std_dbh, CAST(count(DISTINCT p_brand) AS BIGINT) AS n_species, (SELECT arg_min(p_type, struct_pack(a := -c, b := p_type)) FROM m WHERE m.site = j.site) AS dominant FROM j GROUP BY 1")
def d23(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size", "p_brand", "p_type")
    j = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("site"), "l_partkey").join(joins.small(p), "l_partkey")
    a = j.groupBy("site").agg(F.count("*").alias("n"), F.avg("p_size").alias("mean_dbh"), F.stddev_samp("p_size").alias("std_dbh"), F.count_distinct("p_brand").alias("n_species"))
    return rounded(a.join(stats.mode(j, ["site"], "p_type").select("site", F.col("mode").alias("dominant")), "site"))


@query("d24_soil_profile", "WITH x AS (SELECT l_suppkey AS site, CASE WHEN l_linenumber <> 3 THEN l_quantity END AS sand, CASE WHEN l_linenumber <> 2 THEN l_discount END AS clay, l_linenumber * 10.0 AS w FROM lineitem) SELECT site, round(sum(sand * w) / sum(w) FILTER (sand IS NOT NULL), 4) AS sand, round(sum(coalesce(clay, 0) * w) FILTER (sand IS NOT NULL) / sum(w) FILTER (sand IS NOT NULL), 4) AS clay FROM x GROUP BY 1")
def d24(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("site"), F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("sand"), F.when(F.col("l_linenumber") != 2, F.col("l_discount")).alias("clay"), (F.col("l_linenumber") * 10.0).alias("w"))
    return rounded(stats.weighted_profile(x, ["site"], "w", "sand", ["sand", "clay"]))


@query("d30_mismatch_census", f"WITH {OBS}, a AS (SELECT sensor, hr, avg(value) AS a, avg(k) AS b FROM obs GROUP BY 1, 2) SELECT sensor % 10 AS site, hr // 24 % 3 AS third, count(*) AS n, CAST(count(*) FILTER (a < 20 AND b > 60) AS BIGINT) AS low_high, CAST(count(*) FILTER (a > 60 AND b < 20) AS BIGINT) AS high_low FROM a GROUP BY 1, 2")
def d30(spark, d):
    a = obs(spark, d).groupBy("sensor", "hr").agg(F.avg("value").alias("a"), F.avg("k").alias("b"))
    return clean.pass_counts(a.withColumn("site", F.col("sensor") % 10).withColumn("third", F.expr("hr div 24 % 3")), {"low_high": (F.col("a") < 20) & (F.col("b") > 60), "high_low": (F.col("a") > 60) & (F.col("b") < 20)}, ["site", "third"])


@query("d31_linear_correction", f"WITH {SCORED}, c AS (SELECT regr_slope(y, yhat) AS s, regr_intercept(y, yhat) AS i FROM scored) SELECT id, round(yhat * s + i, 4) AS corrected FROM scored CROSS JOIN c")
def d31(spark, d):
    s = scored(spark, d)
    c = s.agg(F.regr_slope("y", "yhat").alias("s"), F.regr_intercept("y", "yhat").alias("i"))
    return rounded(s.crossJoin(F.broadcast(c)).select("id", (F.col("yhat") * F.col("s") + F.col("i")).alias("corrected")))


@query("d90_season_retention", f"WITH {DAILY}, m AS (SELECT site, q, avg(q) OVER (PARTITION BY site ORDER BY day ROWS BETWEEN 7 PRECEDING AND 6 FOLLOWING) AS m FROM daily), x AS (SELECT *, quantile_cont(m, 0.05) OVER w AS a, quantile_cont(m, 0.5) OVER w AS b, quantile_cont(m, 0.95) OVER w AS c FROM m WINDOW w AS (PARTITION BY site)) SELECT site, count(*) AS rows_before, CAST(count(*) FILTER ((c - a) / b < 0.3 OR m > 0.2 * c) AS BIGINT) AS rows_after FROM x GROUP BY 1")
def d90(spark, d):
    return windows.active_season(daily(spark, d), ["site"], "day", "q").groupBy("site").agg(F.count("*").alias("rows_before"), F.count_if("season").alias("rows_after"))


@query("d92_series_summary", f"WITH {HOURLY} SELECT sensor, min(hr) AS first_hr, max(hr) AS last_hr, round(100.0 * count(*) FILTER (value IS NULL) / count(*), 4) AS missing_pct FROM hourly GROUP BY 1")
def d92(spark, d):
    return rounded(hourly(spark, d).groupBy("sensor").agg(F.min("hr").alias("first_hr"), F.max("hr").alias("last_hr"), (100 * F.count_if(F.col("value").isNull()) / F.count("*")).alias("missing_pct")))


@query("d50_seasonal_drivers", f"WITH {OBS}, a AS (SELECT sensor * 37 % 138 - 60 < 0 AS south, hr // 24 % 365 AS doy, kind, avg(k - 50) AS m FROM obs GROUP BY 1, 2, 3) SELECT south, doy, kind, round(greatest(m, 0), 4) AS positive, round(least(m, 0), 4) AS negative FROM a")
def d50(spark, d):
    a = obs(spark, d).groupBy((F.col("sensor") * 37 % 138 - 60 < 0).alias("south"), F.expr("hr div 24 % 365").alias("doy"), "kind").agg(F.avg(F.col("k") - 50).alias("m"))
    return rounded(a.select("south", "doy", "kind", F.greatest("m", F.lit(0.0)).alias("positive"), F.least("m", F.lit(0.0)).alias("negative")))


@query("d60_interannual_correlation", f"WITH {DAILY}, y AS (SELECT site, day // 365 AS yr, avg(q) AS a, avg(price) AS b FROM daily GROUP BY 1, 2) SELECT site, round(corr(a, b), 4) AS r FROM y GROUP BY 1 HAVING count(*) >= 3")
def d60(spark, d):
    y = daily(spark, d).groupBy("site", F.expr("day div 365").alias("yr")).agg(F.avg("q").alias("a"), F.avg("price").alias("b"))
    return rounded(y.groupBy("site").agg(F.corr("a", "b").alias("r"), F.count("*").alias("n")).where("n >= 3").drop("n"))


@query("d64_unique_signal", f"WITH {GRID}, s AS (SELECT product, day, avg(v) AS v FROM grid GROUP BY 1, 2), p AS (SELECT a.product, b.product AS other, corr(a.v, b.v) AS r FROM s a JOIN s b USING (day) WHERE a.product <> b.product GROUP BY 1, 2) SELECT product, round(avg(r) FILTER (other = 'view') - avg(r) FILTER (other <> 'view'), 4) AS score FROM p WHERE product <> 'view' GROUP BY 1")
def d64(spark, d):
    s = grid(spark, d).groupBy("product", "day").agg(F.avg("v").alias("v"))  # one row a product and day
    b = s.select(F.col("product").alias("other"), "day", F.col("v").alias("w"))
    p = s.join(b, "day").where("product <> other").groupBy("product", "other").agg(F.corr("v", "w").alias("r"))
    return rounded(p.where("product <> 'view'").groupBy("product").agg((F.avg(F.when(F.col("other") == "view", F.col("r"))) - F.avg(F.when(F.col("other") != "view", F.col("r")))).alias("score")))


@query("d73_majority_resample", f"WITH {GRID}, c AS (SELECT floor(lat / 10) AS r, floor(lon / 10) AS c, product, count(*) AS n FROM grid GROUP BY 1, 2, 3) SELECT r AS row, c AS col, arg_min(product, struct_pack(a := -n, b := product)) AS mode FROM c GROUP BY 1, 2")
def d73(spark, d):
    k = grid(spark, d).withColumn("row", F.floor(F.col("lat") / 10).cast("double")).withColumn("col", F.floor(F.col("lon") / 10).cast("double"))
    return stats.mode(k, ["row", "col"], "product").select("row", "col", "mode")


@query("d73_majority_by_area", f"""WITH {GRID}, cells AS (SELECT lat, lon, min(product) AS code FROM grid GROUP BY 1, 2), j AS (SELECT code, lat, lon, unnest(generate_series(CAST(floor((lat + 60.3) / 2.5) AS BIGINT), CAST(floor((lat + 61.3) / 2.5) AS BIGINT))) AS row FROM cells),
 k AS (SELECT *, unnest(generate_series(CAST(floor((lon + 180.4) / 2.5) AS BIGINT), CAST(floor((lon + 181.4) / 2.5) AS BIGINT))) AS col FROM j),
 a AS (SELECT row, col, code, sum((least(lat + 1, -60.3 + (row + 1) * 2.5) - greatest(lat, -60.3 + row * 2.5)) * (least(lon + 1, -180.4 + (col + 1) * 2.5) - greatest(lon, -180.4 + col * 2.5))) AS a FROM k GROUP BY 1, 2, 3)
 SELECT row, col, code, round(a / sum(a) OVER (PARTITION BY row, col), 4) AS share FROM a QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY round(a, 9) DESC, code) = 1""")
def d73_area(spark, d):
    c = grid(spark, d).groupBy("lat", "lon").agg(F.min("product").alias("code")).select((F.col("lat") + 60).cast("int").alias("r"), (F.col("lon") + 180).cast("int").alias("c"), "code")
    return rounded(polygons.majority_by_area(c, "code", "r", "c", (-180.0, -60.0, 1.0), (-180.4, -60.3, 2.5)))


# ---- census of gaps

_GAPS = f"{_ISL}, gaps AS (SELECT sensor, min(hr) AS gap_start, count(*) AS size FROM isl WHERE value IS NULL GROUP BY sensor, g)"
_BIN = "CASE WHEN size <= 1 THEN '1h' WHEN size <= 6 THEN '2-6h' WHEN size <= 24 THEN '7-24h' WHEN size <= 168 THEN '1-7d' ELSE '>7d' END"


@query("d84_gap_census", f"WITH {_GAPS}, c AS (SELECT sensor, round(100.0 * count(value) / count(*), 4) AS completeness FROM hourly GROUP BY 1), n AS (SELECT sensor, count(*) AS n_gaps, CAST(sum(size) AS BIGINT) AS missing FROM gaps GROUP BY 1) SELECT sensor, completeness, coalesce(n_gaps, 0) AS n_gaps, coalesce(missing, 0) AS missing FROM c LEFT JOIN n USING (sensor)")
def d84(spark, d):
    h = hourly(spark, d)
    gaps = windows.gaps(h, ["sensor"], "hr", "value").groupBy("sensor").agg(F.count("*").alias("n_gaps"), F.sum("size").alias("missing"))
    c = rounded(h.groupBy("sensor").agg((100 * F.count("value") / F.count("*")).alias("completeness")))
    return c.join(gaps, "sensor", "left").fillna(0, ["n_gaps", "missing"])


@query("d85_gap_bins", f"WITH {_GAPS} SELECT {_BIN} AS bin, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS share FROM gaps GROUP BY 1")
def d85(spark, d):
    b = windows.gaps(hourly(spark, d), ["sensor"], "hr", "value").groupBy(F.expr(_BIN).alias("bin")).agg(F.count("*").alias("n"))
    total = b.agg(F.sum("n").alias("_t"))
    return rounded(b.crossJoin(F.broadcast(total)).select("bin", "n", (100 * F.col("n") / F.col("_t")).alias("share")))


@query("d86_missing_by_week", f"WITH {HOURLY}, t AS (SELECT sensor FROM hourly GROUP BY 1 ORDER BY count(*) FILTER (value IS NULL) DESC, sensor LIMIT 20) SELECT sensor, hr // 168 AS week, round(least(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END), 1), 4) AS missing FROM hourly WHERE sensor IN (SELECT sensor FROM t) GROUP BY 1, 2")
def d86(spark, d):
    h = hourly(spark, d)
    top = h.groupBy("sensor").agg(F.count_if(F.col("value").isNull()).alias("m")).orderBy(F.desc("m"), "sensor").limit(20)
    return rounded(h.join(F.broadcast(top), "sensor", "left_semi").groupBy("sensor", F.expr("hr div 168").alias("week")).agg(F.least(F.avg(F.col("value").isNull().cast("double")), F.lit(1.0)).alias("missing")))


@query("d87_relative_gaps", f"WITH {DAILY}, x AS (SELECT site, day, day - lag(day) OVER (PARTITION BY site ORDER BY day) AS s FROM daily) SELECT site, day, s // min(s) OVER (PARTITION BY site) AS gap FROM x")
def d87(spark, d):
    x = daily(spark, d).select("site", "day", (F.col("day") - F.lag("day").over(Window.partitionBy("site").orderBy("day"))).alias("s"))
    return x.select("site", "day", F.floor(F.col("s") / F.min("s").over(Window.partitionBy("site"))).alias("gap"))


@query("d88_site_selection", f"WITH {HOURLY}, c AS (SELECT sensor, 100.0 * count(value) / count(*) AS pct FROM hourly GROUP BY 1), t AS (SELECT max(th) AS th FROM (SELECT th FROM (SELECT unnest([20, 15, 10, 5, 0]) AS th) JOIN c ON pct >= th GROUP BY th HAVING count(*) >= 15)) SELECT sensor, round(pct, 4) AS pct FROM c, t WHERE pct >= coalesce(th, 0)")
def d88(spark, d):
    c = hourly(spark, d).groupBy("sensor").agg((100 * F.count("value") / F.count("*")).alias("pct"))
    counts = c.agg(*(F.count_if(F.col("pct") >= t).alias(f"t{t}") for t in (20, 15, 10, 5)))
    pick = F.coalesce(*(F.when(F.col(f"t{t}") >= 15, t) for t in (20, 15, 10, 5)), F.lit(0))
    return rounded(c.crossJoin(F.broadcast(counts.select(pick.alias("th")))).where("pct >= th").select("sensor", "pct"))


# ---- fill back-test


_SPANS = f"""{DAILY}, seg AS (SELECT site, q, row_number() OVER (PARTITION BY site ORDER BY day) - 1 AS i FROM daily), len AS (SELECT site, count(*) AS n FROM seg GROUP BY 1), sized AS (SELECT * FROM len, (VALUES (2), (6), (24)) AS v(size) WHERE n >= 3 * size),
 slots AS (SELECT site, size, unnest(generate_series(0, (n - 2 * size) // (3 * size))) AS slot FROM sized), drawn AS (SELECT *, md5(site || '|' || size || '|' || slot) AS h FROM slots), ranked AS (SELECT *, row_number() OVER (PARTITION BY site, size ORDER BY h, slot) AS rep FROM drawn),
 spans AS (SELECT site, size, rep, slot * 3 * size + CAST('0x' || substr(h, 1, 8) AS BIGINT) % size AS start FROM ranked WHERE rep <= 2)"""
_COPIES = f"{_SPANS}, copies AS (SELECT site || '-' || size || '-' || rep AS sensor, size, i AS hr, q AS truth, i >= start AND i < start + size AS hidden, CASE WHEN i < start OR i >= start + size THEN q END AS value FROM seg JOIN spans USING (site))"
_SCORES = "count(*) AS n_points, round(CASE WHEN sum(truth * truth) - sum(truth) * sum(truth) / count(*) > 1e-12 THEN 1 - sum((truth - filled) ** 2) / (sum(truth * truth) - sum(truth) * sum(truth) / count(*)) END, 4) AS r2, round(sqrt(avg((truth - filled) ** 2)), 4) AS rmse, round(avg(abs(truth - filled)), 4) AS mae"
_ROLLED = "SELECT sensor, hr, coalesce(value, CASE WHEN count(value) OVER w >= 1 THEN avg(value) OVER w END) AS m FROM copies WINDOW w AS (PARTITION BY sensor ORDER BY hr ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"
_HIDDEN = " UNION ALL ".join(
    f"SELECT '{name}' AS method, size, truth, filled FROM copies JOIN (WITH {_then_tail(source)} SELECT sensor, hr, {pick} AS filled FROM pv) USING (sensor, hr) WHERE hidden AND filled IS NOT NULL"
    for name, source, pick in (("linear", "SELECT sensor, hr, value AS m FROM copies", _LINE), ("nearest", "SELECT sensor, hr, value AS m FROM copies", "CASE WHEN p IS NOT NULL AND x IS NOT NULL THEN CASE WHEN i - pi <= ni - i THEN p ELSE x END END"), ("rolling", _ROLLED, _LINE)))


def _segments(spark, d):
    return backtest.truth_segments(daily(spark, d), ["site"], "day", "q")


@query("f13_hidden_spans", f"WITH {_SPANS} SELECT * FROM spans")
def f13_spans(spark, d):
    lengths = _segments(spark, d).groupBy("site").agg(F.count("*").alias("n"))
    return backtest.hidden_spans(lengths, ["site"], "n", [2, 6, 24], 2)


@query("f13_masked_back_test", f"WITH {_COPIES}, every AS ({_HIDDEN}) SELECT method, size, {_SCORES} FROM every GROUP BY 1, 2")
def f13(spark, d):
    methods = {"linear": fill.linear, "nearest": fill.nearest, "rolling": lambda *a: fill.rolling_mean(*a, daily=True)}
    return rounded(backtest.run(_segments(spark, d).drop("day"), ["site"], "i", "q", [2, 6, 24], 2, methods))


@query("f8_model_fill")
def f8(spark, d):
    when = F.date_from_unix_date(F.col("day").cast("int"))
    return rounded(fill.by_own_model(_rows_with_spans(spark, d), ["site"], "i", "v", F.lit(0), F.dayofyear(when), F.month(when)).select("site", "i", "filled"))


# ---- sorts, sets


@query("g2_best_sites", f"WITH {DAILY}, m AS (SELECT site, round(avg(q), 6) AS m FROM daily GROUP BY 1) SELECT site, m FROM m ORDER BY m DESC, site LIMIT 10")
def g2(spark, d):
    return rounded(daily(spark, d).groupBy("site").agg(F.avg("q").alias("m")), 6).orderBy(F.desc("m"), "site").limit(10)


@query("g3_top_methods", f"WITH {SCORED}, m AS (SELECT size, method, round(avg(abs(y - yhat)), 6) AS mae FROM scored GROUP BY 1, 2) SELECT size, method, mae FROM (SELECT *, row_number() OVER (PARTITION BY size ORDER BY mae, method) AS r FROM m) WHERE r <= 2")
def g3(spark, d):
    m = rounded(scored(spark, d).groupBy("size", "method").agg(F.avg(F.abs(F.col("y") - F.col("yhat"))).alias("mae")), 6)
    return skill.rank_methods(m.withColumn("s", -F.col("mae")), ["size"], "method", "s", 2).select("size", "method", "mae")


@query("g5_first_in_bin", f"WITH {OBS} SELECT sensor, hr // 24 AS day, arg_min(value, event_id) FILTER (value IS NOT NULL) AS first FROM obs GROUP BY 1, 2")
def g5(spark, d):
    return obs(spark, d).groupBy("sensor", F.expr("hr div 24").alias("day")).agg(F.min_by("value", F.when(F.col("value").isNotNull(), F.col("event_id"))).alias("first"))


@query("s1_union_differing", "SELECT c_custkey AS id, c_acctbal AS balance, NULL AS size FROM customer UNION ALL SELECT p_partkey, NULL, p_size FROM part")
def s1(spark, d):
    c, p = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance")), table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"))
    return c.unionByName(p, allowMissingColumns=True)


@query("s2_distinct_rows", "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem")
def s2(spark, d):
    return table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus").distinct()


@query("s3_index_intersection", f"WITH {OBS} SELECT sensor, hr FROM obs WHERE kind = 'view' INTERSECT SELECT sensor, hr FROM obs WHERE kind = 'click'")
def s3(spark, d):
    o = obs(spark, d)
    return o.where("kind = 'view'").select("sensor", "hr").intersect(o.where("kind = 'click'").select("sensor", "hr"))


@query("s4_consensus_features", f"WITH {OBS} SELECT hr FROM obs GROUP BY 1 HAVING count(DISTINCT kind) = 5")
def s4(spark, d):
    return obs(spark, d).groupBy("hr").agg(F.count_distinct("kind").alias("n")).where("n = 5").select("hr")


@query("s5_set_difference", f"WITH {OBS} SELECT DISTINCT sensor FROM obs EXCEPT SELECT sensor FROM obs WHERE kind = 'purchase'")
def s5(spark, d):
    o = obs(spark, d)
    return o.select("sensor").subtract(o.where("kind = 'purchase'").select("sensor"))


# ---- scalars, continued


@query("h1_units", "SELECT l_orderkey, l_linenumber, round(l_quantity + 250 - 273.15, 4) AS c, round(l_extendedprice / 3600, 4) AS wm2 FROM lineitem")
def h1(spark, d):
    return rounded(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scalars.celsius(F.col("l_quantity") + 250).alias("c"), scalars.flux(F.col("l_extendedprice"), 3600).alias("wm2")))


@query("h8_solar_time", f"WITH {OBS} SELECT event_id, sec + CAST(240 * (sensor * 53 % 360 - 180) AS BIGINT) AS solar FROM obs")
def h8(spark, d):
    return obs(spark, d).select("event_id", (F.col("sec") + 240 * (F.col("sensor") * 53 % 360 - 180)).alias("solar"))


@query("h14_water_potential", "WITH a AS (SELECT l_orderkey, l_linenumber, greatest(l_quantity / 100, 1e-3) AS th, l_tax * 1000 AS s, l_discount * 400 AS c FROM lineitem) SELECT l_orderkey, l_linenumber, round(least(greatest(-10 * pow(10, 1.88 - 0.0131 * s) / 1000 * 9.81 * pow(th / (0.489 - 0.00126 * s), -(2.91 + 0.159 * c)) / 10, -5000), 0), 4) AS psi FROM a")
def h14(spark, d):
    psi = scalars.water_potential(F.col("l_quantity") / 100, F.col("l_tax") * 1000, F.col("l_discount") * 400)
    return rounded(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", psi.alias("psi")))


@query("h16_one_hot", "SELECT p_partkey, CAST(p_type = 'ECONOMY' AS INT) AS economy, CAST(p_type = 'STANDARD' AS INT) AS standard, CAST(p_type NOT IN ('ECONOMY', 'STANDARD') AS INT) AS other FROM part")
def h16(spark, d):
    t = F.col("p_type")
    return table(spark, d, "part").select("p_partkey", (t == "ECONOMY").cast("int").alias("economy"), (t == "STANDARD").cast("int").alias("standard"), (~t.isin("ECONOMY", "STANDARD")).cast("int").alias("other"))


@query("h21_haversine", "SELECT s_suppkey, round(2 * 6371.0 * asin(sqrt(least(pow(sin(radians(10.0 - s_suppkey % 80) / 2), 2) + cos(radians(s_suppkey % 80)) * cos(radians(10.0)) * pow(sin(radians(20.0 - s_suppkey % 170) / 2), 2), 1.0))), 3) AS km FROM supplier")
def h21(spark, d):
    lat, lon = (F.col("s_suppkey") % 80).cast("double"), (F.col("s_suppkey") % 170).cast("double")
    return rounded(table(spark, d, "supplier").select("s_suppkey", joins.haversine(lat, lon, F.lit(10.0), F.lit(20.0)).alias("km")), 3)


@query("h23_date_from_name", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def h23(spark, d):
    name = F.concat(F.lit("X.A"), F.date_format("o_orderdate", "yyyyDDD"), F.lit(".hdf"))
    return table(spark, d, "orders").select("o_orderkey", name.alias("n")).select("o_orderkey", F.to_date(F.regexp_extract("n", r"A(\d{7})", 1), "yyyyDDD").alias("day"))


@query("h24_id_parts", "SELECT c_custkey, CAST(split_part(c_name, '#', 2) AS BIGINT) AS number, lower(split_part(c_name, '#', 1)) AS kind FROM customer")
def h24(spark, d):
    p = F.split("c_name", "#")
    return table(spark, d, "customer").select("c_custkey", F.element_at(p, -1).cast("long").alias("number"), F.lower(F.trim(p[0])).alias("kind"))


@query("h26_composition", "SELECT p_partkey, p_size AS sand, p_size % 7 AS clay FROM part")
def h26(spark, d):
    text = F.concat(F.col("p_size").cast("string"), F.lit("% sand; clay "), (F.col("p_size") % 7).cast("string"), F.lit(" %"))
    t = table(spark, d, "part").select("p_partkey", text.alias("t"))
    return t.select("p_partkey", F.regexp_extract("t", r"(\d+)\s*% sand", 1).cast("int").alias("sand"), F.regexp_extract("t", r"clay (\d+)\s*%", 1).cast("int").alias("clay"))


@query("h27_json_config", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def h27(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


# ---- splits and models

_SITES = "sites AS (SELECT s_suppkey AS id, CAST(s_suppkey * 29 % 130 - 55 AS DOUBLE) AS lat, CAST(s_suppkey * 41 % 350 - 175 AS DOUBLE) AS lon, s_nationkey % 4 AS cls FROM supplier)"


def _sites(spark, d):
    return table(spark, d, "supplier").selectExpr("s_suppkey as id", "cast(s_suppkey * 29 % 130 - 55 as double) as lat", "cast(s_suppkey * 41 % 350 - 175 as double) as lon", "s_nationkey % 4 as cls")


@query("k1_grid_groups", f"WITH {_SITES} SELECT id, CAST(dense_rank() OVER (ORDER BY floor((lat - (SELECT min(lat) FROM sites)) / 20), floor((lon - (SELECT min(lon) FROM sites)) / 20)) AS INT) AS grp FROM sites")
def k1(spark, d):
    return split.grid_groups(_sites(spark, d), 20.0).select("id", "grp")


@query("k2_balanced_folds")
def k2(spark, d):
    gr = split.grid_groups(_sites(spark, d), 20.0).withColumn("w", F.lit(1))
    return split.balanced_folds(gr, "grp", "w", 5)


@query("k3_group_statistics", f"WITH {_SITES} SELECT cls, count(*) AS n, round(avg(lat), 4) AS lat, round(avg(lon), 4) AS lon FROM sites GROUP BY 1")
def k3(spark, d):
    return rounded(_sites(spark, d).groupBy("cls").agg(F.count("*").alias("n"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon")))


@query("k4_kmeans_groups")
def k4(spark, d):
    return ml.kmeans_groups(_sites(spark, d), 4).select("id", "grp")


@query("k5_stratified_group_folds")
def k5(spark, d):
    gr = split.grid_groups(_sites(spark, d), 20.0)
    return split.stratified_folds(gr, "grp", "cls", 5)


@query("k6_expanding_folds", f"WITH {DAILY} SELECT site, day, CAST(ntile(6) OVER (PARTITION BY site ORDER BY day) - 1 AS INT) AS slice FROM daily")
def k6(spark, d):
    return split.expanding_folds(daily(spark, d), ["site"], ["day"], 5).select("site", "day", "slice")


@query("k7_gauged_split", f"WITH {_SITES}, p AS (SELECT id, cls, percent_rank() OVER (PARTITION BY cls ORDER BY id * 7919 % 1009, id) AS p FROM sites) SELECT id, CASE WHEN p < 0.5 THEN 'train' WHEN p < 0.6 THEN 'valid' ELSE 'test' END AS part FROM p")
def k7(spark, d):
    return split.class_split(_sites(spark, d), "id", "cls", {"train": 0.5, "valid": 0.1, "test": 0.4}, F.col("id") * 7919 % 1009).select("id", "part")


@query("k8_block_folds", f"WITH {_SITES} SELECT id, CAST((floor((lat + 90) / 15) + 2 * floor((lon + 180) / 15)) % 5 AS INT) AS fold FROM sites")
def k8(spark, d):
    return split.block_folds(_sites(spark, d), 15.0, 5).select("id", "fold")


@query("k8_buffered_training", f"WITH {_SITES}, f AS (SELECT id, floor((lat + 90) / 15) AS r, floor((lon + 180) / 15) AS c, CAST((floor((lat + 90) / 15) + 2 * floor((lon + 180) / 15)) % 5 AS INT) AS fold FROM sites) SELECT id, fold FROM f a WHERE fold <> 0 AND NOT EXISTS (SELECT 1 FROM f b WHERE b.fold = 0 AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1)")
def k8b(spark, d):
    return split.buffered_training(split.block_folds(_sites(spark, d), 15.0, 5), 0, 15.0).select("id", "fold")


@query("k9_standardise_by_fold", f"WITH {SCORED}, s AS (SELECT avg(y) AS m, stddev_pop(y) AS s FROM scored WHERE fold <> 0) SELECT id, round((y - m) / s, 4) AS y FROM scored CROSS JOIN s")
def k9(spark, d):
    return rounded(split.standardise_by_fold(scored(spark, d), "fold", 0, ["y"]).select("id", "y"))


@query("k15_temporal_split", f"WITH {DAILY}, p AS (SELECT site, day, percent_rank() OVER (PARTITION BY site ORDER BY day) AS p FROM daily) SELECT site, day, CASE WHEN p < 0.7 THEN 'train' WHEN p < 0.7 + 0.15 THEN 'valid' ELSE 'test' END AS part FROM p")
def k15(spark, d):
    return split.temporal_split(daily(spark, d), ["site"], ["day"], 0.7, 0.15).select("site", "day", "part")


_F = ["l_quantity", "l_discount", "l_tax"]


def _train(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), *_F, F.round(F.col("l_extendedprice") / 1000, 3).alias("y"), (F.col("l_suppkey") % 3).alias("fold"))


@query("k10_tree_search")
def k10(spark, d):
    model, params, error = ml.grid_search(_train(spark, d), _F, "y", "fold", 3, [{"numTrees": 5, "maxDepth": 3}, {"numTrees": 5, "maxDepth": 5}])
    return rounded(model.transform(_train(spark, d)).select("id", "prediction"))


@query("k10_search_table")
def k10_table(spark, d):
    forest = ml.search(_train(spark, d), _F, "y", "fold", 3, {"numTrees": [3, 6], "maxDepth": [3, 5]})
    boosted = ml.search(_train(spark, d), _F, "y", "fold", 3, {"maxIter": [2, 4], "maxDepth": [2, 3], "stepSize": [0.1, 0.3]}, "boosted", draws=3)
    return rounded(ml.search_table(spark, forest + boosted))


@query("k11_out_of_fold")
def k11(spark, d):
    return rounded(ml.out_of_fold(_train(spark, d), _F, "y", "fold", 3, numTrees=5, maxDepth=4).select("id", "fold", "y", "prediction"))


@query("k12_forward_selection")
def k12(spark, d):
    steps = ml.forward_selection(_train(spark, d), {"quantity": ["l_quantity"], "rates": ["l_discount", "l_tax"]}, [], "y", "fold", 3, numTrees=3, maxDepth=3)
    return spark.createDataFrame([(i, n, float(s)) for i, (n, s) in enumerate(steps)], "step int, feature_group string, rmse double")


@query("k14_batch_scoring")
def k14(spark, d):
    t = _train(spark, d)
    models = {"forest": ml.fit(t, _F, "y", numTrees=5, maxDepth=4), "boosted": ml.fit(t, _F, "y", "boosted", maxIter=3, maxDepth=3)}
    return rounded(ml.score(t, models, ["id"]))


@query("d72_incremental_composites", f"WITH {GRID} SELECT lat, lon, round(avg(v), 4) AS mean, round(stddev_samp(v), 3) AS std, round(min(v), 4) AS min, round(max(v), 4) AS max, count(v) AS n FROM grid GROUP BY 1, 2")
def d72i(spark, d):
    k = grid(spark, d)
    parts = incremental.partial_composites(k.where("day % 2 = 0"), ["lat", "lon"], "v").unionByName(incremental.partial_composites(k.where("day % 2 <> 0"), ["lat", "lon"], "v"))
    m = incremental.merge_composites(parts, ["lat", "lon"])
    return rounded(m.withColumn("std", near("std", 3)))


@query("e29_combined_season", f"WITH {DAILY}, x AS (SELECT site, day, q, avg(least(greatest((q - 10) / 30, 0), 1)) OVER (PARTITION BY site ORDER BY day ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS g, avg(q) OVER (PARTITION BY site ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS w, sum(disc) OVER (PARTITION BY site ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) / sum(n) OVER (PARTITION BY site ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS r FROM daily) SELECT site, day FROM x WHERE g > 0.500001 AND w > 25.0001 AND r > 0.0450001")
def e29(spark, d):
    k = windows.season_index(daily(spark, d), ["site"], "day", windows.ramp(F.col("q"), 10, 40))
    k = windows.moisture_season(k, ["site"], "day", "q", "disc", "n", 25.0001, 0.0450001)
    return k.where("gsi > 0.500001 and moist").select("site", "day")
