"""Bindings of the library's notions (sensor series, grids, predictions) to the tables at hand, in Spark and in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import resample

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
SQL: dict[str, str] = {}


#: Added before rounding on both sides, so that means that end in a 5 round alike whatever the order of additions was.
NUDGE = 1e-9


def _nudged(sql: str) -> str:
    """``round(x, n)`` as ``round((x) + NUDGE, n)`` throughout."""
    out, at = [], 0
    while (i := sql.find("round(", at)) >= 0:
        depth, comma, j = 1, -1, i + 6
        while depth:
            c = sql[j]
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 1:
                comma = j
            j += 1
        out.append(f"{sql[at:i]}round(({_nudged(sql[i + 6 : comma])}) + {NUDGE}{sql[comma:j]}")
        at = j
    return "".join(out) + sql[at:]


def near(c: Column | str, digits: int) -> Column:
    """Rounded after the nudge."""
    return F.round((F.col(c) if isinstance(c, str) else c) + NUDGE, digits)


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    """Register a query under ``name`` with the DuckDB SQL of the same result."""

    def register(fn: Builder) -> Builder:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = _nudged(sql)
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, the session's zone set to UTC: all clock times are UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor readings: event_id, sensor, kind, sec, hr, value (one in eleven missing), k (a flag level)."""
    sec = F.unix_seconds(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("sensor"), F.col("event_type").alias("kind"), sec.alias("sec"), F.expr("unix_seconds(cast(ts as timestamp)) div 3600").alias("hr"),
        F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("value"), F.get_json_object("props", "$.k").cast("double").alias("k"),
    )


OBS = """obs AS (SELECT event_id, user_id AS sensor, event_type AS kind, CAST(floor(epoch(ts)) AS BIGINT) AS sec, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hr,
 CASE WHEN event_id % 11 <> 0 THEN value END AS value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)"""


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sensor, hr, value: hourly means with every hour between a sensor's first and last, missing ones null."""
    return resample.calendar(obs(spark, sf_dir), ["sensor"], "hr", 1, {"value": ("mean", "value")}).withColumn("value", near("value", 6))


HOURLY = f"""{OBS}, hourly AS (SELECT sensor, hr, round(v, 6) AS value FROM (SELECT sensor, unnest(generate_series(min(hr), max(hr))) AS hr FROM obs GROUP BY sensor)
 LEFT JOIN (SELECT sensor, hr, avg(value) AS v FROM obs GROUP BY 1, 2) USING (sensor, hr))"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, day, q, price, disc, n: years of daily values by supplier."""
    day = F.expr("unix_seconds(cast(l_shipdate as timestamp)) div 86400")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("site"), day.alias("day")).agg(
        near(F.avg("l_quantity"), 6).alias("q"), near(F.sum("l_extendedprice"), 2).alias("price"), near(F.avg("l_discount"), 6).alias("disc"), F.count("*").alias("n"))


DAILY = """daily AS (SELECT l_suppkey AS site, CAST(floor(epoch(l_shipdate) / 86400) AS BIGINT) AS day, round(avg(l_quantity), 6) AS q, round(sum(l_extendedprice), 2) AS price,
 round(avg(l_discount), 6) AS disc, count(*) AS n FROM lineitem GROUP BY 1, 2)"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product, lat, lon, day, v: daily cell means of five products."""
    return obs(spark, sf_dir).where("value is not null").groupBy(
        F.col("kind").alias("product"), (F.col("sensor") * 37 % 138 - 60).cast("double").alias("lat"), (F.col("sensor") * 53 % 360 - 180).cast("double").alias("lon"),
        F.expr("hr div 24").alias("day")).agg(near(F.avg("value"), 6).alias("v"))


GRID = f"""{OBS}, grid AS (SELECT kind AS product, CAST(sensor * 37 % 138 - 60 AS DOUBLE) AS lat, CAST(sensor * 53 % 360 - 180 AS DOUBLE) AS lon, hr // 24 AS day, round(avg(value), 6) AS v
 FROM obs WHERE value IS NOT NULL GROUP BY 1, 2, 3, 4)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y and yhat with the keys of a benchmark: method, grp, size, rep, fold, site, id."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber as id", "l_returnflag as method", "l_linestatus as grp", "cast(l_quantity as bigint) div 10 as size", "l_orderkey % 5 as rep", "l_partkey % 4 as fold",
        "l_suppkey as site", "round(l_extendedprice / 1000 + 1e-9, 3) as y", "round(l_quantity * 1.5 + l_discount * 40 - l_tax * 20 + 1e-9, 3) as yhat")


SCORED = """scored AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS method, l_linestatus AS grp, CAST(l_quantity AS BIGINT) // 10 AS size, l_orderkey % 5 AS rep, l_partkey % 4 AS fold,
 l_suppkey AS site, round(l_extendedprice / 1000, 3) AS y, round(l_quantity * 1.5 + l_discount * 40 - l_tax * 20, 3) AS yhat FROM lineitem)"""


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Every double column rounded (and -0 made 0), so that the order of additions doesn't show."""
    return df.select(*((near(f.name, digits) + 0.0).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in df.schema.fields))
