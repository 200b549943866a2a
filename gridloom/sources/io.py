"""Sources and sinks: CSV and Parquet scans, vendor vocabularies, timestamps from parts, partitioned output."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.clean import number


def sensor_csv(spark: SparkSession, path: str, time: str, sensors: list[str], pattern: str = r"([^/]+?)(?:_sapf)?\.csv$") -> DataFrame:
    """Wide sensor files as long rows: site (from the file name), sensor, time text, value; ``NA`` and unnamed index columns are dropped."""
    raw = spark.read.option("header", True).option("nullValue", "NA").csv(path)
    df = raw.withColumn("site", F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)).select("site", time, *(number(c).alias(c) for c in sensors))
    return df.unpivot(["site", time], sensors, "sensor", "value").where("value is not null")


def site_csv(spark: SparkSession, path: str, schema: str, pattern: str = r"([^/]+?)(?:_env)?\.csv$") -> DataFrame:
    """Environment files with fixed columns, the site from the file name."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "NA").csv(path).withColumn("site", F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def read_any(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """CSV or Parquet by extension; only ``columns`` if named, which the scan prunes."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(path) if path.rstrip("/").endswith(".csv") else spark.read.parquet(path)
    return df.select(*columns) if columns else df


def unique_columns(df: DataFrame) -> DataFrame:
    """The first of each column name (names compared without case)."""
    seen: set[str] = set()
    names = []
    for i, c in enumerate(df.columns):
        names.append(c if c.lower() not in seen else f"_again_{i}")
        seen.add(c.lower())
    return df.toDF(*names).select(*(n for n in names if not n.startswith("_again_")))


def write(df: DataFrame, path: str, kind: str = "parquet", compression: str = "gzip", by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Compressed output, partitioned by columns if named."""
    w = df.write.mode(mode).option("compression", compression)
    w = w.partitionBy(*by) if by else w
    w.option("header", True).format(kind).save(path)


def overwrite_month(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace just the partitions that ``df`` has: running a month again gives the same files."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def merge(parts: list[DataFrame], order: list[str]) -> DataFrame:
    """Union by name, missing columns null, sorted."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).orderBy(*order)


def to_standard(df: DataFrame, mapping: dict[str, list[str]]) -> DataFrame:
    """Standard columns, each the first vendor column that has a value; names that no vendor column has become null."""
    have = set(df.columns)
    return df.select(*(F.coalesce(*[F.col(v) for v in vs if v in have] or [F.lit(None)]).alias(n) for n, vs in mapping.items()))


def parse_times(df: DataFrame, keys: list[str], text: str, formats: list[str], least: float = 0.5, out: str = "ts") -> DataFrame:
    """Timestamps by the first format that parses more than ``least`` of a key's rows; null where none does."""
    tries = [F.expr(f"try_to_timestamp(`{text}`, '{f}')") for f in formats]
    shares = df.groupBy(*keys).agg(*(F.avg(t.isNotNull().cast("double")).alias(f"_s{i}") for i, t in enumerate(tries)))
    pick = None
    for i, t in enumerate(tries):
        pick = F.when(F.col(f"_s{i}") > least, t) if pick is None else pick.when(F.col(f"_s{i}") > least, t)
    return df.join(shares, keys).withColumn(out, pick).drop(*(f"_s{i}" for i in range(len(formats))))


def synthesise_times(meta: DataFrame, start: str, stop: str, step: str, out: str = "t") -> DataFrame:
    """One row a step from start to stop (whole numbers)."""
    return meta.withColumn(out, F.explode(F.sequence(start, stop, step)))


def time_of_year(year: Column, day: Column, hour: Column) -> Column:
    """Timestamp of a year, day of the year and hour."""
    return F.timestamp_seconds(F.unix_date(F.make_date(year.cast("int"), F.lit(1), F.lit(1))).cast("long") * 86400 + (day - 1).cast("long") * 86400 + hour.cast("long") * 3600)


def manifest(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and a checksum of each part of an output."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum(F.crc32(F.concat_ws("|", *(F.col(c).cast("string") for c in df.columns)).cast("binary"))).alias("checksum"))
