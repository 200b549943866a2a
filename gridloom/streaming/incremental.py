"""Incremental jobs: new files of a folder processed once each, mergeable partial composites, late data under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def process_new(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, transform) -> None:
    """Run ``transform`` over the files of ``source`` that earlier runs have not seen and append the result; the checkpoint is the done-marker."""
    stream = spark.readStream.schema(schema).parquet(source)
    query = transform(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def partial_composites(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean, sum of squared deviations from it, min and max of a part; parts merge by ``merge_composites``."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("m2"), F.min(value).alias("min"), F.max(value).alias("max"))


def merge_composites(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, sample deviation (null for one value), min, max and count of merged parts.

    Deviations are merged from those inside the parts and those of the parts' means from one of them, so that nothing cancels for means that
    are large against the deviation.
    """
    a = F.col("mean") - F.col("_base")
    based = parts.join(parts.groupBy(*keys).agg(F.min("mean").alias("_base")), keys)
    m = based.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("m2").alias("m2"), F.first("_base").alias("_base"), F.sum(F.col("n") * a).alias("_s"), F.sum(F.col("n") * a * a).alias("_q"), F.min("min").alias("min"), F.max("max").alias("max"))
    m2 = F.col("m2") + F.greatest(F.col("_q") - F.col("_s") * F.col("_s") / F.col("n"), F.lit(0.0))
    return m.select(*keys, (F.col("_base") + F.col("_s") / F.col("n")).alias("mean"), F.when(F.col("n") > 1, F.sqrt(m2 / (F.col("n") - 1))).alias("std"), "min", "max", "n")


def windowed_means(stream: DataFrame, keys: list[str], time: str, value: str, width: str, late: str) -> DataFrame:
    """Means by time window, rows up to ``late`` behind counted."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
