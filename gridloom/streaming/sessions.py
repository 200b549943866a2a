"""Runs and gaps of live series: session windows under a watermark, and what lies between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessions(stream: DataFrame, keys: list[str], time: str, gap: str, late: str, value: str | None = None) -> DataFrame:
    """keys, run_start, run_end and n: maximal runs of rows no more than ``gap`` apart, of a stream (append mode: a run comes out once the watermark,
    ``late`` behind the latest row, has passed its end) or a table.

    Rows without a time are not part of a run, nor are rows without a ``value`` if one is named. Of a stream, rows later than the watermark
    are dropped; a row that arrives within it joins two runs if it closes the gap between them.
    """
    rows = stream.where(F.col(time).isNotNull() & (F.col(value).isNotNull() if value else F.lit(True)))
    marked = rows.withWatermark(time, late) if rows.isStreaming else rows
    runs = marked.groupBy(*keys, F.session_window(time, gap).alias("_w")).agg(F.min(time).alias("run_start"), F.max(time).alias("run_end"), F.count("*").alias("n"))
    return runs.select(*keys, "run_start", "run_end", "n")


def gaps(runs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, gap_start, gap_end, seconds: what lies between successive runs of a series (a table of ``sessions``, as its sink holds it)."""
    w = Window.partitionBy(*keys).orderBy("run_start")
    pairs = runs.select(*keys, F.lag("run_end").over(w).alias("gap_start"), F.col("run_start").alias("gap_end")).where("gap_start is not null")
    return pairs.withColumn("seconds", F.unix_seconds("gap_end") - F.unix_seconds("gap_start"))


def hourly(stream: DataFrame, keys: list[str], time: str, value: str, late: str, bin_: str = "1 hour") -> DataFrame:
    """keys, t (start of the bin), mean, sum, n and n_valid of each bin with rows, once the watermark has passed it; missing values count in n only."""
    marked = stream.where(F.col(time).isNotNull())
    marked = marked.withWatermark(time, late) if stream.isStreaming else marked
    g = marked.groupBy(*keys, F.window(time, bin_).alias("_w")).agg(F.avg(value).alias("mean"), F.sum(value).alias("sum"), F.count("*").alias("n"), F.count(value).alias("n_valid"))
    return g.select(*keys, F.col("_w.start").alias("t"), "mean", "sum", "n", "n_valid")


def every_hour(bins: DataFrame, keys: list[str]) -> DataFrame:
    """Bins of ``hourly`` with those between a series' first and last that had no rows: sum 0, no mean, counts 0."""
    ends = bins.groupBy(*keys).agg(F.min("t").alias("_a"), F.max("t").alias("_b"))
    grid = ends.select(*keys, F.explode(F.sequence("_a", "_b", F.expr("interval 1 hour"))).alias("t"))
    return grid.join(bins, [*keys, "t"], "left").withColumns({"sum": F.coalesce("sum", F.lit(0.0)), "n": F.coalesce("n", F.lit(0)), "n_valid": F.coalesce("n_valid", F.lit(0))})
