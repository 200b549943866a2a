"""Streams that arrive in files, some rows late, against the batch answer."""

import datetime as dt

from pyspark.sql import functions as F

from gridloom.operators import resample
from gridloom.streaming import incremental, sessions

T0 = dt.datetime(2024, 3, 1)


def rows():
    """(key, minutes, value) by file: runs and gaps of two series; within a file and up to an hour across files out of order."""
    first = [("a", m, 1.0) for m in (0, 20, 40, 55, 300)] + [("b", m, 2.0) for m in (5, 10)] + [("a", 70, None)]
    second = [("a", m, 3.0) for m in (340, 320, 900, 905)] + [("b", m, None if m == 610 else 4.0) for m in (600, 610, 640)]
    third = [("a", m, 5.0) for m in (2000, 2010, 960)] + [("b", 2000, 6.0), ("b", 650, 7.0)]
    return [first, second, third]


def frame(spark, part):
    return spark.createDataFrame([(k, T0 + dt.timedelta(minutes=m), v) for k, m, v in part], "k string, ts timestamp, v double")


def stream(spark, tmp_path, parts, build):
    """Rows of a streaming query over the parts as files, one a batch, and a last row far ahead that lets every run out."""
    for i, part in enumerate([*parts, [("end", 10_000, 0.0)], [("end", 10_001, 0.0)]]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        src = spark.readStream.schema("k string, ts timestamp, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = build(src).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out")).where("k <> 'end'")


def test_runs_and_gaps_equal_the_batch_answer(spark, tmp_path):
    out = stream(spark, tmp_path, rows(), lambda s: sessions.sessions(s, ["k"], "ts", "60 minutes", "30 hours", "v"))
    whole = frame(spark, [r for part in rows() for r in part])
    batch = sessions.sessions(whole, ["k"], "ts", "60 minutes", "30 hours", "v")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.collect()))
    got = [(r["k"], r["seconds"] // 60) for r in sessions.gaps(out, ["k"]).orderBy("k", "gap_start").collect()]
    minutes = {k: sorted({m for part in rows() for key, m, v in part if key == k and v is not None}) for k in "ab"}
    assert got == [(k, b - a) for k in "ab" for a, b in zip(minutes[k], minutes[k][1:]) if b - a >= 60]


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    parts = [[("a", 0, 1.0)], [("a", 3000, 1.0)], [("a", 30, 1.0), ("a", 3010, 1.0)]]
    out = stream(spark, tmp_path, parts, lambda s: sessions.sessions(s, ["k"], "ts", "60 minutes", "10 minutes"))
    assert [(r["n"], r["run_start"] - T0) for r in out.orderBy("run_start").collect()] == [(1, dt.timedelta(0)), (2, dt.timedelta(minutes=3000))]


def test_hourly_bins_equal_the_batch_resample(spark, tmp_path):
    out = sessions.every_hour(stream(spark, tmp_path, rows(), lambda s: sessions.hourly(s, ["k"], "ts", "v", "40 hours")), ["k"])
    whole = frame(spark, [r for part in rows() for r in part]).withColumn("hr", F.expr("unix_seconds(ts) div 3600"))
    want = {(r["k"], r["hr"]): (r["m"], r["s"]) for r in resample.calendar(whole, ["k"], "hr", 1, {"m": ("mean", "v"), "s": ("sum", "v")}).collect()}
    got = {(r["k"], r["h"]): (r["mean"], r["sum"]) for r in out.withColumn("h", F.expr("unix_seconds(t) div 3600")).collect()}
    assert set(got) == set(want) and all(got[x][0] == want[x][0] and (got[x][1] or 0) == (want[x][1] or 0) for x in want)


def test_windowed_means(spark, tmp_path):
    out = stream(spark, tmp_path, rows(), lambda s: incremental.windowed_means(s, ["k"], "ts", "v", "1 hour", "40 hours"))
    whole = frame(spark, [r for part in rows() for r in part])
    want = {(r["k"], r["w"]): r["m"] for r in whole.groupBy("k", F.window("ts", "1 hour")["start"].alias("w")).agg(F.avg("v").alias("m")).collect()}
    start = [c for c in out.columns if c not in ("k", "mean", "n")][0]
    got = {(r["k"], getattr(r[start], "start", r[start])): r["mean"] for r in out.collect()}
    assert got == want
