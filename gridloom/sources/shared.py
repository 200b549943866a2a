"""Tables kept in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only in local mode where that is unset."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="spark-"))
    return f"file://{_own[0]}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its rows are fixed, and a lost executor costs no recomputation."""
    path = f"{folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
