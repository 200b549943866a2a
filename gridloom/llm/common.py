"""Helpers that several corpus operators share: shared tables, id/text views, skew-safe joins."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters handled at once by the numpy routines, so that a worker's memory doesn't follow the Arrow batch.
CHUNK_CHARS = 1 << 18

#: Rows in an Arrow batch at most: texts and sketches are long, and the default of 10,000 rows would fill a worker.
BATCH_ROWS = 2000

_own_dir: list[str] = []


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch to ``BATCH_ROWS`` rows where it is larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a temporary one only in local mode where it is unset."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="spark-"))
    return f"file://{_own_dir[0]}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_path = path
    return out


def discard(*kept: DataFrame) -> None:
    """Delete tables that ``keep`` wrote and that nothing reads any more."""
    for df in kept:
        jvm = getattr(df.sparkSession, "_jvm", None)
        if jvm is not None:
            path = jvm.org.apache.hadoop.fs.Path(df.kept_path)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator works on, under fixed names; extra columns can't clash with its results."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def crc_bucket(col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n (null ids count as the empty text)."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def release() -> None:
    """Give memory that a task has freed back to the system. Python workers outlive their tasks, and those of the next stage stand beside them."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(lengths: list[int], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges whose lengths sum to about ``limit``; one text that is longer stands alone."""
    lo = total = 0
    for i, n in enumerate(lengths):
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(lengths):
        yield lo, len(lengths)


def map_texts(df: DataFrame, fn: Callable[[list], dict], schema: str, keep_text: bool = False) -> DataFrame:
    """Apply ``fn(texts) -> {column: values}`` to bounded slices of the ``text`` column; ``doc_id`` and other columns pass through.

    ``schema`` is the DDL of the columns that ``fn`` adds. Null texts are handed over as None. ``keep_text`` passes the text through too.
    """
    small_batches(df.sparkSession)
    passed = [f for f in df.schema.fields if keep_text or f.name != "text"]
    names = [f.name for f in passed]
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in passed) + ", " + schema
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            for lo, hi in slices([len(t or "") for t in texts]):
                cols = fn(texts[lo:hi])
                part = batch.slice(lo, hi - lo)
                arrays = [part.column(part.schema.get_field_index(n)).cast(arrow.field(n).type) for n in names]
                arrays += [pa.array(cols[f.name], type=f.type) for f in list(arrow)[len(names):]]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
            batch = texts = cols = part = arrays = None
            release()

    return df.mapInArrow(run, out)


#: Rows of two short columns (some 100 bytes each) that are broadcast at most.
FEW_ROWS = 200_000


def few(kept: DataFrame, rows: int = FEW_ROWS) -> DataFrame:
    """A kept table with a broadcast hint if a count finds no more than ``rows`` rows: what it is joined to then needs no shuffle."""
    return F.broadcast(kept) if kept.count() <= rows else kept


#: Groups with at least this share of the rows count as hot; there can be no more than its inverse of them.
HOT_SHARE = 1 / 500


def join_groups(rows: DataFrame, groups: DataFrame, key: str, count_col: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one ``groups`` row per key, safe for keys that hold a large share of the rows.

    Groups with ``count_col >= HOT_SHARE * total`` number at most 1/HOT_SHARE, so that part is broadcast; the others are joined by a
    shuffle in which no key is hot.
    """
    least = max(1000, int(total * HOT_SHARE))
    hot = F.broadcast(groups.where(F.col(count_col) >= least))
    flagged = rows.join(hot.select(F.col(key), F.lit(True).alias("_hot")), key, "left")
    warm = flagged.where("_hot is null").drop("_hot").join(groups.where(F.col(count_col) < least), key)
    return rows.join(hot, key).unionByName(warm)
