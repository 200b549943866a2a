"""Operator 2, exact deduplication: a tree merge of sorted digest runs, in DataFrame operations only.

Every row is digested once and the (digest, id) rows are kept in the shared folder. A run is what the partitions of one number have
(partition number modulo ``runs``), sorted by digest with equal digests merged. In each round, ``fan_in`` runs whose numbers differ in
their lowest digit only meet, binomial rounds with a multiway merge each: their rows are sorted by digest and equal digests merged,
keeping the row that stays and the number of copies; after log(runs)/log(fan_in) rounds one row for each text is left. Spark does the
merges as sorted aggregates (the row that stays is a struct, for which Spark sorts instead of hashing), dealt out by run and digest, so
that a late round with few runs has as many tasks as the first. Equality is verified at every level: rows merge only where SHA-256, length
in bytes and a second 64-bit hash agree; the texts themselves are not moved. A merge takes a row for each digest and run at most, so a
text with any number of copies never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few, id_text, join_groups, keep, read

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Texts of one byte a character take Spark's fast path, which does the same there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest (SHA-256, 32 bytes), check (xxhash64), size in bytes, part and row (numbers of the partition and of the row) of each
    row's normalised text; null counts as empty."""
    norm = F.coalesce(ascii_lower(F.col("text")), F.lit(""))
    rows = id_text(docs, id_col, text_col).select("doc_id", norm.alias("norm"))
    return rows.select("doc_id", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("digest"), F.xxhash64("norm").alias("check"), F.octet_length("norm").alias("size"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"))


def merge_runs(rows: DataFrame, keys: list[str], runs: int = 64, fan_in: int = 8, largest: bool = True) -> DataFrame:
    """One row per key with keep_id, keep_row and group_size, by rounds of merging runs (``rows``: the keys, doc_id, part and row).

    ``largest``: the largest id stays, else the smallest; of rows with that id the last or first one. A null id stays only if there is no other.
    """
    pick = F.max if largest else F.min
    rank = F.col("doc_id").isNotNull() if largest else F.col("doc_id").isNull()
    level = rows.select(*keys, F.pmod("part", F.lit(runs)).alias("run"), F.struct(rank.alias("known"), "doc_id", "row").alias("stays"), F.lit(1).cast("long").alias("group_size"))

    def merged(level: DataFrame) -> DataFrame:
        return level.groupBy("run", *keys).agg(pick("stays").alias("stays"), F.sum("group_size").alias("group_size"))

    level = merged(level)
    while runs > 1:
        runs = -(-runs // fan_in)
        level = merged(level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")))
    return level.select(*keys, F.col("stays.doc_id").alias("keep_id"), F.col("stays.row").alias("keep_row"), "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True, runs: int = 64, fan_in: int = 8) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null and empty texts are equal to each other; of equal texts the row with the largest id stays (``largest=False``: the smallest).
    Of rows that repeat both id and text one stays, whichever comes last (first) in the table's partitions; a null id stays only where its
    group has no other. An empty table gives an empty result. Columns besides the id and the text are ignored.
    """
    keys = ["digest", "check", "size"]
    rows = keep(digests(docs, id_col, text_col), "digests")
    groups = keep(merge_runs(rows, keys, runs, fan_in, largest), "groups")
    several = groups.where("group_size > 1").select("digest", F.col("check").alias("check2"), F.col("size").alias("size2"), "keep_id", "keep_row", "group_size")
    total = rows.count()
    # Few texts have copies; the rest need no partner. A digest row is 32 bytes, whatever the text's length.
    copied = join_groups(rows, several, "digest", "group_size", total).where("check = check2 and size = size2").select("doc_id", "digest", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"))
    single = groups.where("group_size = 1").select(F.col("keep_id").alias("doc_id"), "digest", "keep_id", "group_size", F.lit(True).alias("kept"))
    return copied.unionByName(single).select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """One row of each text, the one with the largest id; all columns stay. Of rows that repeat both id and text any one stays."""
    seen = keep(exact_dedup(docs).where("group_size > 1").select(F.col("doc_id").alias("_id"), F.col("keep_id").alias("_keep"), F.col("text_sha256").alias("_sha")), "copies")
    sha = F.sha2(F.coalesce(ascii_lower(F.col("text")), F.lit("")).cast("binary"), 256)
    same = docs["doc_id"].eqNullSafe(F.col("_id")) & (sha == F.col("_sha"))
    gone = keep(seen.where("not (_id <=> _keep)").select("_id", "_sha").distinct(), "gone")
    left = docs.join(few(gone), same, "left_anti")
    # rows that repeat id and text of the one that stays can't be told apart by either
    doubled = keep(seen.where("_id <=> _keep").groupBy("_id", "_sha").count().where("count > 1").select("_id", "_sha"), "doubled")
    if doubled.isEmpty():
        return left
    doubled = few(doubled)
    one = left.withColumn("_text_sha", sha).join(doubled, docs["doc_id"].eqNullSafe(F.col("_id")) & (F.col("_text_sha") == F.col("_sha"))).dropDuplicates(["_id", "_sha"])
    return left.join(doubled, same, "left_anti").unionByName(one.select(*docs.columns))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


OP2_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
