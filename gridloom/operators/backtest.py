"""Back-test of gap filling: spans of known rows are hidden, filled by several methods and scored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.sources.shared import kept

from . import skill
from .ranks import join_same
from .windows import islands

Method = Callable[[DataFrame, list[str], str, str], DataFrame]


def truth_segments(df: DataFrame, keys: list[str], time: str, value: str, least: int = 1) -> DataFrame:
    """keys, time, value and ``i`` (from 0): the rows of each series' longest run of known values, the earliest of equally long ones, if it has
    ``least`` rows."""
    known = islands(df.select(*keys, time, value), keys, time, F.col(value).isNotNull()).where(F.col(value).isNotNull())
    # windows over the shuffle that found the runs: a join would make the series again
    run = Window.partitionBy(*keys, "_island")
    sized = known.withColumn("_run", F.struct(F.count(F.lit(1)).over(run).alias("n"), (-F.min(time).over(run)).alias("start"))).where(F.col("_run.n") >= least)
    own = sized.withColumn("_best", F.max("_run").over(Window.partitionBy(*keys))).where(F.col("_run") == F.col("_best")).select(*keys, time, value)
    return own.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy(time)) - 1)


def _number(text: Column) -> Column:
    """Thirty-two bits of a hash that other engines have too."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def hidden_spans(lengths: DataFrame, keys: list[str], n: str, sizes: list[int], reps: int) -> DataFrame:
    """keys, size, rep (from 1) and start (from 0): for each segment of at least three sizes up to ``reps`` spans of each size to hide.

    A segment is cut into slots of three sizes, the slots are drawn in the order of a hash of segment, size and slot, and a span begins within
    the first third of its slot. So spans of a size never overlap, begin two sizes apart at least and stay inside their segment, and the same
    segments give the same spans; a segment too short for all ``reps`` has fewer.
    """
    sized = lengths.select(*keys, F.col(n).alias("_n"), F.explode(F.array(*map(F.lit, sizes))).alias("size")).where(F.col("_n") >= 3 * F.col("size"))
    slots = sized.withColumn("_slot", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(_n - 2 * size) div (3 * size)"))))
    name = F.concat_ws("|", *(F.col(k).cast("string") for k in keys), F.col("size").cast("string"), F.col("_slot").cast("string"))
    drawn = slots.withColumn("_h", F.md5(name)).withColumn("rep", F.row_number().over(Window.partitionBy(*keys, "size").orderBy("_h", "_slot"))).where(F.col("rep") <= reps)
    return drawn.select(*keys, "size", "rep", (F.col("_slot") * 3 * F.col("size") + _number(name) % F.col("size")).alias("start"))


def masked(segments: DataFrame, keys: list[str], value: str, spans: DataFrame) -> DataFrame:
    """A copy of each segment for each of its spans: ``truth`` is the value, which is null in the span (``hidden``)."""
    each = spans.groupBy(*keys).agg(F.collect_list(F.struct("size", "rep", "start")).alias("_spans"))
    rows = join_same(segments, each, keys).withColumn("_s", F.explode("_spans"))
    inside = (F.col("i") >= F.col("_s.start")) & (F.col("i") < F.col("_s.start") + F.col("_s.size"))
    return rows.select(*segments.columns, F.col("_s.size").alias("size"), F.col("_s.rep").alias("rep"), F.col(value).alias("truth"), inside.alias("hidden")).withColumn(value, F.when(~F.col("hidden"), F.col(value)))


def run(segments: DataFrame, keys: list[str], time: str, value: str, sizes: list[int], reps: int, methods: dict[str, Method], by: list[str] | None = None) -> DataFrame:
    """Pooled errors (``skill.pooled``) of each method and size, and of each of ``by`` (such as the series) if named.

    Segments and their hidden copies are written once; every method fills them as series of their own, and one aggregate scores the hidden rows of all. A
    row that a method leaves empty doesn't count, and shows in n.
    """
    segments = kept(segments, "segments")
    lengths = segments.groupBy(*keys).agg(F.count("*").alias("_n"))
    copies = kept(masked(segments, keys, value, hidden_spans(lengths, keys, "_n", sizes, reps)), "hidden")
    group = ["method", "size", *(by or [])]
    every = None
    for name, method in methods.items():
        filled = method(copies, [*keys, "size", "rep"], time, value).where("hidden").select(F.lit(name).alias("method"), "size", *(by or []), "truth", "filled")
        every = filled if every is None else every.unionByName(filled)
    return skill.pooled(skill.error_sums(every, group, "truth", "filled"), group)
