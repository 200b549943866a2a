"""Positions in an order over a whole table or a long key, and windows over pieces of long series, without a task that holds all rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.sources.shared import kept

from .joins import small
from .resample import dealt

#: Rows of a series that are worked on at once.
PIECE_ROWS = 8192


def _placed(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Kept rows dealt out by ranges of keys and order, each range with its number ``_p``."""
    return kept(df.repartitionByRange(*keys, *order).withColumn("_p", F.spark_partition_id()), name)


def join_same(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join on equal columns, nulls equal to each other; a right side of few rows is broadcast."""
    right = right.select(*(F.col(c).alias(f"_same_{i}") for i, c in enumerate(on)), *(c for c in right.columns if c not in on))
    match = None
    for i, c in enumerate(on):
        one = left[c].eqNullSafe(F.col(f"_same_{i}"))
        match = one if match is None else match & one
    return left.join(small(right), match).drop(*(f"_same_{i}" for i in range(len(on))))


def row_numbers(df: DataFrame, keys: list[str], order: list[str], out: str = "row") -> DataFrame:
    """``df`` with the place of each row in the order of its key, from 1, and ``_n``, the rows of its key.

    Rows are dealt out by ranges and numbered within them; a range adds what the ranges before it hold of the key. A key of any size is spread
    over tasks. Rows that tie in ``order`` are numbered in any order; nulls come first.
    """
    placed = _placed(df, keys, order, "ranges")
    counts = placed.groupBy(*keys, "_p").agg(F.count("*").alias("_c"))
    # a row for each range, and one more for each key: the keys of a range are next to each other
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    before = F.sum("_c").over(whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn("_before", F.coalesce(before, F.lit(0))).withColumn("_n", F.sum("_c").over(whole)).drop("_c")
    joined = join_same(placed, offsets, [*keys, "_p"])
    local = F.row_number().over(Window.partitionBy(*keys, "_p").orderBy(*order))
    return joined.withColumn(out, (F.col("_before") + local).cast("long")).drop("_p", "_before")


def dense_ranks(df: DataFrame, order: list[str], out: str = "rank") -> DataFrame:
    """``df`` with the dense rank of each row's values over the whole table, from 1: distinct values are dealt out by ranges and numbered within
    them, and a range adds the number of values in the ranges before it. Nulls come first and are equal."""
    values = row_numbers(df.select(*order).distinct(), [], order, "_rank").drop("_n")
    values = kept(values.select(*order, F.col("_rank").cast("int").alias(out)), "ranks")
    return join_same(df, values, order)


def _over_series(df: DataFrame, keys: list[str], order: str, columns: list[str], fn: Callable[[dict[str, np.ndarray], np.ndarray, int, int, int], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """``over_pieces`` of series that are a piece each; the other columns travel along."""
    made = [c.split()[0] for c in schema.split(", ")]
    names = df.columns

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by(order)
        n = t.num_rows
        got = fn({c: t.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns}, np.arange(n), 0, n, n)
        return pa.table([*t.columns, *(pa.array(got[c]) for c in made)], names=[*names, *made])

    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), schema])
    return df.groupBy(*keys).applyInArrow(run, out)


def over_pieces(df: DataFrame, keys: list[str], order: str, columns: list[str], halo: int, fn: Callable[[dict[str, np.ndarray], np.ndarray, int, int, int], dict[str, np.ndarray]], schema: str, piece: int | None = None) -> DataFrame:
    """``df`` with the columns of ``schema`` that ``fn`` makes of pieces of each series.

    A piece is ``piece`` rows of a series with ``halo`` rows more on each side, so ``fn(values, place, lo, hi, n)`` sees what a window of up to
    ``halo`` rows needs: arrays of the columns (not-a-number for null) in order, each row's place in its series from 0, the piece's own rows
    [lo, hi) among them, and the length of the series. Long series spread over as many tasks as they have pieces; where no series is longer than a
    piece, each is worked on as it lies, without numbers and a join.
    """
    piece = max(piece or PIECE_ROWS, halo)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("longest"), F.sum("n").alias("rows")).first()
    if (sizes["longest"] or 0) <= piece:
        return dealt(_over_series(df, keys, order, columns, fn, schema), keys, sizes["rows"] or 0)
    numbered = kept(row_numbers(df.select(*keys, order, *columns).withColumn("_t", F.col(order)), keys, [order], "_i").withColumn("_i", F.col("_i") - 1), "numbered")
    own = F.expr(f"_i div {piece}")
    near = F.array_distinct(F.array(own, F.expr(f"greatest(0, _i - {halo}) div {piece}"), F.expr(f"(_i + {halo}) div {piece}")))
    pieces = numbered.withColumn("_piece", F.explode(near))
    made = [c.split()[0] for c in schema.split(", ")]
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.select(*keys, order).schema.fields), schema])

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("_i")
        place = t.column("_i").to_numpy()
        at = t.column("_piece")[0].as_py() * piece
        lo, hi = (int(x) for x in np.searchsorted(place, (at, at + piece)))
        values = {c: t.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns}
        got = fn(values, place, lo, hi, t.column("_n")[0].as_py())
        part = t.slice(lo, hi - lo)
        return pa.table([*(part.column(c) for c in (*keys, order)), *(pa.array(got[c]) for c in made)], names=[*keys, order, *made])

    results = kept(pieces.groupBy(*keys, "_piece").applyInArrow(run, out), "pieces")
    return join_same(df, results, [*keys, order])
