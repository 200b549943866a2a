"""Area of applicability: dissimilarity of feature vectors to a training cloud."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.sources.shared import kept

from . import quantiles
from .neighbours import _matrix

#: Numbers of training vectors (rows x features) that are broadcast at most; a larger cloud is dealt out in blocks of so many.
CLOUD_NUMBERS = 2_000_000
#: Rows and columns of the distances that a task has at once.
TILE = 512, 2048


def statistics(df: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample deviation of each feature; one row a feature reaches the driver."""
    rows = df.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s")).orderBy("i").collect()
    return np.array([r["m"] for r in rows], float), np.array([r["s"] or 0.0 for r in rows], float)


def scale(x: np.ndarray, mean: np.ndarray, std: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Standardised and weighted; a feature that doesn't vary is 0."""
    z = np.where(std > 0, (x - mean) / np.where(std > 0, std, 1), 0.0)
    return z if weight is None else z * weight


def _whole(df: DataFrame, vector: str) -> DataFrame:
    """Rows with a vector of known numbers."""
    return df.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x)))


def _tiles(x: np.ndarray, c: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, first column, squared distances) for tiles of the rows of x against those of c, right up to rounding; a tile is valid until the next."""
    left = np.hstack([-2 * x, (x * x).sum(1)[:, None], np.ones((len(x), 1))])
    right = np.hstack([c, np.ones((len(c), 1)), (c * c).sum(1)[:, None]])
    space = np.empty(TILE[0] * TILE[1])
    for i in range(0, len(x), TILE[0]):
        a = left[i : i + TILE[0]]
        for j in range(0, len(c), TILE[1]):
            b = right[j : j + TILE[1]]
            yield i, j, np.matmul(a, b.T, out=space[: len(a) * len(b)].reshape(len(a), len(b)))


def _blocks(df: DataFrame, columns: list[str], parts: int, name: str) -> DataFrame:
    """Kept rows with ``_b``, one of so many blocks of about equal size, dealt out by row and not by value, so that equal vectors are spread."""
    return kept(df.select(*columns, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int").alias("_b")), name)


def _block_pairs(left: DataFrame, right: DataFrame, i: int, j: int, columns: list[str], right_columns: list[str], fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str, half: bool = False) -> DataFrame:
    """``fn`` for every pair of the i and j blocks, a pair a task; with ``half`` only for pairs whose left block doesn't come after the right one."""
    to, since = F.lit(j - 1), F.lit(i - 1)
    left = left.withColumn("_i", F.col("_b")).withColumn("_j", F.explode(F.sequence(F.col("_b") if half else F.lit(0), to)))
    right = right.withColumn("_j", F.col("_b")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_b") if half else since)))
    pairs = i * j if not half else i * (i + 1) // 2
    left = left.select(*columns, "_i", "_j").repartition(pairs, "_i", "_j")
    right = right.select(*(F.col(c).alias(f"_t{k}") for k, c in enumerate(right_columns)), "_i", "_j").repartition(pairs, "_i", "_j")
    own, other = [*columns, "_i", "_j"], [f"_t{k}" for k in range(len(right_columns))]
    return left.groupBy("_i", "_j").cogroup(right.groupBy("_i", "_j")).applyInArrow(lambda a, b: fn(a.select(own), b.select(other)), schema)


def _against_cloud(df: DataFrame, train: DataFrame, columns: list[str], train_columns: list[str], width: int, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``fn(rows, cloud)`` for every block of rows and block of the training cloud. A cloud of at most ``CLOUD_NUMBERS`` numbers is one block
    that is broadcast; of a larger one the blocks meet on the executors: a row is sent to as many tasks as the other side has blocks."""
    df, train = df.select(*columns), train.select(*train_columns)
    n = train.count()
    if n * width <= CLOUD_NUMBERS:
        shared = df.sparkSession.sparkContext.broadcast(train.toArrow())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield from fn(pa.Table.from_batches([b]), shared.value).to_batches()

        cores = df.sparkSession.sparkContext.defaultParallelism
        return df.repartition(cores).mapInArrow(run, schema)
    rows = max(1, CLOUD_NUMBERS // width)
    i, j = max(1, -(-df.count() // rows)), -(-n // rows)
    return _block_pairs(_blocks(df, columns, i, "rows"), _blocks(train, train_columns, j, "cloud"), i, j, columns, train_columns, fn, schema)


def nearest_distance(df: DataFrame, train: DataFrame, vector: str, mean: np.ndarray, std: np.ndarray, weight: np.ndarray | None = None, fold: str | None = None, id_col: str = "id") -> DataFrame:
    """(id, nearest): distance to the nearest training vector, of another fold if ``fold`` is named (null if there is none, and for rows that lack
    a number).

    Blocks meet as matrix products; the pair found is measured again by differences, so equal vectors have distance 0. All pairs are compared:
    in tens of dimensions the triangle inequality spares little, and looking for it moves each vector more often than a product needs it.
    """
    width, extra = len(mean), [fold] if fold else []

    def run(rows: pa.Table, cloud: pa.Table) -> pa.Table:
        if not rows.num_rows or not cloud.num_rows:
            return pa.table({id_col: pa.array([], pa.int64()), "nearest": pa.array([], pa.float64())})
        x, c = (scale(_matrix(t), mean, std, weight) for t in (rows.column(1), cloud.column(0)))
        if fold:
            codes = pa.chunked_array([*rows.column(2).chunks, *cloud.column(1).chunks]).combine_chunks().dictionary_encode("encode").indices.to_numpy()
            own, folds = codes[: len(x)], codes[len(x) :]
        best, at = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
        for i, j, d in _tiles(x, c):
            if fold:
                np.copyto(d, np.inf, where=own[i : i + len(d), None] == folds[None, j : j + d.shape[1]])
            k = d.argmin(1)
            v = d[np.arange(len(d)), k]
            less = np.flatnonzero(v < best[i : i + len(d)])
            best[i + less], at[i + less] = v[less], j + k[less]
        near = np.concatenate([np.sqrt(((x[i : i + 8192] - c[at[i : i + 8192]]) ** 2).sum(1)) for i in range(0, len(x), 8192)])
        return pa.table({id_col: rows.column(0).cast(pa.int64()), "nearest": pa.array(near, mask=~np.isfinite(best))})

    asked = df.select(id_col, vector, *extra)
    out = _against_cloud(_whole(asked, vector), _whole(train, vector), [id_col, vector, *extra], [vector, *extra], width, run, f"`{id_col}` bigint, nearest double")
    return asked.select(F.col(id_col).cast("long").alias(id_col), F.lit(None).cast("double").alias("nearest")).unionByName(out).groupBy(id_col).agg(F.min("nearest").alias("nearest"))


def _sums(rows: pa.Table, cloud: pa.Table, mean: np.ndarray, std: np.ndarray, weight: np.ndarray | None) -> np.ndarray:
    """Sum of the distances of each row to the cloud; vectors are the last columns but for the blocks' numbers."""
    x, c = (scale(_matrix(t), mean, std, weight) for t in (rows, cloud))
    sums = np.zeros(len(x))
    for i, _, d in _tiles(x, c):
        np.copyto(d, 0.0, where=d <= 1e-10)
        sums[i : i + len(d)] += np.sqrt(d, out=d).sum(1)
    return sums


def mean_distance(df: DataFrame, vector: str, mean: np.ndarray, std: np.ndarray, weight: np.ndarray | None = None) -> float:
    """Mean distance over all pairs of rows with a whole vector, block against block, each pair of blocks once; one sum reaches the driver."""
    df = _whole(df, vector)
    n, width = df.count(), len(mean)

    def run(rows: pa.Table, cloud: pa.Table) -> pa.Table:
        if not rows.num_rows or not cloud.num_rows:
            return pa.table({"s": pa.array([], pa.float64())})
        times = 1.0 if "_i" not in rows.column_names or rows.column("_i")[0] == rows.column("_j")[0] else 2.0
        return pa.table({"s": [times * float(_sums(rows.column(0), cloud.column(0), mean, std, weight).sum())]})

    if n * width <= CLOUD_NUMBERS:
        parts = _against_cloud(df, df, [vector], [vector], width, run, "s double")
    else:
        k = -(-n // max(1, CLOUD_NUMBERS // width))
        blocks = _blocks(df, [vector], k, "cloud")
        parts = _block_pairs(blocks, blocks, k, k, [vector], [vector], run, "s double", half=True)
    total = parts.agg(F.sum("s")).first()[0] or 0.0
    return total / (n * (n - 1)) if n > 1 else 0.0


def sampled_mean_distance(df: DataFrame, vector: str, mean: np.ndarray, std: np.ndarray, sample: int, id_col: str = "id", weight: np.ndarray | None = None) -> tuple[float, float]:
    """(mean distance, its standard error) over all pairs of ``sample`` rows, those first in the order of a hash of the id: the same rows
    whatever the partitions, and a uniform sample. With no more rows than that the mean is exact and the error 0.

    The error is that of a mean of pairs (a U-statistic): twice the standard error of the rows' own mean distances.
    """
    n = df.count()
    if n <= sample:
        return mean_distance(df, vector, mean, std, weight), 0.0
    # a hash cut first, so that what is sorted follows the sample
    cut = df.where(F.pmod(F.xxhash64(id_col, F.lit(11)), F.lit(1 << 30)) < int(min(1.0, 4.0 * sample / n + 64 / n) * (1 << 30)))
    chosen = kept(cut.orderBy(F.xxhash64(id_col, F.lit(11)), id_col).limit(sample).select(id_col, vector), "sample")

    def run(rows: pa.Table, cloud: pa.Table) -> pa.Table:
        return pa.table({"id": rows.column(0).cast(pa.int64()), "s": _sums(rows.column(1), cloud.column(0), mean, std, weight)})

    m = chosen.count()
    per_row = _against_cloud(chosen, chosen, [id_col, vector], [vector], len(mean), run, "id bigint, s double").groupBy("id").agg((F.sum("s") / (m - 1)).alias("s"))
    r = per_row.agg(F.avg("s").alias("m"), F.stddev_samp("s").alias("s")).first()
    return (float(r["m"]), 2.0 * float(r["s"] or 0.0) / float(np.sqrt(m))) if m > 1 else (0.0, 0.0)


def threshold(di: DataFrame, column: str = "di") -> DataFrame:
    """Upper quartile plus one and a half interquartile ranges; a large table's quartiles are found without a task that holds all values."""
    di = kept(di.select(column), "di")
    if quantiles.fits(di):
        q = di.agg(F.expr(f"percentile(`{column}`, array(0.25, 0.75))").alias("q"))
    else:
        q = quantiles.exact_quantiles(di, column, [0.25, 0.75]).select(F.col("quantiles").alias("q"))
    return q.select((F.col("q")[1] + 1.5 * (F.col("q")[1] - F.col("q")[0])).alias("threshold"))


def monthly(df: DataFrame, keys: list[str], di: str, inside: str) -> DataFrame:
    """Median, mean, sample deviation (0 for one value), share inside and count."""
    return df.groupBy(*keys).agg(F.median(di).alias("median_di"), F.avg(di).alias("mean_di"), F.coalesce(F.stddev_samp(di), F.lit(0.0)).alias("std_di"), F.avg(F.col(inside).cast("double")).alias("inside"), F.count("*").alias("n"))


def roll_up(m: DataFrame, cell: list[str], year: str, month: str) -> DataFrame:
    """Per cell and year, per cell and month, and per cell: median of medians, mean of means, sum of counts, in one pass of grouping sets."""
    sets = [[*cell, year], [*cell, month], cell]
    return m.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in (*cell, year, month)]).agg(F.median("median_di").alias("median_di"), F.avg("mean_di").alias("mean_di"), F.sum("n").alias("n"))
