"""Exact nearest neighbours in a vector space, within a key: blocks against blocks, pruned by pivots.

Points of a key with more rows than a block are dealt to the cells of some pivots (points of the key, in hash order); a cell with more rows
than a block is split by row. A query first meets the points of its own cell. Its k-th distance found there bounds what others may
contribute: by the triangle inequality no point of a cell is nearer to it than its distance to the pivot less the cell's radius, so only
cells for which that is within the bound are visited. Blocks meet as matrix products in tasks of two blocks each; what the product finds is
measured again by differences, so equal vectors have distance 0 and ties go to the smaller id. Lists of k are merged by an aggregate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.sources.shared import kept

#: Rows of a block, about; pivots of a key, keys that get pivots (those with the most points) and numbers in all pivots at most.
BLOCK_ROWS, PIVOTS, LARGE_KEYS, PIVOT_NUMBERS = 4096, 64, 200, 2_000_000
#: Rows (of a key, a cell and a count, some 60 bytes) that are broadcast at most.
FEW_ROWS = 200_000

_NEAR = "array<struct<distance: double, id: bigint, value: double>>"


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= FEW_ROWS else df


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of c as a product; right up to rounding."""
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T, 0.0)


def top_k(x: np.ndarray, c: np.ndarray, ids: np.ndarray, k: int, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of c, distance) of the k nearest rows of c to each row of x, in order; of equal distances the smaller id. ``apart``: which
    pairs count."""
    rows, cols, dist = [], [], []
    for lo in range(0, len(x), 1024):
        part = x[lo : lo + 1024]
        d = distances(part, c)
        if apart is not None:
            d[~apart[lo : lo + 1024]] = np.inf
        edge = np.partition(d, k - 1, 1)[:, k - 1] if d.shape[1] > k else np.full(len(part), np.inf)
        slack = 1e-9 * ((part * part).sum(1) + (c * c).sum(1).max(initial=0.0) + 1e-300)
        r, j = np.nonzero((d <= (edge + slack)[:, None]) & np.isfinite(d))
        exact = np.concatenate([np.sqrt(((part[r[i : i + 50_000]] - c[j[i : i + 50_000]]) ** 2).sum(1)) for i in range(0, len(r), 50_000)]) if len(r) else np.zeros(0)
        order = np.lexsort((ids[j], exact, r))
        r, j, exact = r[order], j[order], exact[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        rows.append(r[place < k] + lo)
        cols.append(j[place < k])
        dist.append(exact[place < k])
    return tuple(np.concatenate(v) if v else np.zeros(0, int) for v in (rows, cols, dist))


def _pivots(points: DataFrame, move: Callable[[np.ndarray], np.ndarray]) -> dict[str, np.ndarray]:
    """Pivots of the keys with the most points, all bounded."""
    large = points.groupBy("_k").agg(F.count("*").alias("n"), F.first(F.size("_x")).alias("width")).where(F.col("n") > BLOCK_ROWS).orderBy(F.desc("n"), "_k").limit(LARGE_KEYS).collect()
    if not large:
        return {}
    most = max(2, PIVOT_NUMBERS // (4 * len(large) * max(r["width"] for r in large)))
    want = {r["_k"]: min(PIVOTS, most, r["n"] // BLOCK_ROWS + 1) for r in large}
    cuts = points.sparkSession.createDataFrame([(r["_k"], 4.0 * want[r["_k"]] / r["n"]) for r in large], "_k string, _cut double")
    sample = points.join(F.broadcast(cuts), "_k").where(F.pmod(F.xxhash64("_x", F.lit(3)), F.lit(1 << 30)) < F.col("_cut") * (1 << 30)).select("_k", "_x").distinct()
    found: dict[str, list] = {}
    for r in sample.orderBy("_k", F.xxhash64("_x", F.lit(3)), "_x").collect():
        if len(own := found.setdefault(r["_k"], [])) < want[r["_k"]]:
            own.append(r["_x"])
    return {k: move(np.array(v, float)) for k, v in found.items()}


def _dealt(rows: DataFrame, pivots: dict[str, np.ndarray], move: Callable[[np.ndarray], np.ndarray], name: str) -> DataFrame:
    """Kept rows with the vector moved, _row, the cell _c, the distance _r to its pivot, and _part, the block within the cell."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = move(_matrix(b.column(b.schema.get_field_index("_x"))))
            cell, r = np.zeros(len(x), np.int32), np.zeros(len(x))
            keys = np.array(b.column(b.schema.get_field_index("_k")).to_pylist(), object)
            for key in set(keys.tolist()) & shared.value.keys():
                own = np.flatnonzero(keys == key)
                p = shared.value[key]
                cell[own] = distances(x[own], p).argmin(1)
                r[own] = np.sqrt(((x[own] - p[cell[own]]) ** 2).sum(1))
            moved = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            at = b.schema.get_field_index("_x")
            columns = [moved if i == at else c for i, c in enumerate(b.columns)] + [pa.array(cell), pa.array(r)]
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names, "_c", "_r"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = kept(rows.mapInArrow(run, f"{fields}, _c int, _r double").withColumn("_row", F.monotonically_increasing_id()), name)
    split = placed.groupBy("_k", "_c").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK_ROWS).select("_k", "_c", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("_parts"))
    return placed.join(_few(kept(split, "split")), ["_k", "_c"], "left").withColumn("_parts", F.coalesce("_parts", F.lit(1))).withColumn("_part", F.pmod(F.xxhash64("_row"), F.col("_parts")).cast("int"))


def _meet(queries: DataFrame, points: DataFrame, on: list[str], k: int, other: bool) -> DataFrame:
    """(_row, _pc, near) from each group of ``on``: a block of queries with a block of points."""

    def run(q: pa.Table, p: pa.Table) -> pa.Table:
        empty = pa.table({"_row": pa.array([], pa.int64()), "_pc": pa.array([], pa.int32()), "near": pa.array([], pa.list_(pa.struct([("distance", pa.float64()), ("id", pa.int64()), ("value", pa.float64())])))})
        if not q.num_rows or not p.num_rows:
            return empty
        ids = p.column("_id").to_numpy()
        apart = np.array(q.column("_o").to_pylist(), object)[:, None] != np.array(p.column("_o").to_pylist(), object)[None] if other else None
        r, j, d = top_k(_matrix(q.column("_x")), _matrix(p.column("_x")), ids, k, apart)
        if not len(r):
            return empty
        first = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        near = pa.StructArray.from_arrays([pa.array(d), pa.array(ids[j]), p.column("_v").combine_chunks().take(pa.array(j))], ["distance", "id", "value"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(r)), pa.int32()), near)
        return pa.table({"_row": pa.array(q.column("_row").to_numpy()[r[first]]), "_pc": pa.array(np.full(len(first), p.column("_pc")[0].as_py()), pa.int32()), "near": lists})

    left = queries.select(*on, "_row", "_x", "_o")
    right = points.select(*on, *([] if "_pc" in on else ["_pc"]), "_id", "_x", "_o", "_v")
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(run, f"_row bigint, _pc int, near {_NEAR}")


def _merged(lists: DataFrame, by: list[str], k: int) -> DataFrame:
    return lists.groupBy(*by).agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))


def nearest(queries: DataFrame, points: DataFrame, k: int, vector: str, id_col: str = "id", keys: list[str] | None = None, other: str | None = None, value: str | None = None,
            move: Callable[[np.ndarray], np.ndarray] | None = None, report: dict | None = None, point_id: str | None = None) -> DataFrame:
    """Each query row's keys and id, and ``near``: its k nearest points of the same key as structs (distance, id, value), nearest first.

    ``other``: only points whose value in this column differs; ``value``: a number of the point to carry along; ``move``: applied to blocks of
    vectors first, such as a scaling; ``point_id``: the points' id, if it has another name; ``report``: gets pairs of blocks compared and possible. Vectors of a key have one length. Rows with a
    null vector, or a null or not-a-number in it, are no points and find nothing (null ``near``), as do queries without a point in their key.
    Rows that repeat an id are rows of their own. With k = 1, points with the same vector are one (the smallest id).
    """
    keys = keys or []
    move = move or (lambda x: x)
    whole = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    key = F.to_json(F.struct(*keys)) if keys else F.lit("")
    side = F.col(other).cast("string") if other else F.lit(None).cast("string")
    p = points.where(whole).select(key.alias("_k"), F.col(point_id or id_col).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_x"), side.alias("_o"), (F.col(value).cast("double") if value else F.lit(None).cast("double")).alias("_v"))
    if k == 1:
        p = p.groupBy("_k", "_x", "_o").agg(F.min_by(F.struct("_id", "_v"), "_id").alias("f")).select("_k", F.col("f._id").alias("_id"), "_x", "_o", F.col("f._v").alias("_v"))
    p = kept(p, "points")
    pivots = _pivots(p, move)
    p = _dealt(p, pivots, move, "point-blocks").withColumn("_pc", F.col("_c")).withColumnRenamed("_part", "_pp").withColumnRenamed("_parts", "_pps")
    asked = kept(queries.select(*keys, F.col(id_col), whole.alias("_whole"), key.alias("_k"), F.col(vector).cast("array<double>").alias("_x"), side.alias("_o")).withColumn("_ask", F.monotonically_increasing_id()), "asked")
    q = _dealt(asked.where("_whole").select("_k", F.col("_ask"), "_x", "_o"), pivots, move, "query-blocks").withColumnRenamed("_row", "_qrow").withColumnRenamed("_ask", "_row").withColumnRenamed("_part", "_qp")
    cells = kept(p.groupBy("_k", "_c").agg(F.max("_r").alias("radius"), F.max("_pps").alias("_pps"), F.count("*").alias("n")), "cells")
    blocks = kept(q.groupBy("_k", "_c").agg(F.max("_parts").alias("_qps")), "query-cells")
    parts = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    own_q = q.join(_few(cells.select("_k", "_c", "_pps")), ["_k", "_c"]).withColumn("_pp", parts("_pps"))
    own_p = p.join(_few(blocks), ["_k", "_c"]).withColumn("_qp", parts("_qps"))
    lists = kept(_merged(_meet(own_q, own_p, ["_k", "_c", "_qp", "_pp"], k, other is not None), ["_row"], k), "own-lists")
    seen = lists
    pairs = blocks.join(cells, ["_k", "_c"]).agg(F.sum(F.col("_qps") * F.col("_pps"))).first()[0] or 0 if report is not None else 0
    if pivots:
        radius: dict[str, np.ndarray] = {k_: np.full(len(v), -1.0) for k_, v in pivots.items()}
        for r in cells.where(F.col("_k").isin(list(pivots))).collect():
            radius[r["_k"]][r["_c"]] = r["radius"]
        shared = p.sparkSession.sparkContext.broadcast((pivots, radius))

        def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pivots, radius = shared.value
            for b in batches:
                if not b.num_rows:
                    continue
                x, bound = _matrix(b.column(4)), b.column(6).to_numpy(zero_copy_only=False)
                keys, cell = np.array(b.column(0).to_pylist(), object), b.column(1).to_numpy()
                for key in set(keys.tolist()):
                    at = np.flatnonzero(keys == key)
                    d = np.sqrt(((x[at][:, None] - pivots[key][None]) ** 2).sum(2))
                    slack = 1e-9 * (1 + d)
                    need = (d - radius[key][None] - slack <= bound[at][:, None]) & (radius[key][None] >= 0)
                    need[np.arange(len(at)), cell[at]] = False
                    r, c = np.nonzero(need)
                    yield pa.RecordBatch.from_arrays([*(col.take(pa.array(at[r])) for col in b.columns[:6]), pa.array(c, pa.int32())], ["_k", "_c", "_qp", "_row", "_x", "_o", "_pc"])

        far = lists.select("_row", F.when(F.size("near") >= k, F.element_at("near", -1)["distance"]).alias("_far"))
        bounded = q.where(F.col("_k").isin(list(pivots))).join(far, "_row", "left").select("_k", "_c", "_qp", "_row", "_x", "_o", F.coalesce("_far", F.lit(float("inf"))).alias("_far"))
        wanted = kept(bounded.mapInArrow(needs, "_k string, _c int, _qp int, _row bigint, _x array<double>, _o string, _pc int"), "wanted")
        visits = kept(wanted.select("_k", "_c", "_qp", "_pc").distinct(), "visits")
        sizes = cells.select("_k", F.col("_c").alias("_pc"), "_pps")
        more_q = wanted.join(_few(sizes), ["_k", "_pc"]).withColumn("_pp", parts("_pps"))
        more_p = p.drop("_c").join(_few(visits), ["_k", "_pc"])
        more = _meet(more_q, more_p, ["_k", "_c", "_qp", "_pc", "_pp"], k, other is not None)
        seen = lists.unionByName(_merged(_merged(more, ["_row", "_pc"], k), ["_row"], k))
        if report is not None:
            pairs += visits.join(sizes, ["_k", "_pc"]).agg(F.sum("_pps")).first()[0] or 0
    if report is not None:
        every = blocks.groupBy("_k").agg(F.sum("_qps").alias("a")).join(cells.groupBy("_k").agg(F.sum("_pps").alias("b")), "_k").agg(F.sum(F.col("a") * F.col("b"))).first()[0]
        report |= {"compared": int(pairs), "possible": int(every or 0)}
    return asked.select(*keys, id_col, F.col("_ask").alias("_row")).join(_merged(seen, ["_row"], k), "_row", "left").select(*keys, id_col, "near")
