"""Polygons on a regular grid: cells inside and touched, and resampling by shares of area.

A grid is (west, south, size): cell (row, col) spans [west + col size, west + (col + 1) size) and [south + row size, ...). Polygons are edge
tables: a polygon's rings, holes too, are closed edges, and what lies inside is what an odd number of edges is to the right of. Edges are
dealt out to the grid rows they meet, so a polygon of any size spreads over its rows, and no task holds a whole one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Grid = tuple[float, float, float]


def edges(polygons: DataFrame, keys: list[str], rings: str) -> DataFrame:
    """keys, x1, y1, x2, y2 of the edges of ``rings`` (arrays of points with x and y); rings close themselves, edges without length go."""
    ring = polygons.select(*keys, F.explode(rings).alias("_ring")).where(F.size("_ring") > 2)
    pairs = F.zip_with("_ring", F.concat(F.slice("_ring", F.lit(2), F.size("_ring") - 1), F.slice("_ring", 1, 1)), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
    return ring.select(*keys, F.explode(pairs).alias("_e")).select(*keys, "_e.*").where("x1 <> x2 or y1 <> y2")


def _cell(v: Column, start: float, size: float) -> Column:
    return F.floor((v - start) / size).cast("long")


def cells_inside(edge: DataFrame, keys: list[str], grid: Grid) -> DataFrame:
    """keys, row, col of the cells whose centre is inside: in each row the crossings with its centre line, in order, open and close spans."""
    west, south, size = grid
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    # centre lines with low <= line < high
    first, last = F.ceil((low - south) / size - 0.5).cast("long"), (F.ceil((high - south) / size - 0.5) - 1).cast("long")
    rows = edge.withColumn("_a", first).withColumn("_b", last).where("_a <= _b").withColumn("row", F.explode(F.sequence("_a", "_b")))
    line = F.lit(south) + (F.col("row") + 0.5) * size
    crossing = rows.select(*keys, "row", (F.col("x1") + (line - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))).alias("_x"))
    w = Window.partitionBy(*keys, "row").orderBy("_x")
    spans = crossing.withColumn("_k", F.row_number().over(w)).withColumn("_to", F.lead("_x").over(w)).where("_k % 2 = 1")
    # centres with x <= centre < to
    a, b = F.ceil((F.col("_x") - west) / size - 0.5).cast("long"), (F.ceil((F.col("_to") - west) / size - 0.5) - 1).cast("long")
    return spans.withColumn("_a", a).withColumn("_b", b).where("_a <= _b").select(*keys, "row", F.explode(F.sequence("_a", "_b")).alias("col"))


def cells_crossed(edge: DataFrame, keys: list[str], grid: Grid) -> DataFrame:
    """keys, row, col of the cells that an edge runs through or ends in; a cell counts its lower and left sides as its own."""
    west, south, size = grid
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = edge.withColumn("row", F.explode(F.sequence(_cell(low, south, size), _cell(high, south, size))))
    bottom = F.lit(south) + F.col("row") * size
    flat = F.col("y1") == F.col("y2")
    at = lambda y: F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    xa = F.when(flat, F.col("x1")).otherwise(at(F.greatest(bottom, low)))
    xb = F.when(flat, F.col("x2")).otherwise(at(F.least(bottom + size, high)))
    rows = rows.withColumn("_xa", F.least(xa, xb)).withColumn("_xb", F.greatest(xa, xb))
    return rows.select(*keys, "row", F.explode(F.sequence(_cell(F.col("_xa"), west, size), _cell(F.col("_xb"), west, size))).alias("col")).distinct()


def cells_touched(edge: DataFrame, keys: list[str], grid: Grid) -> DataFrame:
    """keys, row, col of the cells that share a point with a polygon: those crossed by an edge, and those inside."""
    return cells_inside(edge, keys, grid).unionByName(cells_crossed(edge, keys, grid)).distinct()


def mask_cells(cells: DataFrame, edge: DataFrame, keys: list[str], grid: Grid, x: str, y: str, touched: bool = True) -> DataFrame:
    """Rows of a cell table (centres x, y) that lie in a cell touched by any polygon (``touched=False``: with its centre inside one)."""
    west, south, size = grid
    own = (cells_touched if touched else cells_inside)(edge, keys, grid).select("row", "col").distinct()
    placed = cells.withColumn("_row", _cell(F.col(y), south, size)).withColumn("_col", _cell(F.col(x), west, size))
    return placed.join(own.select(F.col("row").alias("_row"), F.col("col").alias("_col")), ["_row", "_col"], "left_semi").drop("_row", "_col")


def majority_by_area(cells: DataFrame, code: str, row: str, col: str, source: Grid, target: Grid) -> DataFrame:
    """row, col, code and share of the cells of the target grid: the code that covers most of what is known of it (the smallest on ties), and its
    share of that area. Each source cell is dealt to the target cells it overlaps, with the area they share."""
    (w0, s0, a), (w1, s1, b) = source, target
    left, low = F.lit(w0) + F.col(col) * a, F.lit(s0) + F.col(row) * a
    spread = lambda start, origin: F.sequence(_cell(start, origin, b), F.greatest(_cell(start, origin, b), (F.ceil((start + a - origin) / b - 1e-9) - 1).cast("long")))
    dealt = cells.where(F.col(code).isNotNull()).select(F.col(code).alias("code"), left.alias("_x"), low.alias("_y"))
    dealt = dealt.withColumn("row", F.explode(spread(F.col("_y"), s1))).withColumn("col", F.explode(spread(F.col("_x"), w1)))
    shared = lambda start, k, origin: F.least(start + a, F.lit(origin) + (F.col(k) + 1) * b) - F.greatest(start, F.lit(origin) + F.col(k) * b)
    area = dealt.withColumn("_area", shared(F.col("_x"), "col", w1) * shared(F.col("_y"), "row", s1)).where("_area > 0")
    sums = area.groupBy("row", "col", "code").agg(F.sum("_area").alias("_area"))
    ranked = sums.withColumn("_r", F.dense_rank().over(Window.partitionBy("row", "col").orderBy(F.desc(F.round("_area", 9)), "code"))).withColumn("_all", F.sum("_area").over(Window.partitionBy("row", "col")))
    return ranked.where("_r = 1").select("row", "col", "code", (F.col("_area") / F.col("_all")).alias("share"))
