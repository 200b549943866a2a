"""Joins of series: nearest and backward as-of, intervals, nearest cells, overlaps, fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Dimension tables up to this many rows are broadcast, others are shuffled.
SMALL_ROWS = 100_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows (a count that stops there), else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def asof(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str], direction: str = "nearest", tolerance: float | None = None) -> DataFrame:
    """Each left row with the right row of the same key nearest in time (or the last one before): one shuffle of the union, sorted once each way.

    Ties go backward; of equal right times backward takes the last row (by its values), forward the first. Beyond ``tolerance`` values are null.
    """
    row = F.struct(F.col(on).alias("t"), *values)
    l = left.withColumn("_left", F.lit(True)).withColumn("_r", F.lit(None).cast(right.select(row.alias("r")).schema["r"].dataType))
    r = right.select(*by, on, F.lit(False).alias("_left"), row.alias("_r"))
    both = l.unionByName(r, allowMissingColumns=True)
    order = Window.partitionBy(*by).orderBy(F.col(on), F.col("_left"), F.col("_r"))
    back = F.last("_r", True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    # a later right row never has the left row's own time: those sort before it
    behind = Window.partitionBy(*by).orderBy(F.col(on).desc(), F.col("_left").desc(), F.col("_r").desc())
    ahead = F.last("_r", True).over(behind.rowsBetween(Window.unboundedPreceding, -1))
    out = both.withColumn("_b", back)
    if direction == "nearest":
        out = out.withColumn("_f", ahead)
        near = F.when(F.col("_f").isNull() | (F.col(on) - F.col("_b.t") <= F.col("_f.t") - F.col(on)), F.col("_b")).otherwise(F.col("_f"))
        out = out.withColumn("_m", near).drop("_f")
    else:
        out = out.withColumn("_m", F.col("_b"))
    if tolerance is not None:
        out = out.withColumn("_m", F.when(F.abs(F.col(on) - F.col("_m.t")) <= tolerance, F.col("_m")))
    return out.where("_left").select(*left.columns, F.col("_m.t").alias(f"{on}_matched"), *(F.col(f"_m.{v}").alias(v) for v in values))


def forward_fill(df: DataFrame, keys: list[str], time: str, values: list[str], every: int) -> DataFrame:
    """Every step between the first and last row of a key, values carried forward."""
    from .resample import bins

    w = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return bins(df, keys, time, every).join(df.select(*keys, time, *values), [*keys, time], "left").select(*keys, time, *(F.last(v, True).over(w).alias(v) for v in values))


def in_intervals(df: DataFrame, rules: DataFrame, keys: list[str], time: str, start: str, end: str, out: str = "matched") -> DataFrame:
    """Flag rows that lie in any closed interval of their key. Rules are few a key and broadcast when they are few in all; rows don't multiply."""
    spans = rules.groupBy(*keys).agg(F.collect_list(F.struct(F.col(start).alias("s"), F.col(end).alias("e"))).alias("_spans"))
    hit = F.exists("_spans", lambda x: (F.col(time) >= x.s) & (F.col(time) <= x.e))
    return df.join(small(spans), keys, "left").withColumn(out, F.coalesce(hit, F.lit(False))).drop("_spans")


def cell(c: Column | str, res: float) -> Column:
    """Integer key of a coordinate on a grid of spacing ``res`` (half rounds to even)."""
    return F.bround((F.col(c) if isinstance(c, str) else c) / F.lit(res), 0).cast("long")


def nearest_cell(points: DataFrame, cells: DataFrame, id_cols: list[str], res: float, reach: float, values: list[str], default: float | None = None, ties: list[str] = ["clat", "clon"]) -> DataFrame:  # noqa: B006
    """The nearest cell (columns clat, clon, values) of each point (lat, lon) within ``reach`` degrees, by squared distance.

    Both sides meet on coarse cells of size ``reach``: every point is looked up in its nine neighbours, so no pair beyond is formed.
    """
    coarse = lambda c: F.floor(F.col(c) / F.lit(reach)).cast("long")
    around = F.explode(F.expr("flatten(transform(sequence(-1, 1), a -> transform(sequence(-1, 1), b -> struct(a as a, b as b))))"))
    p = points.select(*id_cols, "lat", "lon", around.alias("o")).withColumn("kx", coarse("lat") + F.col("o.a")).withColumn("ky", coarse("lon") + F.col("o.b")).drop("o")
    c = cells.select("clat", "clon", *values, coarse("clat").alias("kx"), coarse("clon").alias("ky"))
    d = F.pow(F.col("lat") - F.col("clat"), 2) + F.pow(F.col("lon") - F.col("clon"), 2)
    near = p.join(c, ["kx", "ky"]).withColumn("d2", F.round(d, 9)).where(F.col("d2") <= round(reach * reach, 9))
    best = near.groupBy(*id_cols).agg(F.min_by(F.struct("clat", "clon", "d2", *values), F.struct("d2", *ties)).alias("b"))
    out = points.join(best, id_cols, "left")
    return out.select(*points.columns, F.col("b.clat").alias("clat"), F.col("b.clon").alias("clon"), F.col("b.d2").alias("d2"), *(F.coalesce(F.col(f"b.{v}"), F.lit(default)).alias(v) for v in values))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres (radius 6371)."""
    r = F.radians
    a = F.pow(F.sin(r(lat2 - lat1) / 2), 2) + F.cos(r(lat1)) * F.cos(r(lat2)) * F.pow(F.sin(r(lon2 - lon1) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def stations_within(a: DataFrame, b: DataFrame, km: float) -> DataFrame:
    """Pairs (id_a, id_b, km) of stations (columns id, lat, lon) at most ``km`` apart. They meet on latitude bands and, inside a band, on
    longitude cells as wide as ``km`` is at the band's end nearer to a pole, wrapped at 180 degrees, so only neighbours are compared."""
    deg = km / 111.0
    band = lambda c: F.floor(F.col(c) / F.lit(deg)).cast("long")
    # cells of a band: as many as fit around it, one at the poles
    cells = F.greatest(F.lit(1), F.floor(F.lit(360 / deg) * F.cos(F.radians(F.least(F.lit(90.0), (F.abs(F.col("k") + 0.5) + 0.5) * deg))))).cast("long")
    place = lambda c: F.least(F.floor(F.pmod(F.col(c) + 180, F.lit(360.0)) / 360 * F.col("_n")).cast("long"), F.col("_n") - 1)
    left = a.select(F.col("id").alias("id_a"), F.col("lat").alias("la"), F.col("lon").alias("lo")).withColumn("k", F.explode(F.array(band("la") - 1, band("la"), band("la") + 1))).withColumn("_n", cells)
    left = left.withColumn("c", F.explode(F.array_distinct(F.array(*(F.pmod(place("lo") + i, F.col("_n")) for i in (-1, 0, 1)))))).drop("_n")
    right = b.select(F.col("id").alias("id_b"), F.col("lat").alias("lb"), F.col("lon").alias("lob")).withColumn("k", band("lb")).withColumn("_n", cells).withColumn("c", place("lob")).drop("_n")
    d = haversine(F.col("la"), F.col("lo"), F.col("lb"), F.col("lob"))
    return left.join(right, ["k", "c"]).where(F.abs(F.col("la") - F.col("lb")) <= deg).withColumn("km", F.round(d, 4)).where(F.col("km") <= km).select("id_a", "id_b", "km")


def ring_search(points: DataFrame, cells: DataFrame, id_cols: list[str], radius: int, value: str) -> DataFrame:
    """First valid cell (row, col, value not null) around each point (row, col): ring by ring, row-major inside a ring."""
    offsets = [(max(abs(y), abs(x)), y, x) for y in range(-radius, radius + 1) for x in range(-radius, radius + 1)]
    table = F.array(*(F.struct(F.lit(r).alias("ring"), F.lit(y).alias("dy"), F.lit(x).alias("dx")) for r, y, x in sorted(offsets)))
    p = points.withColumn("o", F.explode(table)).withColumn("_row", F.col("row") + F.col("o.dy")).withColumn("_col", F.col("col") + F.col("o.dx"))
    c = cells.where(F.col(value).isNotNull()).select(F.col("row").alias("_row"), F.col("col").alias("_col"), value)
    best = p.join(c, ["_row", "_col"]).groupBy(*id_cols).agg(F.min_by(F.struct(value, "o.ring"), "o").alias("b"))
    return points.join(best, id_cols, "left").select(*points.columns, F.col(f"b.{value}").alias(value), F.col("b.ring").alias("ring"))


def fallback(sources: list[DataFrame], keys: list[str], value: str) -> DataFrame:
    """The first source in order that has a value for a key."""
    union = None
    for i, s in enumerate(sources):
        part = s.where(F.col(value).isNotNull()).select(*keys, value, F.lit(i).alias("source"))
        union = part if union is None else union.unionByName(part)
    return union.groupBy(*keys).agg(F.min_by(F.struct("source", value), F.struct("source", value)).alias("b")).select(*keys, "b.source", f"b.{value}")


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Counts of keys on both sides, on one side only, and of values that differ by ``tolerance`` or more (two nulls agree)."""
    x, y = a.select(*keys, F.col(value).alias("_a"), F.lit(1).alias("_ia")), b.select(*keys, F.col(value).alias("_b"), F.lit(1).alias("_ib"))
    both = x.join(y, keys, "full")
    same = F.coalesce(F.abs(F.col("_a") - F.col("_b")) < tolerance, F.col("_a").isNull() & F.col("_b").isNull())
    inner = F.col("_ia").isNotNull() & F.col("_ib").isNotNull()
    return both.agg(F.count_if(inner).alias("n_both"), F.count_if(F.col("_ib").isNull()).alias("n_only_a"), F.count_if(F.col("_ia").isNull()).alias("n_only_b"), F.count_if(inner & ~same).alias("n_differ"))


def nearest_grid_point(points: DataFrame, lats: tuple[float, float, int], lons: tuple[float, float, int]) -> DataFrame:
    """Index and coordinates of the nearest point of a regular grid (first, step, count) for points (lat, lon); a grid of 0..360 is met by
    wrapping the longitude. Halfway takes the lower index; points beyond an edge take the edge."""

    def nearest(c: Column, first: float, step: float, n: int) -> Column:
        i = F.ceil((c - first) / step - 0.5)
        return F.least(F.greatest(i, F.lit(0)), F.lit(n - 1)).cast("long")

    lon = F.pmod(F.col("lon"), F.lit(360.0)) if lons[0] >= 0 else F.col("lon")
    out = points.withColumn("i", nearest(F.col("lat"), *lats)).withColumn("j", nearest(lon, *lons))
    return out.withColumn("glat", lats[0] + F.col("i") * lats[1]).withColumn("glon", lons[0] + F.col("j") * lons[1])


def destination(lat: Column, lon: Column, bearing: Column, km: Column) -> tuple[Column, Column]:
    """Point at a distance and bearing (degrees) on a sphere of radius 6371 km."""
    d, b, phi = km / 6371.0, F.radians(bearing), F.radians(lat)
    lat2 = F.asin(F.sin(phi) * F.cos(d) + F.cos(phi) * F.sin(d) * F.cos(b))
    lon2 = F.radians(lon) + F.atan2(F.sin(b) * F.sin(d) * F.cos(phi), F.cos(d) - F.sin(phi) * F.sin(lat2))
    return F.degrees(lat2), F.degrees(lon2)


def bearing_search(points: DataFrame, cells: DataFrame, id_cols: list[str], res: float, radii: tuple[float, ...], bearings: int, value: str) -> DataFrame:
    """First valid cell (clat, clon, value) met on circles of growing radius (km), bearing by bearing; radius 0 is the point itself.
    Cells are found by their integer keys on a grid of spacing ``res``."""
    steps = [(0, 0.0, 0.0)] + [(k * bearings + b + 1, r, 360.0 * b / bearings) for k, r in enumerate(radii) for b in range(bearings)]
    table = F.array(*(F.struct(F.lit(o).alias("order"), F.lit(r).alias("km"), F.lit(b).alias("bearing")) for o, r, b in steps))
    p = points.withColumn("o", F.explode(table))
    la, lo = destination(F.col("lat"), F.col("lon"), F.col("o.bearing"), F.col("o.km"))
    p = p.withColumn("_x", cell(la, res)).withColumn("_y", cell(lo, res))
    c = cells.where(F.col(value).isNotNull()).select(cell("clat", res).alias("_x"), cell("clon", res).alias("_y"), value)
    best = p.join(c, ["_x", "_y"]).groupBy(*id_cols).agg(F.min_by(F.struct(value, F.col("o.km").alias("km")), F.struct("o.order", value)).alias("b"))
    return points.join(best, id_cols, "left").select(*points.columns, F.col(f"b.{value}").alias(value), F.col("b.km").alias("km"))
