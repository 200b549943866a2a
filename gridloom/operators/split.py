"""Training splits: spatial groups, folds, temporal and gauged splits, scaling by fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import dense_ranks, row_numbers


def grid_groups(sites: DataFrame, size: float) -> DataFrame:
    """Dense group numbers of sites (lat, lon) on cells of ``size`` degrees counted from the southernmost, westernmost site."""
    low = sites.agg(F.min("lat").alias("_a"), F.min("lon").alias("_o"))
    cells = sites.join(F.broadcast(low)).withColumn("_r", F.floor((F.col("lat") - F.col("_a")) / size)).withColumn("_c", F.floor((F.col("lon") - F.col("_o")) / size))
    return dense_ranks(cells, ["_r", "_c"], "grp").drop("_r", "_c", "_a", "_o")


def balanced_folds(groups: DataFrame, group: str, weight: str, folds: int) -> DataFrame:
    """(group, fold): groups by falling weight, each to the lightest fold. The table holds a row a group (hundreds), which go to the driver."""
    rows = sorted(((r[weight], r[group]) for r in groups.groupBy(group).agg(F.sum(weight).alias(weight)).collect()), key=lambda x: (-x[0], x[1]))
    load, out = [0] * folds, []
    for w, g in rows:
        f = min(range(folds), key=lambda k: (load[k], k))
        load[f] += w
        out.append((g, f))
    return groups.sparkSession.createDataFrame(out, f"`{group}` {groups.schema[group].dataType.simpleString()}, fold int")


def stratified_folds(rows: DataFrame, group: str, label: str, folds: int) -> DataFrame:
    """(group, fold): groups of the rarest labels first, each to the fold with the fewest rows of its main label, then the fewest rows."""
    counts: dict = {}
    for r in rows.groupBy(group, label).count().collect():  # groups x labels
        counts.setdefault(r[group], {})[r[label]] = r["count"]
    totals: dict = {}
    for c in counts.values():
        for k, n in c.items():
            totals[k] = totals.get(k, 0) + n
    main = {g: min(c, key=lambda k: (-c[k], str(k))) for g, c in counts.items()}
    have, load, out = [dict() for _ in range(folds)], [0] * folds, []
    for g in sorted(counts, key=lambda g: (totals[main[g]], -sum(counts[g].values()), str(g))):
        f = min(range(folds), key=lambda k: (have[k].get(main[g], 0), load[k], k))
        have[f][main[g]] = have[f].get(main[g], 0) + counts[g][main[g]]
        load[f] += sum(counts[g].values())
        out.append((g, f))
    return rows.sparkSession.createDataFrame(out, f"`{group}` {rows.schema[group].dataType.simpleString()}, fold int")


def temporal_split(df: DataFrame, keys: list[str], order: list[str], train: float, valid: float) -> DataFrame:
    """train, valid or test by place in the time order of each series."""
    p = F.percent_rank().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("part", F.when(p < train, "train").when(p < train + valid, "valid").otherwise("test"))


def expanding_folds(df: DataFrame, keys: list[str], order: list[str], folds: int) -> DataFrame:
    """Adds ``slice``: fold k trains on slices below k and tests on slice k."""
    return df.withColumn("slice", F.ntile(folds + 1).over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def class_split(ids: DataFrame, id_col: str, label: str | None, shares: dict[str, float], order: Column) -> DataFrame:
    """Ids dealt to named parts by their shares, within each label if one is named, in a fixed order; ids don't repeat."""
    ranked = row_numbers(ids.withColumn("_order", order), [label] if label else [], ["_order", id_col], "_row")
    ids = ranked.withColumn("_p", F.when(F.col("_n") > 1, (F.col("_row") - 1) / (F.col("_n") - 1)).otherwise(0.0)).drop("_order", "_row", "_n")
    p, at, out = F.col("_p"), 0.0, None
    for name, share in shares.items():
        at += share
        out = F.when(p < at, name) if out is None else out.when(p < at, name)
    return ids.withColumn("part", out.otherwise(list(shares)[-1])).drop("_p")


def block_folds(sites: DataFrame, size: float, folds: int) -> DataFrame:
    """Checker-like spatial blocks: the fold follows from the block's row and column, so neighbouring blocks differ."""
    r, c = F.floor((F.col("lat") + 90) / size), F.floor((F.col("lon") + 180) / size)
    return sites.withColumn("fold", F.pmod(r + 2 * c, F.lit(folds)).cast("int"))


def buffered_training(sites: DataFrame, fold: int, size: float) -> DataFrame:
    """Training sites of a fold: those of other folds whose block doesn't touch a test block."""
    key = sites.withColumn("_r", F.floor((F.col("lat") + 90) / size)).withColumn("_c", F.floor((F.col("lon") + 180) / size))
    near = F.explode(F.expr("flatten(transform(sequence(-1, 1), a -> transform(sequence(-1, 1), b -> struct(a as a, b as b))))"))
    test = key.where(F.col("fold") == fold).select("_r", "_c").distinct().withColumn("_o", near)
    around = test.select((F.col("_r") + F.col("_o.a")).alias("_r"), (F.col("_c") + F.col("_o.b")).alias("_c")).distinct()
    return key.where(F.col("fold") != fold).join(around, ["_r", "_c"], "left_anti").drop("_r", "_c")


def standardise_by_fold(df: DataFrame, fold: str, k: int, columns: list[str]) -> DataFrame:
    """Columns scaled with the mean and population deviation of the rows outside fold ``k``; one row of statistics is broadcast."""
    stats = df.where(F.col(fold) != k).agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    out = df.crossJoin(F.broadcast(stats))
    for c in columns:
        out = out.withColumn(c, F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0))
    return out.select(*df.columns)
