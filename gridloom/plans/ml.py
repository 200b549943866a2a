"""Models on Spark ML: tree regressors over folds, out-of-fold predictions, forward selection, batch scoring, k-means groups."""

from __future__ import annotations

import itertools
import json
import math
import random
from multiprocessing.pool import ThreadPool

from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from gridloom.operators import skill
from gridloom.sources.shared import kept

#: Different vectors of features up to which trees are fitted on sums by vector rather than on rows.
VECTORS = 200_000
#: Trees of a forest that are fitted at a time.
AT_ONCE = 4
#: Settings that mean the same for sums by vector as for rows.
_BY_VECTOR = {"numTrees", "maxDepth", "maxBins", "featureSubsetStrategy", "maxIter", "stepSize"}


def regressor(kind: str, label: str, seed: int = 42, **params):
    """A random forest or boosted trees with a fixed seed."""
    make = {"forest": RandomForestRegressor, "boosted": GBTRegressor}[kind]
    return make(labelCol=label, featuresCol="features", seed=seed, **params)


def _complete(features: list[str]) -> Column:
    complete = F.lit(True)
    for c in features:
        complete = complete & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return complete


def _drawn(h: Column) -> Column:
    """How often a row with this 64-bit hash is drawn: a Poisson number of mean 1."""
    out, below = None, 0.0
    for k in range(16):
        below += math.exp(-1) / math.factorial(k)
        least = h < F.lit(min(int((below - 0.5) * 2**64), 2**63 - 1))
        out = F.when(least, k) if out is None else out.when(least, k)
    return out.otherwise(16)


def by_vector(df: DataFrame, features: list[str], label: str, by: list[str], draws: int) -> DataFrame:
    """``by``, features, ``_n`` rows, their mean ``_y`` and variance ``_v`` of the label, and for each bootstrap sample t the rows drawn ``_w{t}``
    and the sum ``_s{t}`` of their labels: all that trees of least squares see of rows with equal features.

    A row is drawn by a hash of its columns, so samples don't depend on how rows are dealt out; rows equal in all columns are drawn together."""
    rows = df.where(F.col(label).isNotNull() & _complete(features)).select(*by, *features, F.col(label).cast("double").alias("_y"), F.xxhash64(*df.columns).alias("_h"))
    rows = rows.select(*by, *features, "_y", *(_drawn(F.xxhash64("_h", F.lit(t))).alias(f"_w{t}") for t in range(draws)))
    drawn = [c for t in range(draws) for c in (F.sum(f"_w{t}").alias(f"_w{t}"), F.sum(F.col(f"_w{t}") * F.col("_y")).alias(f"_s{t}"))]
    return rows.groupBy(*by, *features).agg(F.count(F.lit(1)).alias("_n"), F.avg("_y").alias("_y"), F.var_pop("_y").alias("_v"), *drawn)


def _merged(sums: DataFrame, features: list[str], draws: int) -> DataFrame:
    """Sums by vector over all of ``by``, without the variance."""
    drawn = [F.sum(f"_{c}{t}").alias(f"_{c}{t}") for t in range(draws) for c in "ws"]
    return sums.groupBy(*features).agg(F.sum("_n").alias("_n"), (F.sum(F.col("_n") * F.col("_y")) / F.sum("_n")).alias("_y"), *drawn)


def _trees(kind: str, params: dict) -> int:
    """Bootstrap samples that a setting needs."""
    return params.get("numTrees", 20) if kind == "forest" else 0


def _few_vectors(df: DataFrame, features: list[str], settings: list[dict]) -> bool:
    """Whether all settings can be fitted on sums by vector, and those are few."""
    return all(set(s) <= _BY_VECTOR for s in settings) and df.select(F.approx_count_distinct(F.struct(*features))).first()[0] <= VECTORS


def _fit_sums(sums: DataFrame, features: list[str], kind: str, made: dict, **params) -> PipelineModel:
    """A model from sums by vector. A forest is the mean of trees fitted one by one, each on its bootstrap sample; ``made`` keeps trees, which
    forests of other sizes share."""
    stages = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip")

    def tree(kind: str, y: Column, w: Column, **own):
        rows = sums.where(w > 0).select(*features, y.alias("_y"), w.cast("double").alias("_w"))
        return regressor(kind, "_y", weightCol="_w", **own).fit(stages.transform(rows))

    if kind == "boosted":
        return PipelineModel([stages, tree(kind, F.col("_y"), F.col("_n"), **params)])
    n = _trees(kind, params)
    own = {c: v for c, v in params.items() if c != "numTrees"}
    if own.get("featureSubsetStrategy", "auto") == "auto":
        own["featureSubsetStrategy"] = "onethird" if n > 1 else "all"
    keys = [(t, *sorted(own.items())) for t in range(n)]
    wanted = [t for t in range(n) if keys[t] not in made]
    drawn = sums.agg(*(F.sum(f"_w{t}") for t in wanted)).first() if wanted else ()

    def grown(t: int, rows: int):
        # a sample of so few rows that none was drawn is all of them
        y, w = (F.col(f"_s{t}") / F.col(f"_w{t}"), F.col(f"_w{t}")) if rows else (F.col("_y"), F.col("_n"))
        return tree(kind, y, w, numTrees=1, bootstrap=False, seed=42 + t, **own)

    with ThreadPool(AT_ONCE) as pool:
        made |= zip((keys[t] for t in wanted), pool.starmap(inheritable_thread_target(sums.sparkSession)(grown), zip(wanted, drawn)))
    parts = [made[keys[t]].copy().setPredictionCol(f"_tree{t}") for t in range(n)]
    names = [f"_tree{t}" for t in range(n)]
    mean = SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(names)}), ({' + '.join(names)}) / {n} AS prediction FROM __THIS__")
    return PipelineModel([stages, *parts, mean])


def _fit_rows(df: DataFrame, features: list[str], label: str, kind: str, **params) -> PipelineModel:
    stages = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip")
    return PipelineModel([stages, regressor(kind, label, **params).fit(stages.transform(df.where(F.col(label).isNotNull())))])


def fit(df: DataFrame, features: list[str], label: str, kind: str = "forest", **params) -> PipelineModel:
    """A model of the rows with a label and all features. Where few vectors of features differ (``VECTORS``), the rows are read once into sums by
    vector, from which the trees grow as they would from the rows."""
    if not _few_vectors(df, features, [params]):
        return _fit_rows(df, features, label, kind, **params)
    return _fit_sums(kept(by_vector(df, features, label, [], _trees(kind, params)), "by-vector"), features, kind, {}, **params)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` with a prediction; rows that lack a feature stay, with a null prediction."""
    every = PipelineModel([model.stages[0].copy().setHandleInvalid("keep"), *model.stages[1:]])
    return every.transform(df).drop("features").withColumn("prediction", F.when(_complete(model.stages[0].getInputCols()), F.col("prediction")))


def out_of_fold(df: DataFrame, features: list[str], label: str, fold: str, folds: int, kind: str = "forest", **params) -> DataFrame:
    """Every row predicted by the model that did not see its fold."""
    out = None
    for k in range(folds):
        part = predict(fit(df.where(F.col(fold) != k), features, label, kind, **params), df.where(F.col(fold) == k))
        out = part if out is None else out.unionByName(part)
    return out


def _fold_errors(df: DataFrame, features: list[str], label: str, fold: str, folds: int, kind: str, settings: list[dict]) -> list[list[float]]:
    """Root mean square errors of the folds by models that did not see them, for each setting; sums by vector and fold are made once for all."""
    if not _few_vectors(df, features, settings):
        rmse = RegressionEvaluator(labelCol=label, metricName="rmse")
        return [[rmse.evaluate(_fit_rows(df.where(F.col(fold) != k), features, label, kind, **s).transform(df.where(F.col(fold) == k))) for k in range(folds)] for s in settings]
    draws = max((_trees(kind, s) for s in settings), default=0)
    sums = kept(by_vector(df, features, label, [fold], draws), "by-vector")
    errors: list[list[float]] = [[] for _ in settings]
    for k in range(folds):
        seen, made = kept(_merged(sums.where(F.col(fold) != k), features, draws), "seen"), {}
        for s, own in zip(settings, errors):
            held = _fit_sums(seen, features, kind, made, **s).transform(sums.where(F.col(fold) == k))
            off = F.col("_y") - F.col("prediction")
            mean = held.agg(F.sum(F.col("_n") * (off * off + F.col("_v"))) / F.sum("_n")).first()[0]
            own.append(float("nan") if mean is None else mean**0.5)
    return errors


def fold_errors(df: DataFrame, features: list[str], label: str, fold: str, folds: int, kind: str = "forest", **params) -> list[float]:
    """Root mean square error of each fold by a model that did not see it."""
    return _fold_errors(df, features, label, fold, folds, kind, [params])[0]


def search(df: DataFrame, features: list[str], label: str, fold: str, folds: int, space: dict[str, list] | list[dict], kind: str = "forest", draws: int | None = None, seed: int = 42) -> list[dict]:
    """The settings tried, best first: each with kind, params, the mean and deviation of its fold errors, and rank.

    All combinations of ``space`` (or the settings of a list), or ``draws`` different ones drawn at random with a fixed seed. Equal errors keep
    the order of the space. Rows without the label are not used.
    """
    settings = list(space) if isinstance(space, list) else [dict(zip(space, v)) for v in itertools.product(*space.values())]
    if draws is not None and draws < len(settings):
        settings = [settings[i] for i in sorted(random.Random(seed).sample(range(len(settings)), draws))]
    tried = []
    for params, e in zip(settings, _fold_errors(df, features, label, fold, folds, kind, settings)):
        tried.append({"kind": kind, "params": params, "error": sum(e) / len(e), "deviation": (sum((x - sum(e) / len(e)) ** 2 for x in e) / len(e)) ** 0.5})
    tried.sort(key=lambda r: r["error"])
    return [r | {"rank": i + 1} for i, r in enumerate(tried)]


def search_table(spark: SparkSession, tried: list[dict]) -> DataFrame:
    """kind, rank, params (as JSON), error and deviation of the settings tried."""
    return spark.createDataFrame([(r["kind"], r["rank"], json.dumps(r["params"], sort_keys=True), float(r["error"]), float(r["deviation"])) for r in tried], "kind string, rank int, params string, error double, deviation double")


def grid_search(df: DataFrame, features: list[str], label: str, fold: str, folds: int, grid: list[dict], kind: str = "forest") -> tuple[PipelineModel, dict, float]:
    """The setting of the least mean fold error, refitted on all rows."""
    best = search(df, features, label, fold, folds, grid, kind)[0]
    return fit(df, features, label, kind, **best["params"]), best["params"], best["error"]


def forward_selection(df: DataFrame, groups: dict[str, list[str]], fixed: list[str], label: str, fold: str, folds: int, **params) -> list[tuple[str, float]]:
    """Feature groups in the order in which each lowers the pooled error most, until none does; the candidates are a handful of names."""
    chosen, left, steps, best = list(fixed), dict(groups), [], float("inf")
    while left:
        tried = []
        for name, cols in left.items():
            p = skill.pooled(skill.error_sums(out_of_fold(df, chosen + cols, label, fold, folds, **params).withColumn("k", F.lit(1)), ["k"], label, "prediction"), ["k"]).first()["rmse"]
            tried.append((p, name))
        score, name = min(tried)
        if score >= best:
            break
        best = score
        chosen += left.pop(name)
        steps.append((name, score))
    return steps


def score(df: DataFrame, models: dict[str, PipelineModel], key: list[str]) -> DataFrame:
    """One column a model and their median, rows identified by their key throughout."""
    out = df
    for name, m in models.items():
        out = predict(m, out).withColumnRenamed("prediction", name)
    return out.select(*key, *models, skill.median_of(list(models)).alias("ensemble"))


def kmeans_groups(sites: DataFrame, k: int) -> DataFrame:
    """Sites grouped by k-means on standardised coordinates."""
    v = VectorAssembler(inputCols=["lat", "lon"], outputCol="raw").transform(sites)
    s = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(v).transform(v)
    return KMeans(k=k, seed=42).fit(s).transform(s).drop("raw", "features").withColumnRenamed("prediction", "grp")
