"""Learning with no look ahead: rolling windows, fitted transforms, gates, clusters, neighbours, fusion."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, FMClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.vectors import cosine, dot, softmax


@dataclass(frozen=True)
class Fold:
    fit: tuple[int, ...]
    validate: tuple[int, ...]
    test: tuple[int, ...]


def rolling_windows(periods: Sequence[int], fit: int = 6, validate: int = 2, test: int = 1) -> list[Fold]:
    """Consecutive windows that never overlap in time and step by one period."""
    periods = sorted(set(periods))
    size = fit + validate + test
    return [Fold(tuple(periods[i : i + fit]), tuple(periods[i + fit : i + fit + validate]), tuple(periods[i + fit + validate : i + size])) for i in range(len(periods) - size + 1)]


def split(df: DataFrame, period: str, fold: Fold) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(df.where(F.col(period).isin(*part)) for part in (fold.fit, fold.validate, fold.test))


def as_vector(df: DataFrame, array: str, name: str = "features") -> DataFrame:
    return df.withColumn(name, array_to_vector(F.col(array).cast("array<double>")))


def reducer(size: int, features: str = "features", name: str = "reduced", scaled: bool = False) -> Pipeline:
    """Centring, principal components, and (``scaled``) unit deviations, all fitted on the same rows."""
    steps = [StandardScaler(inputCol=features, outputCol="__centred", withMean=True, withStd=False), PCA(k=size, inputCol="__centred", outputCol="__pc" if scaled else name)]
    if scaled:
        steps.append(StandardScaler(inputCol="__pc", outputCol=name, withMean=True, withStd=True))
    return Pipeline(stages=steps)


def ridge(df: DataFrame, alpha: float, features: str = "features", label: str = "label") -> LinearRegression:
    """Least squares with the penalty alpha |w|^2 on the sum of squares, intercept free: Spark's own scale is undone."""
    row = df.agg(F.count(label).alias("n"), F.stddev_pop(label).alias("s")).first()
    return LinearRegression(featuresCol=features, labelCol=label, regParam=alpha * (row["s"] or 0.0) / max(row["n"], 1), elasticNetParam=0.0, standardization=False, solver="normal")


def choose(fit: DataFrame, check: DataFrame, grid: Sequence[float], make: Callable[[DataFrame, float], object], score: Callable[[DataFrame], float], expand: float = 10.0, most: int = 3) -> tuple[float, float]:
    """The setting with the best score on ``check``; while the best is the largest, the grid grows by ``expand``."""
    grid, tried = list(grid), {}
    for _ in range(most):
        for g in grid:
            if g not in tried:
                tried[g] = score(make(fit, g).fit(fit).transform(check))
        best = max(tried, key=lambda g: (tried[g], -g))
        if best < max(tried):
            break
        grid = [max(tried) * expand]
    return best, tried[best]


CLASSIFIERS: dict[str, Callable[..., object]] = {
    "logistic": lambda **k: LogisticRegression(**({"maxIter": 100} | k)),
    "l1_logistic": lambda **k: LogisticRegression(**({"maxIter": 100, "elasticNetParam": 1.0, "regParam": 0.01} | k)),
    "linear_svm": lambda **k: LinearSVC(**({"maxIter": 50} | k)),
    "ridge_logistic": lambda **k: LogisticRegression(**({"maxIter": 100, "regParam": 0.1} | k)),
    "elastic_logistic": lambda **k: LogisticRegression(**({"maxIter": 100, "elasticNetParam": 0.5, "regParam": 0.01} | k)),
    "naive_bayes": lambda **k: NaiveBayes(**({"modelType": "gaussian"} | k)),
    # of counts: features of 0 and more (bernoulli: 0 and 1)
    "multinomial_bayes": lambda **k: NaiveBayes(**({"modelType": "multinomial"} | k)),
    "complement_bayes": lambda **k: NaiveBayes(**({"modelType": "complement"} | k)),
    "bernoulli_bayes": lambda **k: NaiveBayes(**({"modelType": "bernoulli"} | k)),
    "tree": lambda **k: DecisionTreeClassifier(**({"maxDepth": 5, "seed": 7} | k)),
    # single trees that each see one feature in three of a split
    "extra_forest": lambda **k: RandomForestClassifier(**({"numTrees": 100, "featureSubsetStrategy": "onethird", "bootstrap": False, "seed": 7} | k)),
    "forest": lambda **k: RandomForestClassifier(**({"numTrees": 50, "seed": 7} | k)),
    "boosting": lambda **k: GBTClassifier(**({"maxIter": 30, "seed": 7} | k)),
    "factorisation": lambda **k: FMClassifier(**({"maxIter": 50, "seed": 7} | k)),
    "mlp": lambda **k: MultilayerPerceptronClassifier(**({"maxIter": 100, "seed": 7} | k)),
}
REGRESSORS: dict[str, Callable[..., object]] = {
    "ols": lambda **k: LinearRegression(**k),
    "lasso": lambda **k: LinearRegression(**({"elasticNetParam": 1.0, "regParam": 0.01} | k)),
    "elastic_net": lambda **k: LinearRegression(**({"elasticNetParam": 0.5, "regParam": 0.01} | k)),
    "huber": lambda **k: LinearRegression(**({"loss": "huber"} | k)),
    "forest": lambda **k: RandomForestRegressor(**({"numTrees": 50, "seed": 7} | k)),
    "boosting": lambda **k: GBTRegressor(**({"maxIter": 30, "seed": 7} | k)),
}


def rolling(df: DataFrame, period: str, folds: Sequence[Fold], fit_predict: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """The test predictions of all folds; each fold's model sees its own fit and validation rows only."""
    out = None
    for i, fold in enumerate(folds):
        part = fit_predict(*split(df, period, fold)).withColumn("fold", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


# ---- moments and gates ---------------------------------------------------------------------------------------


def moments(df: DataFrame, by: Sequence[str], vector: str) -> DataFrame:
    """(*by, pos, n, s, ss): counts, sums and sums of squares by dimension, which add over shards and periods."""
    long = df.select(*by, F.posexplode(F.col(vector)).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    return long.groupBy(*by, "pos").agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"))


def fisher(m: DataFrame, label: str, floor: float = 1e-12) -> DataFrame:
    """(pos, fisher): between-class over within-class variance from moments by a label."""
    each = m.groupBy("pos", label).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    w = Window.partitionBy("pos")
    total = F.sum("s").over(w) / F.sum("n").over(w)
    mean = F.col("s") / F.col("n")
    rows = each.select("pos", (F.col("n") * (mean - total) * (mean - total)).alias("between"), (F.col("ss") - F.col("n") * mean * mean).alias("within"))
    return rows.groupBy("pos").agg((F.sum("between") / F.greatest(F.sum("within"), F.lit(floor))).alias("fisher"))


def top_positions(scores: DataFrame, k: int, score: str = "fisher") -> list[int]:
    """The k best positions, ties to the lower one, in rising order; k bounds what comes to the driver."""
    return sorted(r["pos"] for r in scores.orderBy(F.desc(score), "pos").limit(k).select("pos").collect())


def select_positions(vector: Column, positions: Sequence[int]) -> Column:
    return F.array(*[vector[p] for p in positions])


def gated(vector: Column, weights: Sequence[float]) -> Column:
    return F.zip_with(vector, F.array(*[F.lit(float(w)) for w in weights]), lambda x, w: x * w)


def static_gate(scores: Column, temperature: float = 1.0) -> Column:
    return softmax(scores, temperature)


# ---- centroids, clusters, neighbours ---------------------------------------------------------------------------


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, centroid, n): means by dimension, put back in order; the number of labels and dimensions bounds it."""
    m = moments(df, [label], vector)
    return m.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", (F.col("s") / F.col("n")).alias("m")))), lambda z: z["m"]).alias("centroid"), F.max("n").alias("n"))


def soft_assign(df: DataFrame, centres: np.ndarray, vector: str, temperature: float = 1.0, name: str = "posterior") -> DataFrame:
    """Softmax of minus the squared distances to a few fixed centres."""
    far = []
    for c in centres:
        centre = F.array(*[F.lit(float(x)) for x in c])
        far.append(-F.aggregate(F.zip_with(F.col(vector), centre, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    return df.withColumn(name, softmax(F.array(*far), temperature))


def shrunk_cluster_means(df: DataFrame, cluster: str, value: str, strength: float) -> DataFrame:
    """(cluster, mean): each cluster's mean pulled to the overall mean by ``strength`` rows."""
    w = Window.partitionBy()
    each = df.groupBy(cluster).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    overall = F.sum("s").over(w) / F.sum("n").over(w)
    return each.select(cluster, ((F.col("s") + strength * overall) / (F.col("n") + strength)).alias("mean"), "n")


def _blocks(df: DataFrame, key: str, vector: str, size: int, name: str) -> DataFrame:
    """One row for about ``size`` rows: their keys and vectors, dealt by a hash of the key."""
    number = max(1, -(-df.count() // size))
    return df.groupBy(F.pmod(F.xxhash64(key), F.lit(number)).alias("__b")).agg(F.collect_list(F.struct(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))).alias(name)).drop("__b")


def neighbours(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int, block: int = 2000) -> DataFrame:
    """(query, neighbour, similarity, place): exact cosine top k of a stated query set against all rows, in blocks.

    Both sides are packed into blocks of about ``block`` rows; each pair of blocks is one matrix product in some
    task and sends on only k rows for each query.  Neither side is gathered anywhere.
    """
    import pandas as pd
    import pyarrow as pa

    pairs = _blocks(queries, key, vector, block, "q").crossJoin(_blocks(base, key, vector, block, "b"))

    def matrix(cell) -> tuple[np.ndarray, np.ndarray]:
        ids, v = cell.values.field("id").to_numpy(), cell.values.field("v")
        x = v.flatten().to_numpy().reshape(len(ids), -1)
        order = np.argsort(ids, kind="stable")  # of equal neighbours the smaller id comes first
        ids, x = ids[order], x[order]
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return ids, np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)

    def search(batches):
        for batch in batches:
            for left, right in zip(batch.column(0), batch.column(1), strict=True):
                (ids, q), (own, x) = matrix(left), matrix(right)
                s = q @ x.T
                s[ids[:, None] == own[None, :]] = -np.inf
                at = np.argsort(-np.round(s, 9), axis=1, kind="stable")[:, :k]
                frame = pd.DataFrame({"query": np.repeat(ids, at.shape[1]), "neighbour": own[at].ravel(), "similarity": np.take_along_axis(s, at, 1).ravel()})
                yield pa.RecordBatch.from_pandas(frame[np.isfinite(frame["similarity"])], preserve_index=False)

    near = pairs.select("q", "b").mapInArrow(search, "query bigint, neighbour bigint, similarity double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("similarity", 9)), "neighbour"))
    return near.withColumn("place", place).where(F.col("place") <= k)


def neighbour_vote(found: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """(query, label, share): the share of each label among a query's neighbours."""
    rows = found.join(labels.select(F.col(key).alias("neighbour"), label), "neighbour")
    votes = rows.groupBy("query", label).agg(F.count(F.lit(1)).alias("votes"))
    return votes.withColumn("share", F.col("votes") / F.sum("votes").over(Window.partitionBy("query"))).drop("votes")


# ---- fusion ------------------------------------------------------------------------------------------------------


def fuse(df: DataFrame, models: Sequence[str], weights: Sequence[float] | None = None) -> Column:
    """The weighted mean of standardised models; equal weights by default; missing models count 0."""
    weights = list(weights or [1.0] * len(models))
    total = F.lit(0.0)
    for m, w in zip(models, weights, strict=True):
        total = total + w * F.coalesce(F.col(m), F.lit(0.0))
    return total / sum(weights)


def stacked(fit: DataFrame, test: DataFrame, models: Sequence[str], label: str, learner: str = "boosting", **settings: object) -> DataFrame:
    """A second model over the first models' columns, fitted on ``fit`` only; ``prediction`` on ``test``."""
    assembler = VectorAssembler(inputCols=list(models), outputCol="__inputs", handleInvalid="keep")
    model: PipelineModel = Pipeline(stages=[assembler, REGRESSORS[learner](featuresCol="__inputs", labelCol=label, **settings)]).fit(fit)
    return model.transform(test)


def factor_ranking(daily: DataFrame, factor: str) -> DataFrame:
    """Factors by the size of their mean daily correlation."""
    each = daily.groupBy(factor).agg(F.avg("ic").alias("ic"))
    return each.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.abs("ic")), factor)))


def mlp_forward(vector: Column, layers: Sequence[tuple[np.ndarray, np.ndarray]]) -> Column:
    """A small rectified network with given weights, as array expressions: no Python in the scan."""
    value = vector
    for i, (w, b) in enumerate(layers):
        rows = [dot(value, F.array(*[F.lit(float(x)) for x in column])) + float(c) for column, c in zip(np.asarray(w).T, b, strict=True)]
        value = F.array(*[F.greatest(r, F.lit(0.0)) if i + 1 < len(layers) else r for r in rows])
    return value


__all__ = ["CLASSIFIERS", "REGRESSORS", "Fold", "as_vector", "centroids", "choose", "cosine", "factor_ranking", "fisher", "fuse", "gated", "mlp_forward", "moments", "neighbour_vote", "neighbours", "reducer", "ridge", "rolling", "rolling_windows", "select_positions", "shrunk_cluster_means", "soft_assign", "split", "stacked", "static_gate", "top_positions"]
