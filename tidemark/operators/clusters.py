"""Choosing and comparing clusterings."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALGORITHMS = {"kmeans": KMeans, "gaussian": GaussianMixture, "bisecting": BisectingKMeans}


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row, ``ari``: from the contingency table, whose cells are what is shuffled."""
    pairs = lambda c: c * (c - 1) / 2
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    both = cells.agg(F.sum(pairs(F.col("n"))).alias("s"), F.sum("n").alias("t"))
    one = lambda c, name: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias(name))
    rows = both.join(one(a, "x")).join(one(b, "y"))
    expected = F.col("x") * F.col("y") / F.nullif(pairs(F.col("t")), F.lit(0.0))
    top = (F.col("x") + F.col("y")) / 2
    return rows.select(F.coalesce((F.col("s") - expected) / F.nullif(top - expected, F.lit(0.0)), F.lit(1.0)).alias("ari"))


def choose_k(fit: DataFrame, check: DataFrame, ks: Sequence[int], features: str = "features", seeds: Sequence[int] = (1, 2, 3), stable: float = 0.7) -> tuple[int, list[dict]]:
    """The k with the best silhouette on ``check`` among those whose clusterings agree over seeds."""
    out = []
    for k in ks:
        labels, scores = None, []
        for s in seeds:
            got = KMeans(k=k, seed=s, featuresCol=features, predictionCol=f"c{s}").fit(fit).transform(check if labels is None else labels)
            labels = got
            scores.append(ClusteringEvaluator(featuresCol=features, predictionCol=f"c{s}").evaluate(got) if got.select(f"c{s}").distinct().count() > 1 else -1.0)
        agree = [adjusted_rand(labels, f"c{x}", f"c{y}").first()["ari"] for i, x in enumerate(seeds) for y in seeds[i + 1 :]]
        out.append({"k": k, "silhouette": float(np.mean(scores)), "ari": float(np.mean(agree)) if agree else 1.0})
    best = max([r for r in out if r["ari"] >= stable] or out, key=lambda r: (r["silhouette"], r["ari"], -r["k"]))
    return best["k"], out


def average_linkage(vectors: np.ndarray, clusters: int) -> np.ndarray:
    """Labels 0.. of an average-linkage clustering by cosine distance of a few hundred rows at most."""
    n = len(vectors)
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, size, out=np.zeros_like(vectors, dtype=float), where=size > 0)
    far = 1 - unit @ unit.T
    groups = [[i] for i in range(n)]
    while len(groups) > clusters:
        _, i, j = min((float(far[np.ix_(groups[i], groups[j])].mean()), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        groups[i] += groups.pop(j)
    labels = np.zeros(n, int)
    for k, g in enumerate(sorted(groups, key=min)):
        labels[g] = k
    return labels


def one_hot(df: DataFrame, cluster: str, k: int, name: str = "one_hot") -> DataFrame:
    return df.withColumn(name, F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == F.col(cluster)).cast("double")))
