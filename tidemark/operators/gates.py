"""Gates over tokens and text variants, token figures from moments, and matrix figures from one pass of sums."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.vectors import dot, softmax
from tidemark.operators.learning import moments


# ---- token gates -----------------------------------------------------------------------------------------------


def by_token(m: DataFrame, hidden: int) -> DataFrame:
    """Moments of a flat vector with the ``token`` and ``dim`` that each position belongs to."""
    return m.withColumns({"token": F.floor(F.col("pos") / hidden).cast("int"), "dim": F.pmod("pos", F.lit(hidden)).cast("int")})


def variance_scores(m: DataFrame, hidden: int) -> DataFrame:
    """(token, score): mean variance of a token's dimensions, without labels."""
    mean = F.col("s") / F.col("n")
    each = by_token(m, hidden).withColumn("v", F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0)))
    return each.groupBy("token").agg(F.avg("v").alias("score"))


def fisher_scores(m: DataFrame, label: str, hidden: int, floor: float = 1e-12) -> DataFrame:
    """(token, score): mean over a token's dimensions of the squared gap of class means over the summed class variances."""
    mean = F.col("s") / F.col("n")
    rows = by_token(m, hidden).withColumns({"mu": mean, "v": F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0))})
    side = lambda c, y: F.max(F.when(F.col(label) == y, F.col(c)))
    each = rows.groupBy("token", "pos").agg((side("mu", 1) - side("mu", 0)).alias("gap"), (side("v", 1) + side("v", 0)).alias("spread"))
    return each.groupBy("token").agg(F.avg(F.col("gap") * F.col("gap") / (F.col("spread") + floor)).alias("score"))


def l1_scores(df: DataFrame, vector: str, label: str, tokens: int, hidden: int, strength: float = 0.01) -> list[float]:
    """A score for each token: the absolute weights of its mean, deviation and root mean square in a sparse logistic model."""
    cells = []
    for t in range(tokens):
        part = F.slice(F.col(vector), t * hidden + 1, hidden)
        total = F.aggregate(part, F.lit(0.0), lambda a, x: a + x.cast("double")) / hidden
        square = F.aggregate(part, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / hidden
        cells += [total, F.sqrt(F.greatest(square - total * total, F.lit(0.0))), F.sqrt(square)]
    rows = df.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("label"), array_to_vector(F.array(*cells)).alias("features"))
    weights = np.abs(LogisticRegression(regParam=strength, elasticNetParam=1.0, maxIter=200).fit(rows).coefficients.toArray())
    return weights.reshape(tokens, 3).sum(1).tolist()


def kept_tokens(vector: Column, positions: Sequence[int], hidden: int) -> Column:
    """The flat vector of the chosen tokens, in the order given."""
    return F.flatten(F.array(*[F.slice(vector, p * hidden + 1, hidden) for p in positions]))


def token_figures(m: DataFrame, baseline: DataFrame, hidden: int, floor: float = 1e-12) -> DataFrame:
    """(token, variance_score, context_cosine_distance, context_standardized_l2) from moments and a baseline (pos, base)."""
    mean = F.col("s") / F.col("n")
    rows = by_token(m, hidden).join(baseline, "pos").withColumns({"mu": mean, "v": F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0))})
    gap = F.col("mu") - F.col("base")
    size = F.sqrt(F.sum(F.col("mu") * F.col("mu"))) * F.sqrt(F.sum(F.col("base") * F.col("base")))
    return rows.groupBy("token").agg(
        F.avg("v").alias("variance_score"),
        (1 - F.coalesce(F.sum(F.col("mu") * F.col("base")) / F.nullif(size, F.lit(0.0)), F.lit(0.0))).alias("context_cosine_distance"),
        F.sqrt(F.avg(gap * gap / (F.col("v") + floor))).alias("context_standardized_l2"),
    )


# ---- gates over variants of a text -----------------------------------------------------------------------------------


def _variant_moments(df: DataFrame, variants: Sequence[str], label: str) -> DataFrame:
    """(variant, y, pos, n, s, ss) of all variants' vectors in one pass."""
    cells = F.array(*[F.struct(F.lit(i).alias("variant"), F.col(v).cast("array<double>").alias("x")) for i, v in enumerate(variants)])
    rows = df.where(F.col(label).isNotNull()).select((F.col(label) > 0).cast("int").alias("y"), F.explode(cells).alias("c")).select("y", "c.variant", "c.x")
    return moments(rows, ["variant", "y"], "x")


def variant_weights(df: DataFrame, variants: Sequence[str], label: str, mode: str, strength: float = 0.01) -> list[float]:
    """The weights of the variants, which sum to 1: uniform, variance, fisher or logistic_l1, from training rows only."""
    k = len(variants)
    if mode == "uniform":
        scores = [1.0] * k
    elif mode in ("variance", "fisher"):
        m = _variant_moments(df, variants, label)
        mean = F.col("s") / F.col("n")
        if mode == "variance":
            all_ = m.groupBy("variant", "pos").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
            each = all_.groupBy("variant").agg(F.avg(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0))).alias("score"))
        else:
            rows = m.withColumns({"mu": mean, "v": F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0))})
            side = lambda c, y: F.max(F.when(F.col("y") == y, F.col(c)))
            pair = rows.groupBy("variant", "pos").agg((side("mu", 1) - side("mu", 0)).alias("gap"), (side("v", 1) + side("v", 0)).alias("spread"))
            each = pair.groupBy("variant").agg(F.avg(F.col("gap") * F.col("gap") / (F.col("spread") + 1e-6)).alias("score"))
        got = {r["variant"]: r["score"] for r in each.collect()}
        scores = [got.get(i) for i in range(k)]
    elif mode == "logistic_l1":
        cells = []
        for v in variants:
            n = F.size(v)
            total = F.aggregate(F.col(v), F.lit(0.0), lambda a, x: a + x.cast("double")) / n
            square = F.aggregate(F.col(v), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / n
            cells += [total, F.sqrt(F.greatest(square - total * total, F.lit(0.0))), F.sqrt(square)]
        rows = df.where(F.col(label).isNotNull()).select((F.col(label) > 0).cast("double").alias("label"), array_to_vector(F.array(*cells)).alias("features"))
        scores = np.abs(LogisticRegression(regParam=strength, elasticNetParam=1.0, maxIter=200).fit(rows).coefficients.toArray()).reshape(k, 3).sum(1).tolist()
    else:
        raise ValueError("mode must be uniform, variance, fisher, logistic_l1 or, by directions, dynamic")
    clean = [x if x is not None and np.isfinite(x) and x >= 0 else 0.0 for x in scores]
    return [x / sum(clean) for x in clean] if sum(clean) > 0 else [1.0 / k] * k


def variant_directions(df: DataFrame, variants: Sequence[str], label: str) -> list[list[float]]:
    """For each variant the unit vector from the negative to the positive class mean; zeros where the means agree."""
    mean = F.col("s") / F.col("n")
    rows = _variant_moments(df, variants, label).withColumn("mu", mean)
    gap = rows.groupBy("variant", "pos").agg((F.max(F.when(F.col("y") == 1, F.col("mu"))) - F.max(F.when(F.col("y") == 0, F.col("mu")))).alias("gap")).orderBy("variant", "pos").collect()
    out = []
    for i in range(len(variants)):
        v = np.array([r["gap"] for r in gap if r["variant"] == i], float)
        norm = np.linalg.norm(v)
        out.append((v / norm if norm > 0 and np.isfinite(norm) else np.zeros_like(v)).tolist())
    return out


def dynamic_weights(variants: Sequence[str], directions: Sequence[Sequence[float]], temperature: float = 1.0) -> Column:
    """A row's own weights: the softmax of its variants' projections on their directions."""
    return softmax(F.array(*[dot(F.col(v).cast("array<double>"), F.array(*[F.lit(float(x)) for x in d])) for v, d in zip(variants, directions, strict=True)]), temperature)


def weighed_variants(variants: Sequence[str], weights: Column) -> Column:
    """The variants' vectors times their weights, added up."""
    total = None
    for i, v in enumerate(variants):
        part = F.transform(F.col(v).cast("array<double>"), _times(weights, i))
        total = part if total is None else F.zip_with(total, part, lambda a, b: a + b)
    return total


def _times(weights: Column, i: int):
    return lambda x: x * weights[i]


# ---- sums over matrices of rows ------------------------------------------------------------------------------------


def cross_sums(df: DataFrame, a: str, b: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(n, sum of a, sum of b, sum of a b'): each task adds up its own rows, so what moves is one matrix for each task."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            rows = len(batch)
            if not rows:
                continue
            x, y = (c.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1) for c in batch.columns)
            part = (x.sum(0), y.sum(0), x.T @ y)
            n, total = n + rows, part if total is None else tuple(p + q for p, q in zip(total, part, strict=True))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), *(pa.array([p.ravel()], pa.list_(pa.float64())) for p in total)], names=["n", "a", "b", "ab"])

    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("array<double>").alias("a"), F.col(b).cast("array<double>").alias("b"))
    n, sums = 0, None
    for r in rows.mapInArrow(add, "n bigint, a array<double>, b array<double>, ab array<double>").toLocalIterator():
        part = tuple(np.array(r[c]) for c in ("a", "b", "ab"))
        n, sums = n + r["n"], part if sums is None else tuple(p + q for p, q in zip(sums, part, strict=True))
    if sums is None:
        return 0, *(np.zeros(0),) * 2, np.zeros((0, 0))
    return n, sums[0], sums[1], sums[2].reshape(len(sums[0]), len(sums[1]))


def kernel_alignment(df: DataFrame, a: str, b: str) -> float:
    """Linear centred kernel alignment of two vectors of the same rows, from their cross sums; NaN where one doesn't vary."""
    norm = {}
    for x, y in ((a, b), (a, a), (b, b)):
        n, sx, sy, xy = cross_sums(df, x, y)
        norm[x, y] = float(np.linalg.norm(xy - np.outer(sx, sy) / max(n, 1)))
    return norm[a, b] ** 2 / (norm[a, a] * norm[b, b]) if norm[a, a] * norm[b, b] > 0 else float("nan")


def truncated_svd(df: DataFrame, vector: str, k: int) -> np.ndarray:
    """(k, d): the first right singular vectors of the uncentred rows, from the d x d Gram matrix; the largest entry is positive."""
    gram = cross_sums(df, vector, vector)[3]
    _, v = np.linalg.eigh(gram)
    top = v[:, ::-1][:, :k].T
    return top * np.sign(top[np.arange(len(top)), np.abs(top).argmax(1)])[:, None]


def projected(vector: Column, components: np.ndarray) -> Column:
    """A row's coordinates on the components, as array expressions."""
    return F.array(*[dot(vector.cast("array<double>"), F.array(*[F.lit(float(x)) for x in c])) for c in components])


def expost_edges(df: DataFrame, date: str, value: str, share: float = 0.2) -> DataFrame:
    """(year, days, top, bottom): mean by year of each date's mean over its highest and lowest ``share`` of values, rounded up."""
    order = lambda c: Window.partitionBy(date).orderBy(c, "__tie")
    rows = df.where(F.col(value).isNotNull()).withColumn("__tie", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    n = F.ceil(F.count(F.lit(1)).over(Window.partitionBy(date)) * share)
    ranked = rows.withColumns({"__n": n, "__up": F.row_number().over(order(F.col(value).desc())), "__down": F.row_number().over(order(F.col(value).asc()))})
    daily = ranked.groupBy(date).agg(F.avg(F.when(F.col("__up") <= F.col("__n"), F.col(value))).alias("top"), F.avg(F.when(F.col("__down") <= F.col("__n"), F.col(value))).alias("bottom"))
    return daily.groupBy(F.year(date).alias("year")).agg(F.count(F.lit(1)).alias("days"), F.avg("top").alias("top"), F.avg("bottom").alias("bottom"))
