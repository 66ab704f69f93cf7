"""Aggregations and scores that are plain grouped expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.windows import average_rank
from tidemark.schema import safe_div


def stock_day(df: DataFrame, keys: Sequence[str], prediction: str, target: str, averaged: bool = False, tolerance: float = 0.0) -> DataFrame:
    """(*keys, prediction, target, n_documents).  Targets that differ within a key raise when read, unless ``averaged``."""
    lo, hi = F.min(target), F.max(target)
    kept = F.avg(target) if averaged else F.when(F.coalesce(hi - lo <= tolerance, F.lit(True)), lo).otherwise(F.raise_error(F.lit("targets differ within a key")).cast("double"))
    return df.groupBy(*keys).agg(F.avg(prediction).alias("prediction"), kept.alias("target"), F.count(F.lit(1)).alias("n_documents"))


def inconsistent(df: DataFrame, keys: Sequence[str], target: str, tolerance: float = 1e-12) -> DataFrame:
    spread = F.max(target) - F.min(target)
    return df.groupBy(*keys).agg(spread.alias("spread"), F.count(F.lit(1)).alias("n")).where(F.col("spread") > tolerance)


def argmax_row(df: DataFrame, by: Sequence[str], metric: str, tie: str) -> DataFrame:
    """The row with the largest metric of each group, ties to the smallest ``tie``: one aggregation, no sort."""
    best = F.max_by(F.struct(*[c for c in df.columns if c not in by]), F.struct(metric, -F.col(tie)))
    return df.where(F.col(metric).isNotNull()).groupBy(*by).agg(best.alias("__b")).select(*by, "__b.*")


def weighted_mean(value: str, weight: str) -> Column:
    return safe_div(F.sum(F.col(value) * F.col(weight)), F.sum(weight))


def binary_scores(df: DataFrame, label: str, probability: str, *by: str, threshold: float = 0.5) -> DataFrame:
    """Confusion counts and the scores from them, log loss, Brier and exact AUC, in one pass after one ranking."""
    keys = list(by) or ["__all"]
    rows = df.where(F.col(label).isNotNull() & F.col(probability).isNotNull())
    if not by:
        rows = rows.withColumn("__all", F.lit(1))
    clipped = F.least(F.greatest(F.col(probability), F.lit(1e-7)), F.lit(1 - 1e-7))
    rows = rows.withColumns({"__y": F.col(label).cast("double"), "__p": clipped}).withColumns({"__h": (F.col("__p") > threshold).cast("double"), "__r": average_rank("__p", keys)})
    y, p, h = F.col("__y"), F.col("__p"), F.col("__h")
    got = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(y * h).alias("tp"), F.sum((1 - y) * h).alias("fp"), F.sum(y * (1 - h)).alias("fn"), F.sum((1 - y) * (1 - h)).alias("tn"),
        F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"), F.avg((p - y) * (p - y)).alias("brier"), F.sum(F.col("__r") * y).alias("__ranks"),
    )
    tp, fp, fn, tn, n = (F.col(c) for c in ("tp", "fp", "fn", "tn", "n"))
    recall, specificity, precision = safe_div(tp, tp + fn), safe_div(tn, tn + fp), F.coalesce(safe_div(tp, tp + fp), F.lit(0.0))
    base = (tp + fn) / n
    both = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    one_class = (tp + fn == 0) | (tn + fp == 0)
    scored = {
        "positive_rate": base, "accuracy": (tp + tn) / n, "balanced_accuracy": (F.coalesce(recall, specificity) + F.coalesce(specificity, recall)) / 2, "precision": precision,
        "recall": F.coalesce(recall, F.lit(0.0)), "specificity": specificity, "f1": F.coalesce(safe_div(2 * tp, 2 * tp + fp + fn), F.lit(0.0)),
        "mcc": F.when(~one_class, F.coalesce(safe_div(tp * tn - fp * fn, both), F.lit(0.0))),
        "auc": F.when(~one_class, safe_div(F.col("__ranks") - (tp + fn) * (tp + fn + 1) / 2, (tp + fn) * (tn + fp))),
        "majority_accuracy": F.greatest(base, 1 - base), "predicted_positive_rate": (tp + fp) / n, "lift": (tp + tn) / n - F.greatest(base, 1 - base),
    }
    return got.select(*by, "n", "log_loss", "brier", *[v.alias(k) for k, v in scored.items()])


def regression_scores(df: DataFrame, actual: str, prediction: str, *by: str) -> DataFrame:
    rows = df.where(F.col(actual).isNotNull() & F.col(prediction).isNotNull())
    error = F.col(prediction) - F.col(actual)
    total = F.var_pop(actual) * F.count(F.lit(1))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(error * error).alias("mse"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"),
        (1 - F.sum(error * error) / F.nullif(total, F.lit(0.0))).alias("r2"),
        (F.covar_pop(actual, prediction) / F.nullif(F.stddev_pop(actual) * F.stddev_pop(prediction), F.lit(0.0))).alias("pearson"),
        F.avg((F.signum(actual) == F.signum(prediction)).cast("double")).alias("sign_accuracy"),
    )


def stability(df: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean, deviation (0 for one run), least and most of each metric over runs."""
    cells = []
    for m in metrics:
        cells += [F.avg(m).alias(f"{m}_mean"), F.when(F.count(m) > 0, F.coalesce(F.stddev_samp(m), F.lit(0.0))).alias(f"{m}_std"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max")]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_runs"), *cells)


def leave_one_group_out(df: DataFrame, group: str, value: str) -> DataFrame:
    """Each group's mean and that of all other groups' rows."""
    each = df.groupBy(group).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    w = Window.partitionBy()
    total, n = F.sum(F.col("mean") * F.col("n")).over(w), F.sum("n").over(w)
    return each.withColumn("others", safe_div(total - F.col("mean") * F.col("n"), n - F.col("n")))


def binary_losses(label: Column, probability: Column, threshold: float = 0.5) -> dict[str, Column]:
    p = F.least(F.greatest(probability, F.lit(1e-7)), F.lit(1 - 1e-7))
    return {"log_loss": -(label * F.log(p) + (1 - label) * F.log(1 - p)), "brier": (p - label) * (p - label), "zero_one": ((p > threshold).cast("double") != label).cast("double")}


def regression_losses(actual: Column, prediction: Column, delta: float = 0.01) -> dict[str, Column]:
    e = F.abs(prediction - actual)
    return {"squared": e * e, "absolute": e, "huber": F.when(e <= delta, 0.5 * e * e).otherwise(delta * (e - 0.5 * delta))}


def qlike(actual: Column, prediction: Column, floor: float = 1e-12) -> Column:
    ratio = F.greatest(actual, F.lit(floor)) / F.greatest(prediction, F.lit(floor))
    return ratio - F.log(ratio) - 1
