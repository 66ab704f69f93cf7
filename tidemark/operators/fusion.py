"""Putting predictions together: weight grids, fixed and fitted fusions, and choices by validation figures only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.learning import REGRESSORS, ridge
from tidemark.operators.xsection import daily_ic

#: Weights of the left model that a grid tries.
GRID = (0.0, 0.25, 0.5, 0.75, 1.0)


def grid_scores(df: DataFrame, date: str, actual: str, left: str, right: str, weights: Sequence[float] = GRID) -> DataFrame:
    """(weight, ic): the mean daily rank correlation of w * left + (1 - w) * right, for all weights in one pass."""
    mixes = F.transform(F.array(*[F.lit(float(w)) for w in weights]), lambda w: F.struct(w.alias("weight"), (w * F.col(left) + (1 - w) * F.col(right)).alias("mix")))
    rows = df.select(F.col(date).alias("__d"), F.col(actual).alias("__a"), F.explode(mixes).alias("m")).select("__d", "__a", "m.*")
    return daily_ic(rows, "__d", "__a", "mix", by=("weight",)).groupBy("weight").agg(F.avg("ic").alias("ic"))


def late_fusion(validation: DataFrame, test: DataFrame, date: str, actual: str, left: str, right: str, weights: Sequence[float] = GRID) -> DataFrame:
    """(weight, validation_ic, test_ic, selected): the weight that validation likes best, ties to the smaller; test only reports."""
    seen = grid_scores(validation, date, actual, left, right, weights).withColumnRenamed("ic", "validation_ic")
    later = grid_scores(test, date, actual, left, right, weights).withColumnRenamed("ic", "test_ic")
    every = validation.sparkSession.createDataFrame([(float(w),) for w in weights], "weight double")
    rows = every.join(seen, "weight", "left").join(later, "weight", "left")
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("validation_ic"), "weight"))
    return rows.withColumn("selected", (place == 1) & F.col("validation_ic").isNotNull())


def best_single(validation: DataFrame, date: str, actual: str, models: Sequence[str]) -> str:
    """The model with the highest mean daily rank correlation, ties to the earlier one; the models are few."""
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(m).alias("x")) for i, m in enumerate(models)])
    rows = validation.select(F.col(date).alias("__d"), F.col(actual).alias("__a"), F.explode(cells).alias("m")).select("__d", "__a", "m.*")
    top = daily_ic(rows, "__d", "__a", "x", by=("i",)).groupBy("i").agg(F.avg("ic").alias("ic")).orderBy(F.desc("ic"), "i").first()
    return models[top["i"] if top else 0]


def fused(validation: DataFrame, test: DataFrame, date: str, actual: str, models: Sequence[str], alpha: float = 100.0) -> DataFrame:
    """``test`` with a column for each fusion: equal weight, best single, ridge, elastic net and boosting.

    The last three are fitted on the validation rows; no fusion sees a test value.
    """
    total = F.lit(0.0)
    for m in models:
        total = total + F.col(m)
    out = test.withColumns({"equal_weight": total / len(models), "best_single": F.col(best_single(validation, date, actual, models))})
    inputs = VectorAssembler(inputCols=list(models), outputCol="__inputs")
    seen = inputs.transform(validation.dropna(subset=[*models, actual]))
    learners = {
        "ridge": ridge(seen, alpha, "__inputs", actual),
        "elastic_net": REGRESSORS["elastic_net"](featuresCol="__inputs", labelCol=actual, regParam=1e-4, elasticNetParam=0.5),
        "boosting": REGRESSORS["boosting"](featuresCol="__inputs", labelCol=actual, maxIter=30, maxDepth=4, stepSize=0.05),
    }
    out = inputs.setHandleInvalid("keep").transform(out)
    for name, learner in learners.items():
        out = Pipeline(stages=[learner.setPredictionCol(name)]).fit(seen).transform(out)
    return out.drop("__inputs")


def eligible(primary: Column, rows: Column, least_rows: int, days: Column | None = None, least_days: int | None = None) -> Column:
    """Finite, from enough validation rows and, if asked, from enough days."""
    good = primary.isNotNull() & ~F.isnan(primary) & (F.coalesce(rows, F.lit(0)) >= least_rows)
    return good & (F.coalesce(days, F.lit(0)) >= least_days) if days is not None and least_days is not None else good


def select_per_year(scores: DataFrame, year: str, model: str, order: Sequence[str], ok: Column) -> DataFrame:
    """(year, status, selected_model, eligible_count, candidate_count): the best eligible model of each test year.

    ``order``: validation figures, higher first, a missing one last; ties go by name.  A year without an eligible
    model stays unselected: test figures never step in.
    """
    good = F.coalesce(ok, F.lit(False))
    rank = F.struct(*[F.coalesce(-F.col(c), F.lit(float("inf"))).alias(f"o{i}") for i, c in enumerate(order)], F.col(model).alias("m"))
    each = scores.groupBy(year).agg(F.min(F.when(good, rank)).alias("__best"), F.count_if(good).alias("eligible_count"), F.count(F.lit(1)).alias("candidate_count"))
    status = F.when(F.col("__best").isNull(), "insufficient_validation_data").otherwise("selected")
    return each.select(year, status.alias("status"), F.col("__best.m").alias("selected_model"), "eligible_count", "candidate_count")
