"""Cross-sections: what is computed from all assets of one date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.windows import average_rank
from tidemark.schema import safe_div


def correlation(a: str, b: str) -> Column:
    """Pearson, NULL where a side does not vary.  (The built-in one raises there in ANSI mode.)"""
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def daily_ic(df: DataFrame, date: str, actual: str, prediction: str, least: int = 5, ranked: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, date, n, ic): the correlation of each date's cross-section, of ranks by default."""
    rows = df.where(F.col(date).isNotNull() & F.col(actual).isNotNull() & F.col(prediction).isNotNull())
    keys = [*by, date]
    if ranked:
        rows = rows.withColumns({"__a": average_rank(actual, keys), "__p": average_rank(prediction, keys)})
    else:
        rows = rows.withColumns({"__a": F.col(actual), "__p": F.col(prediction)})
    got = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), correlation("__a", "__p").alias("ic"))
    return got.where((F.col("n") >= least) & F.col("ic").isNotNull())


def ic_summary(daily: DataFrame, *by: str) -> DataFrame:
    """Mean, deviation, information ratio, share of positive dates and number of dates."""
    mean, sd = F.avg("ic"), F.stddev_samp("ic")
    return daily.groupBy(*by).agg(
        mean.alias("ic_mean"), sd.alias("ic_std"), (mean / F.when(sd > 0, sd)).alias("ic_ir"), F.avg((F.col("ic") > 0).cast("double")).alias("positive_rate"), F.count(F.lit(1)).alias("days")
    )


def market_moments(df: DataFrame, date: str, value: str, lower: float, upper: float, least: int) -> DataFrame:
    """(date, market_n, market_mean, market_std, lo, hi) of finite values; all but the count NULL on thin dates."""
    got = df.where(F.col(value).isNotNull()).groupBy(date).agg(
        F.count(F.lit(1)).alias("market_n"), F.avg(value).alias("market_mean"), F.stddev_samp(value).alias("market_std"), F.percentile(value, F.array(F.lit(lower), F.lit(upper))).alias("__q")
    )
    enough = F.col("market_n") >= least
    return got.select(date, "market_n", *[F.when(enough, F.col(c)).alias(c) for c in ("market_mean", "market_std")], F.when(enough, F.col("__q")[0]).alias("lo"), F.when(enough, F.col("__q")[1]).alias("hi"))


def residual_targets(df: DataFrame, date: str, value: str, lower: float = 0.01, upper: float = 0.99, least: int = 5) -> DataFrame:
    """``df`` with market_n, market_mean, residual, cs_zscore and winsor_residual.

    The residual and the z-score take off the raw market mean; the winsorised residual clips first and takes off the
    clipped mean.  The moments are one row a date, so the join with them is small.
    """
    moments = market_moments(df, date, value, lower, upper, least)
    rows = df.join(moments, date, "left")
    clipped = F.when(F.col(value).isNotNull() & F.col("lo").isNotNull(), F.least(F.greatest(F.col(value), F.col("lo")), F.col("hi")))
    rows = rows.withColumn("__w", clipped)
    middle = rows.groupBy(date).agg(F.avg("__w").alias("__wm"))
    rows = rows.join(middle, date, "left")
    residual = F.col(value) - F.col("market_mean")
    return rows.withColumns({"residual": residual, "cs_zscore": safe_div(residual, F.when(F.col("market_std") > 0, F.col("market_std"))), "winsor_residual": F.col("__w") - F.col("__wm")}).drop("__w", "__wm", "market_std", "lo", "hi")


def above_quantile(df: DataFrame, date: str, score: str, fraction: float, least: int = 5) -> DataFrame:
    """Rows at or over their date's 1 - fraction quantile; dates under ``least`` rows go."""
    edge = df.where(F.col(score).isNotNull()).groupBy(date).agg(F.percentile(score, 1 - fraction).alias("__edge"), F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least)
    return df.join(edge, date).where(F.col(score) >= F.col("__edge")).drop("__edge", "__n")


def top_rows(df: DataFrame, date: str, score: str, tie: str, rule: str = "ceil", fraction: float = 0.2, least: int = 1) -> DataFrame:
    """Rows with ``__side`` long or short: each date's top and bottom by a counting rule.

    ceil: max(1, ceil(f n)).  floor: floor(f n), dates without 2 k rows go.  half: min(max(1, floor(f n)), n div 2).
    """
    from pyspark.sql import Window

    rows = df.where(F.col(score).isNotNull())
    w = Window.partitionBy(date)
    n = F.count(F.lit(1)).over(w)
    k = {"ceil": F.greatest(F.lit(1), F.ceil(n * fraction)), "floor": F.floor(n * fraction), "half": F.least(F.greatest(F.lit(1), F.floor(n * fraction)), F.floor(n / 2))}[rule]
    rows = rows.withColumns({"__n": n, "__k": k, "__up": F.row_number().over(w.orderBy(F.desc(score), tie)), "__down": F.row_number().over(w.orderBy(score, tie))})
    rows = rows.where((F.col("__n") >= least) & (F.col("__k") > 0))
    if rule == "floor":
        rows = rows.where(F.col("__n") >= 2 * F.col("__k"))
    side = F.array_compact(F.array(F.when(F.col("__up") <= F.col("__k"), F.lit("long")), F.when(F.col("__down") <= F.col("__k"), F.lit("short"))))
    return rows.withColumn("__side", F.explode(side)).drop("__up", "__down")
