"""The registry of queries and the roles that the given tables play in them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, with the SQL that gives the same rows where there is one."""

    def add(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Six digits, so that the order in which an engine adds doubles does not show."""
    return F.round(c, 6)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, date, open, close, high, low, amount, volume, signal): events as daily bars of each user."""
    at = F.struct("ts", "event_id")
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("asset"), F.to_date("ts").alias("date"))
        .agg(
            F.min_by("value", at).alias("open"), F.max_by("value", at).alias("close"), F.max("value").alias("high"), F.min("value").alias("low"),
            r6(F.sum("value")).alias("amount"), F.count(F.lit(1)).alias("volume"), r6(F.avg("value")).alias("signal"),
        )
    )


#: The same bars in SQL.
PANEL = """panel AS (SELECT user_id AS asset, ts::DATE AS date, first(value ORDER BY ts, event_id) AS open, last(value ORDER BY ts, event_id) AS close,
 max(value) AS high, min(value) AS low, round(sum(value), 6) AS amount, count(*) AS volume, round(avg(value), 6) AS signal FROM events GROUP BY ALL)"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, date, pred, actual): a day's mean event value, and the return to the asset's next close, where there is one."""
    from tidemark.operators.windows import forward_return

    rows = panel(spark, sf_dir).withColumn("actual", forward_return("close", "asset", "date"))
    return rows.where("actual is not null").select("asset", "date", F.col("signal").alias("pred"), "actual")


SIGNALS = (
    PANEL
    + """, signals AS (SELECT asset, date, signal AS pred, actual FROM (SELECT *, lead(close) OVER (PARTITION BY asset ORDER BY date) / nullif(close, 0) - 1 AS actual FROM panel) WHERE actual IS NOT NULL)"""
)
CALENDAR = "cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS rank FROM (SELECT DISTINCT ts::DATE AS date FROM events))"
SPARSE = "cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS rank FROM (SELECT DISTINCT o_orderdate::DATE AS date FROM orders))"
