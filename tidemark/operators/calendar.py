"""Trading calendars.  A calendar is small (one row a session), so its windows need no partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trading_calendar(df: DataFrame, date: str = "date") -> DataFrame:
    """(date, rank): the distinct dates, ranked from 0."""
    days = df.select(F.col(date).cast("date").alias("date")).where("date is not null").distinct()
    return days.withColumn("rank", F.row_number().over(Window.orderBy("date")) - 1)


def with_rank(df: DataFrame, calendar: DataFrame, date: str = "date", name: str = "rank") -> DataFrame:
    """``name``: the session's rank, NULL off the calendar."""
    ranks = calendar.select(F.col("date").alias(date), F.col("rank").alias(name))
    return df.drop(name).join(ranks, date, "left")


def session_map(days: DataFrame, calendar: DataFrame, strict: bool = False, backward: bool = False) -> DataFrame:
    """(date, session): the first session on or after each date (``strict``: after), or the last on or before it.

    One sort of the distinct dates with the calendar, not a join of every row with it.
    """
    both = days.select(F.col("date").cast("date").alias("date")).distinct().withColumn("s", F.lit(None).cast("date")).withColumn("want", F.lit(1))
    both = both.unionByName(calendar.select("date", F.col("date").alias("s"), F.lit(0).alias("want")))
    # on a session day the wanted row stands so that it sees that session, or not if strict
    order = F.col("want") if strict != backward else -F.col("want")
    if backward:
        session = F.last("s", ignorenulls=True).over(Window.orderBy("date", order).rowsBetween(Window.unboundedPreceding, 0))
    else:
        session = F.first("s", ignorenulls=True).over(Window.orderBy("date", order).rowsBetween(0, Window.unboundedFollowing))
    return both.withColumn("session", session).where("want = 1").select("date", "session")


def next_session(df: DataFrame, calendar: DataFrame, date: str, name: str = "session", strict: bool = False, backward: bool = False) -> DataFrame:
    found = session_map(df.select(F.col(date).cast("date").alias("date")), calendar, strict, backward)
    return df.drop(name).join(found.select(F.col("date").alias("__d"), F.col("session").alias(name)), F.col(date).cast("date") == F.col("__d"), "left").drop("__d")


def shift_session(df: DataFrame, calendar: DataFrame, date: str, by: int, name: str) -> DataFrame:
    """``name``: the session ``by`` ranks later, NULL off the calendar or past its ends."""
    here = calendar.select(F.col("date").alias(date), (F.col("rank") + by).alias("__r"))
    there = calendar.select(F.col("rank").alias("__r"), F.col("date").alias(name))
    return df.drop(name).join(here.join(there, "__r").drop("__r"), date, "left")


def densify(df: DataFrame, calendar: DataFrame, key: str, date: str = "date") -> DataFrame:
    """Every key on every session, other columns NULL where there was no row.

    The calendar is exploded from one array, which a century of sessions keeps under 40,000 entries.
    """
    days = calendar.agg(F.array_sort(F.collect_set("date")).alias("__days"))
    spine = df.select(key).distinct().join(days).select(key, F.explode("__days").alias(date))
    return spine.join(df, [key, date], "left")
