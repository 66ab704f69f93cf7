"""The execution panel: dense sessions, marked prices, and what can be traded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.calendar import densify
from tidemark.schema import safe_div


def listing_spell(dense: DataFrame, key: str, date: str) -> DataFrame:
    """Adds observed, listing_day, listed, and marked_open/close: prices carried within the first to the last observation."""
    past = Window.partitionBy(key).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.col("open").isNotNull() & F.col("close").isNotNull()
    rows = dense.withColumn("observed", seen)
    last_day = F.max(F.when(F.col("observed"), F.col(date))).over(Window.partitionBy(key))
    rows = rows.withColumns({"listing_day": F.sum(F.col("observed").cast("long")).over(past) - 1, "__last": last_day})
    rows = rows.withColumn("listed", F.coalesce((F.col("listing_day") >= 0) & (F.col(date) <= F.col("__last")), F.lit(False)))
    carried = {f"marked_{c}": F.when(F.col("listed"), F.last(F.when(F.col("observed"), F.col(c)), ignorenulls=True).over(past)) for c in ("open", "close")}
    return rows.withColumns(carried).drop("__last")


def execution_panel(bars: DataFrame, calendar: DataFrame, key: str = "asset", date: str = "date", limit: Column | None = None, initial_days: int = 5, tolerance: float = 0.002) -> DataFrame:
    """Returns to the next session on three rules, and conservative flags, for every key and session.

    o2o and c2c use marked prices, so a suspension counts 0 until it ends; tradable_o2o needs both opens.
    """
    rows = listing_spell(densify(bars, calendar, key, date), key, date)
    w = Window.partitionBy(key).orderBy(date)
    rows = rows.withColumn("gap", safe_div(F.col("marked_open"), F.lag("marked_close").over(w)) - 1)
    typical = (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4
    carried = F.when(F.col("listed"), F.last(F.when(F.col("observed"), typical), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumns({"__typical": carried, "next_observed": F.coalesce(F.lead("observed").over(w), F.lit(False)), "__limit": limit if limit is not None else F.lit(0.1)})
    settled = F.col("observed") & (F.col("listing_day") >= initial_days)
    step = lambda c: safe_div(F.lead(c).over(w), F.col(c)) - 1
    return rows.withColumns({
        "ipo_window": (F.col("listing_day") < initial_days) & F.col("listed"),
        "can_buy": F.coalesce(settled & (F.col("gap") < F.col("__limit") - tolerance), F.lit(False)),
        "can_sell": F.coalesce(settled & (F.col("gap") > -F.col("__limit") + tolerance), F.lit(False)),
        "eligible": settled,
        "tradable_o2o": F.when(F.col("observed") & F.col("next_observed"), step("open")),
        "o2o": step("marked_open"), "c2c": step("marked_close"), "vwap_proxy": step("__typical"),
        "o2c": safe_div(F.col("marked_close"), F.col("marked_open")) - 1,
    }).drop("__typical", "__limit")
