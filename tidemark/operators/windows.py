"""Window expressions.  Each takes columns and returns a column, so that one sort serves several."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.schema import safe_div

Keys = str | Sequence[str]


def _keys(keys: Keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def ordered(keys: Keys, *order: str | Column) -> WindowSpec:
    return Window.partitionBy(*_keys(keys)).orderBy(*order)


def forward_return(price: str, keys: Keys, order: str, horizon: int = 1) -> Column:
    """price[t + h] / price[t] - 1 in the key's own rows."""
    return safe_div(F.lead(price, horizon).over(ordered(keys, order)), F.col(price)) - 1


def event_return(price: str, keys: Keys, order: str, ahead: int = 1, back: int = 2) -> Column:
    w = ordered(keys, order)
    return safe_div(F.lead(price, ahead).over(w), F.lag(price, back).over(w)) - 1


def full(value: Column, over: WindowSpec, needed: int, seen: str | Column) -> Column:
    """``value`` where the frame has at least ``needed`` non-null observations."""
    return F.when(F.count(seen).over(over) >= needed, value)


def window_stat(column: str, keys: Keys, order: str, window: int, stat: str, forward: bool = False, min_periods: int | None = None) -> Column:
    """mean, std or median of the ``window`` rows before the current one, or from it on; all observed unless told."""
    w = ordered(keys, order).rowsBetween(0, window - 1) if forward else ordered(keys, order).rowsBetween(-window, -1)
    value = {"mean": F.avg(column), "std": F.stddev_samp(column), "median": F.percentile(column, 0.5), "max": F.max(column), "min": F.min(column), "sum": F.sum(column)}[stat]
    return full(value.over(w), w, min_periods or window, column)


def forward_product(returns: str, keys: Keys, order: str, horizon: int) -> Column:
    """Compounded return of the next ``horizon`` rows, all observed."""
    w = ordered(keys, order).rowsBetween(0, horizon - 1)
    return full(F.product(1 + F.col(returns)).over(w) - 1, w, horizon, returns)


def trailing_mean(column: str, keys: Keys, order: str, window: int) -> Column:
    w = ordered(keys, order).rowsBetween(-(window - 1), 0)
    return full(F.avg(column).over(w), w, window, column)


def forward_fill(column: str, keys: Keys, order: str) -> Column:
    return F.last(column, ignorenulls=True).over(ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0))


def average_rank(column: str | Column, keys: Keys) -> Column:
    """Rank with ties at their mean; NULL stays NULL and isn't counted."""
    c = F.col(column) if isinstance(column, str) else column
    ranks = F.rank().over(ordered(keys, c.asc_nulls_last()))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*_keys(keys), c))
    return F.when(c.isNotNull(), ranks + (ties - 1) / 2)


def pct_rank(column: str | Column, keys: Keys) -> Column:
    """Average rank / n over the non-null values."""
    c = F.col(column) if isinstance(column, str) else column
    return average_rank(c, keys) / F.count(c).over(Window.partitionBy(*_keys(keys)))


def quantile_bucket(score: str, tie: str, keys: Keys, q: int) -> Column:
    """0 .. q-1: quantile buckets of first-come ranks, right-closed at linear quantile edges."""
    rn = F.row_number().over(ordered(keys, F.col(score), F.col(tie)))
    n = F.count(F.lit(1)).over(Window.partitionBy(*_keys(keys)))
    return F.greatest(F.lit(0), F.ceil((rn - 1) * q / F.greatest(n - 1, F.lit(1))).cast("int") - 1)


def demean(column: str, keys: Keys) -> Column:
    return F.col(column) - F.avg(column).over(Window.partitionBy(*_keys(keys)))


def zscore(column: str, keys: Keys) -> Column:
    """Standardised with the sample deviation; NULL where that is 0 or undefined."""
    sd = F.stddev_samp(column).over(Window.partitionBy(*_keys(keys)))
    return safe_div(demean(column, keys), sd)


def neighbour_mean(column: str, keys: Keys) -> Column:
    """Mean of the group's other rows, 0 for a row alone."""
    w = Window.partitionBy(*_keys(keys))
    n = F.count(F.lit(1)).over(w)
    return F.when(n > 1, (F.sum(column).over(w) - F.col(column)) / F.greatest(n - 1, F.lit(1))).otherwise(0.0)


def wealth(returns: str, keys: Keys, order: str) -> Column:
    return F.product(1 + F.col(returns)).over(ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0))


def drawdown(wealth_column: str, keys: Keys, order: str, floor: bool = True) -> Column:
    """Wealth over its running peak less 1; ``floor`` counts the initial wealth of 1 as a peak."""
    peak = F.max(wealth_column).over(ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    return F.col(wealth_column) / (F.greatest(peak, F.lit(1.0)) if floor else peak) - 1


def first_row(keys: Keys, *order: str | Column) -> Column:
    return F.row_number().over(ordered(keys, *order)) == 1
