"""Contracts on frames: required columns, unique keys, missing values, ids, flags."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A frame breaks a declared contract."""


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    if missing := sorted(set(names) - set(df.columns)):
        raise ContractError(f"missing columns: {', '.join(missing)}")
    return df


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    """An action: use it in strict mode only."""
    if found := duplicate_keys(df, *keys).limit(5).collect():
        raise ContractError(f"duplicate keys {keys}: {[tuple(r) for r in found]}")
    return df


def finite(c: Column | str) -> Column:
    """NaN and infinities become NULL, the only missing value inside the engine."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def number(c: Column | str) -> Column:
    """Text to double, NULL where it isn't a finite number."""
    c = F.col(c) if isinstance(c, str) else c
    return finite(c.try_cast("double"))


def flag(c: Column | str, default: bool) -> Column:
    """Booleans in their usual spellings; anything else is the default."""
    c = F.col(c) if isinstance(c, str) else c
    text = F.lower(F.trim(c.cast("string")))
    return F.when(text.isin("1", "1.0", "true", "t", "yes", "y"), True).when(text.isin("0", "0.0", "false", "f", "no", "n"), False).otherwise(default)


def code6(c: Column | str) -> Column:
    """Six-digit code: a ``.0`` suffix goes, digits are padded; NULL without digits."""
    c = F.col(c) if isinstance(c, str) else c
    digits = F.regexp_extract(F.regexp_replace(F.trim(c.cast("string")), r"\.0$", ""), r"(\d{1,6})", 1)
    return F.when(digits != "", F.lpad(digits, 6, "0"))


def safe_div(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return a / F.when(b != 0, b)


def exact_rows(left: DataFrame, right: DataFrame) -> tuple[int, int]:
    """How many rows are only in the left, and only in the right, frame, with multiplicity."""
    return left.exceptAll(right).count(), right.exceptAll(left).count()
