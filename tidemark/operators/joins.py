"""Joins with a declared cardinality, in time, in ranges, and of many models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.schema import ContractError, duplicate_keys


def validated_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", cardinality: str = "many_to_one", strict: bool = True) -> DataFrame:
    """A join whose cardinality is checked first; ``strict=False`` trusts it and adds no action."""
    if cardinality not in ("many_to_one", "one_to_one", "one_to_many", "many_to_many"):
        raise ValueError(f"unknown cardinality {cardinality}")
    sides = [(left, "left")] * cardinality.startswith("one_to") + [(right, "right")] * cardinality.endswith("to_one")
    for frame, name in sides if strict else ():
        if duplicate_keys(frame, *on).head(1):
            raise ContractError(f"{name} keys {tuple(on)} are not unique")
    return left.join(right, list(on), how)


def asof_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: Sequence[str], take: Sequence[str], forward: bool = False, strict: bool = False, tie: str | None = None) -> DataFrame:
    """Each left row with the ``take`` columns of the last right row at or before it (``forward``: first at or after).

    Both sides are unioned and read in one sorted window by key: linear in the rows, one shuffle, no
    range join.  ``strict`` leaves out equal times; ``tie`` orders right rows of one time.
    """
    by, take = list(by), list(take)
    value = F.struct(F.col(right_on).alias("__at"), *take)
    empty = F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType)
    order = F.col(tie) if tie else F.lit(0)
    want = left.select(*by, F.col(left_on).alias("__t"), F.lit(1).alias("__want"), F.lit(None).cast(right.select(order.alias("o")).schema["o"].dataType).alias("__tie"), empty.alias("__v"), F.struct(*left.columns).alias("__row"))
    have = right.where(F.col(right_on).isNotNull()).select(*by, F.col(right_on).alias("__t"), F.lit(0).alias("__want"), order.alias("__tie"), value.alias("__v"), F.lit(None).cast(want.schema["__row"].dataType).alias("__row"))
    # at equal times the left row comes after the right rows that it may take, else before them
    late = F.col("__want") if strict == forward else -F.col("__want")
    first = F.col("__t"), late, F.col("__tie")
    if forward:
        span = Window.partitionBy(*by).orderBy(*first).rowsBetween(0, Window.unboundedFollowing)
        found = F.first("__v", ignorenulls=True).over(span)
    else:
        span = Window.partitionBy(*by).orderBy(*first).rowsBetween(Window.unboundedPreceding, 0)
        found = F.last("__v", ignorenulls=True).over(span)
    rows = want.unionByName(have).withColumn("__found", found).where("__want = 1")
    return rows.select("__row.*", *[F.col(f"__found.{c}").alias(c) for c in take])


def range_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_rank: str, right_rank: str, back: int, condition: Column | None = None) -> DataFrame:
    """Pairs with left_rank - back <= right_rank <= left_rank, as a hash join on buckets of ``back + 1`` ranks.

    A left row looks into its own bucket and the one before; the right side is not copied.  Other columns must differ.
    """
    size = back + 1
    l = left.withColumn("__b", F.explode(F.array_distinct(F.array(F.floor(F.col(left_rank) / size), F.floor((F.col(left_rank) - back) / size)))))  # noqa: E741
    r = right.withColumn("__b", F.floor(F.col(right_rank) / size))
    joined = l.join(r, [*by, "__b"]).where((F.col(right_rank) <= F.col(left_rank)) & (F.col(right_rank) >= F.col(left_rank) - back))
    return (joined.where(condition) if condition is not None else joined).drop("__b")


def align_models(frames: dict[str, DataFrame], keys: Sequence[str], value: str, label: str | None = None, tolerance: float = 1e-12) -> DataFrame:
    """One row for each key that every model has, with a column for each model: one shuffle for any number of models.

    Keys whose ``label`` differs by more than ``tolerance`` between models raise when read.
    """
    names = sorted(frames)
    long = None
    for name in names:
        part = frames[name].select(*keys, F.lit(name).alias("__m"), F.col(value).cast("double").alias("__v"), *([F.col(label).cast("double").alias("__y")] if label else []))
        long = part if long is None else long.unionByName(part)
    extra = [F.min("__y").alias("__lo"), F.max("__y").alias("__hi")] if label else []
    wide = long.groupBy(*keys).agg(F.count_distinct("__m").alias("__n"), F.count(F.lit(1)).alias("__rows"), *extra, *[F.max(F.when(F.col("__m") == n, F.col("__v"))).alias(n) for n in names])
    wide = wide.where(F.col("__n") == len(names))
    if label:
        agreed = F.when(F.coalesce(F.col("__hi") - F.col("__lo") <= tolerance, F.lit(True)), F.col("__lo")).otherwise(F.raise_error(F.lit("labels differ between models")).cast("double"))
        wide = wide.withColumn(label, agreed).drop("__lo", "__hi")
    return wide.drop("__n", "__rows")


def anti_any(new: DataFrame, known: DataFrame, keys: Sequence[Sequence[str]]) -> DataFrame:
    """Rows of ``new`` that share none of the key sets with ``known``; NULL keys match nothing."""
    for key in keys:
        new = new.join(known.select(*key).distinct(), list(key), "left_anti")
    return new


def coalesced_outer(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right, list(on), "full_outer")


def audit_keys(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """(side, n): how many distinct keys only the left, only the right, and both have."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    tagged = a.withColumn("__l", F.lit(1)).withColumn("__r", F.lit(0)).unionByName(b.withColumn("__l", F.lit(0)).withColumn("__r", F.lit(1)))
    each = tagged.groupBy(*keys).agg(F.max("__l").alias("l"), F.max("__r").alias("r"))
    return each.groupBy(F.when(F.col("l") + F.col("r") == 2, "both").when(F.col("l") == 1, "left").otherwise("right").alias("side")).agg(F.count(F.lit(1)).alias("n"))
