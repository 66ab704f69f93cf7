r"""Operator 6: mixing sources to target weights by systematic sampling.

A document's size is its number of ``[^\x20\x09-\x0D]+``.  Sources in code-point order, null last, take the
weights in turn; their shares of all sizes are capped at ``most`` times the source's size and the excess is
shared again by weight until no target is above.  Each document of a source expects target / size copies:
with these prefix-summed and one offset added, a document is emitted once for each integer boundary crossed.

Within a source documents are ordered by size class (four leading bits) and then by md5 of id and text, so
every stretch of the prefix sum has like sizes and the taken words come near the target.  The prefix sum
is made from counts by (source, class, leading hex digits of the md5): enough digits that no window holds
more than about ``window`` rows, however hot a source is.

Defined results: a null text has size 0; null is a source of its own; rows equal in id and text may share their
copies either way, with the same rows out; null and repeated ids are told apart by their texts; a source of size 0 takes nothing; no rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, settle


def with_size(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__size`` and ``__md5``, of the id and the text: what orders documents of one size class."""
    own = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    return docs.withColumns({"__size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"), "__md5": F.md5(own.cast("binary"))})


def _keys(sized: DataFrame) -> DataFrame:
    low = "greatest(length(bin(__size)) - 4, 0)"
    return sized.withColumns({
        "__class": F.expr(f"shiftleft(shiftright(__size, {low}), {low})"),
        "__s": F.coalesce("source", F.lit("")),
        "__none": F.col("source").isNull(),
    })


def targets(sources: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """``sources``: (source, __words), one row for each source.  Adds ``__target`` by filling up the least ratios first.

    Ordered by size / weight, a source is capped if its cap is under its share of what the sources before
    left; the first that isn't gives the rate of all that follow.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    at = (F.row_number().over(order) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (at + 1).cast("int")).cast("long")
    rows = sources.withColumn("__w", w).withColumn("__cap", F.col("__words") * most)
    by = Window.orderBy((F.col("__cap") / F.col("__w")), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    rows = rows.withColumns({
        "__left": F.sum("__words").over(everything) - F.sum("__cap").over(by.rowsBetween(Window.unboundedPreceding, 0)) + F.col("__cap"),
        "__rest": F.sum("__w").over(by.rowsBetween(0, Window.unboundedFollowing)),
        "__at": F.row_number().over(by),
    })
    free = F.col("__cap") * F.col("__rest") >= F.col("__w") * F.col("__left")
    rows = rows.withColumn("__rate", F.min(F.when(free, F.struct("__at", "__left", "__rest"))).over(everything))
    share = (F.col("__w") * F.col("__rate.__left")).cast("double") / F.col("__rate.__rest").cast("double")
    target = F.when(F.col("__rate").isNull() | (F.col("__at") < F.col("__rate.__at")), F.col("__cap").cast("double")).otherwise(share)
    return rows.select("source", F.col("__words"), target.alias("__target"))


def offset(source: Column, seed: int) -> Column:
    """A source's random offset in [0, 1), of 20 bits, so that sums with it stay exact."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\x00")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 5), 16, 10).cast("double") / float(1 << 20)


def copies(sized: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, seed: int = 11, window: int = 5_000) -> DataFrame:
    """``sized`` (with ``__size``) and, last: ``__words`` of its source, ``__target``, ``__copies``."""
    keyed = _keys(sized)
    key = ["__s", "__none", "__class"]
    spread = settle(keyed.groupBy(*key, "source").agg(F.sum("__size").alias("__words"), F.count(F.lit(1)).alias("__n")))
    largest = spread.agg(F.max("__n")).first()[0] or 0
    digits = max(0, math.ceil(math.log(max(1, largest / window), 16)))
    keyed = keyed.withColumn("__hex", F.substring("__md5", 1, digits) if digits else F.lit(""))
    goals = targets(spread.groupBy("source").agg(F.sum("__words").alias("__words")), weights, most)
    goals = goals.select(F.coalesce("source", F.lit("")).alias("__s"), F.col("source").isNull().alias("__none"), "__words", "__target")
    parts = keyed.groupBy(*key, "__hex").agg(F.count(F.lit(1)).alias("__n")) if digits else spread.select(*key, F.lit("").alias("__hex"), "__n")
    before = Window.partitionBy("__s", "__none").orderBy("__class", "__hex").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    # the window and the join have the same keys: rows move once
    near = Window.partitionBy(*key, "__hex").orderBy("__md5", "__size", "doc_id")
    ranked = keyed.withColumn("__at", F.row_number().over(near))
    joined = ranked.join(parts.join(goals, ["__s", "__none"]), [*key, "__hex"])
    joined = joined.withColumn("__rank", (F.col("__before") + F.col("__at")).cast("double"))
    each = F.when(F.col("__words") > 0, F.col("__target") / F.col("__words").cast("double")).otherwise(0.0)
    u = offset(F.col("source"), seed)
    crossed = F.floor(u + each * F.col("__rank")) - F.floor(u + each * (F.col("__rank") - 1))
    return joined.withColumn("__copies", F.least(crossed, F.lit(most))).drop("__class", "__md5", "__hex", "__before", "__at", "__rank", "__s", "__none")


def mix(docs: DataFrame, **settings: object) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    got = copies(with_size(docs), **settings).where(F.col("__copies") > 0)
    return got.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*[f"`{c}`" for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    sized = settle(with_size(docs.select("doc_id", "source", "text")).drop("text"))
    got = copies(sized)
    return got.select(
        "doc_id", F.col("__size").alias("size"), F.col("__words").alias("source_size"), F.col("__target").alias("target"), (F.col("__copies") * F.col("__size")).alias("taken")
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS h, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
k AS (SELECT *, (size >> greatest(length(bin(size)) - 4, 0)) << greatest(length(bin(size)) - 4, 0) AS class FROM d),
s AS (SELECT source, sum(size)::BIGINT AS words FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w, 3 * words AS cap FROM s),
o AS (SELECT *, (sum(words) OVER () - sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING) + cap)::BIGINT AS lef,
      (sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rest,
      row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS pos FROM w),
r AS (SELECT min(pos) AS pos, arg_min(lef, pos) AS lef, arg_min(rest, pos) AS rest FROM o WHERE cap * rest >= w * lef),
t AS (SELECT o.source, o.words, CASE WHEN r.pos IS NULL OR o.pos < r.pos THEN o.cap::DOUBLE ELSE (o.w * r.lef)::DOUBLE / r.rest::DOUBLE END AS target FROM o, r),
n AS (SELECT k.*, t.words, t.target, row_number() OVER (PARTITION BY k.source ORDER BY class, h, size, doc_id)::DOUBLE AS rn,
      CASE WHEN t.words > 0 THEN t.target / t.words::DOUBLE ELSE 0 END AS e,
      ('0x' || substr(md5('11:' || coalesce(k.source, chr(0))), 1, 5))::BIGINT::DOUBLE / 1048576 AS u
      FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, words AS source_size, target, (least(floor(u + e * rn) - floor(u + e * (rn - 1)), 3) * size)::BIGINT AS taken FROM n
"""
