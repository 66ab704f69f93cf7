"""Deduplication by exact keys, by several keys in order, and by semantic novelty."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import title_key
from tidemark.functions.vectors import dot, unit
from tidemark.operators.joins import range_join
from tidemark.staging import settle


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], last: bool = False) -> DataFrame:
    """The first (or last) row of each key by a total order."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[c.desc() if last else c for c in cols]))
    return df.withColumn("__rn", rank).where("__rn = 1").drop("__rn")


def news_keys(df: DataFrame, url: str, article: str, title: str, summary: str) -> DataFrame:
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    text = F.concat_ws("|", title_key(F.col(title)), title_key(F.col(summary)))
    return df.withColumns({"url_key": blank(url), "article_key": blank(article), "title_key": title_key(F.col(title)), "text_key": F.sha2(text, 256)})


def tiered(df: DataFrame, order: str) -> DataFrame:
    """``duplicate``: by url; without one by article id; without both by text.

    A key counts over all rows: a row without url whose article id an earlier row with url had is a duplicate.
    ``order`` is unique.  The first row of each key is a grouped minimum over (key, order) alone, so blank keys meet
    nowhere and no text is sorted.
    """
    tiers = [F.struct(F.lit(i).alias("tier"), F.col(c).alias("key")) for i, c in enumerate(("url_key", "article_key", "text_key"))]
    used = F.filter(F.array(*tiers), lambda x: x["key"] != "")
    rows = df.select(F.col(order).alias("__o"), used.alias("__used"))
    each = rows.select("__o", F.posexplode("__used").alias("__at", "__k")).select("__o", "__at", "__k.tier", "__k.key")
    first = each.groupBy("tier", "key").agg(F.min("__o").alias("__first"))
    late = each.where("__at = 0").join(first, ["tier", "key"]).where("__first < __o").select(F.col("__o").alias(order), F.lit(True).alias("duplicate"))
    return df.join(late, order, "left").withColumn("duplicate", F.coalesce("duplicate", F.lit(False)))


def greedy(df: DataFrame, keys: Sequence[Sequence[str]], order: str, rounds: int = 8) -> DataFrame:
    """Rows kept by one pass in order that drops a row if any of its keys was kept before; NULL keys never match.

    ``order`` is unique.  A round keeps every open row that comes first on all of its keys, and drops those that share a key
    with one: grouped minima only, so a key that a third of the rows have is settled in one round.  What is still
    open after ``rounds`` lies in long chains of keys; these are passed through in order, each chain on its own.
    """
    cells = [F.when(~F.exists(F.array(*[F.col(c).isNull() for c in key]), lambda x: x), F.concat(F.lit(f"{i}:"), F.sha2(F.to_json(F.struct(*key)), 256))) for i, key in enumerate(keys)]
    links = df.select(F.col(order).alias("__o"), F.explode_outer(F.array_compact(F.array(*cells))).alias("__key"))
    kept = links.where(F.col("__key").isNull()).select("__o")
    open_ = settle(links.where(F.col("__key").isNotNull()))
    for _ in range(rounds):
        if not open_.head(1):
            break
        first = open_.groupBy("__key").agg(F.min("__o").alias("__m"))
        ahead = settle(open_.join(first, "__key").groupBy("__o").agg(F.min("__m").alias("__m")).where("__o = __m").select("__o"))
        kept = kept.unionByName(ahead)
        taken = open_.join(ahead, "__o").select("__key").distinct()
        gone = open_.join(taken, "__key").select("__o").distinct()
        open_ = settle(open_.join(gone, "__o", "left_anti"))
    else:
        if open_.head(1):
            kept = kept.unionByName(chains(open_, dict(df.dtypes)[order]))
    return df.join(kept.select(F.col("__o").alias(order)), order, "left_semi")


def chains(links: DataFrame, order_type: str) -> DataFrame:
    """The kept ``__o`` of links (__o, __key), passing through each set of linked rows in order."""

    def one_pass(group: pd.DataFrame) -> pd.DataFrame:
        kept: set[str] = set()
        out = []
        for at, own in group.sort_values("__o").groupby("__o", sort=True)["__key"]:
            if kept.isdisjoint(own):
                kept.update(own)
                out.append(at)
        return pd.DataFrame({"__o": out})

    return links.join(linked(links), "__o").groupBy("root").applyInPandas(one_pass, f"__o {order_type}")


def linked(links: DataFrame) -> DataFrame:
    """(__o, root): the least __o reachable over shared keys of links (__o, __key).

    A round takes the least label over each key, then the label of that label's own row, so long chains settle in
    few rounds; rounds end only when no label changes.
    """
    state = links.select("__o", F.col("__o").alias("root")).distinct()
    before = None
    while True:
        least = links.join(state, "__o").groupBy("__key").agg(F.min("root").alias("__m"))
        better = links.join(least, "__key").groupBy("__o").agg(F.min("__m").alias("__m"))
        state = state.join(better, "__o", "left").select("__o", F.least("root", F.coalesce("__m", "root")).alias("root")).transform(settle)
        jump = state.groupBy(F.col("__o").alias("root")).agg(F.min("root").alias("__m"))
        state = state.join(jump, "root").select("__o", F.col("__m").alias("root")).transform(settle)
        now = state.agg(F.sum(F.xxhash64("__o", "root").cast("decimal(38,0)"))).first()[0]
        if now == before:
            return state
        before = now


def novelty(df: DataFrame, by: str, rank: str, at: str, row: str, vector: str, back: int = 5) -> DataFrame:
    """``df`` with max_prior (cosine) and prior_row: the likest earlier row of the same key at most ``back`` sessions before.

    Ties go to the earliest row.  Rows without a session have no part.  Vectors are made unit once; pairs come from
    a hash join on buckets of ranks.
    """
    ready = df.where(F.col(rank).isNotNull()).withColumn("__v", unit(F.col(vector)))
    prior = ready.select(by, F.col(rank).alias("__pr"), F.col(at).alias("__pa"), F.col(row).alias("__prow"), F.col("__v").alias("__pv"))
    now = ready.select(by, F.col(rank).alias("__r"), F.col(at).alias("__a"), F.col(row).alias("__row"), "__v")
    earlier = F.struct("__pr", "__pa", "__prow") < F.struct(F.col("__r").alias("__pr"), F.col("__a").alias("__pa"), F.col("__row").alias("__prow"))
    pairs = range_join(now, prior, [by], "__r", "__pr", back, earlier)
    scored = pairs.withColumn("__s", dot(F.col("__v"), F.col("__pv"))).where(dot(F.col("__v"), F.col("__v")) > 0)
    best = scored.groupBy("__row").agg(F.max("__s").alias("max_prior"), F.min(F.struct(-F.col("__s"), "__pr", "__pa", "__prow")).alias("__b"))
    return df.join(best.select(F.col("__row").alias(row), "max_prior", F.col("__b.__prow").alias("prior_row")), row, "left")
