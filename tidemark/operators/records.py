"""Raw records to clean tables: aliases, validation by ordered reasons, identities, counts of what was dropped."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.functions.text import clean, combine, drop_lines
from tidemark.operators.dedup import first_wins
from tidemark.schema import ContractError, code6, number, require_columns
from tidemark.staging import settle

#: The names under which the same columns arrive.
ALIASES = {"headline": "title", "content": "body", "published": "published_at"}


def renamed(df: DataFrame, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """Aliases to the common names, where those are absent."""
    have = set(df.columns)
    return df.withColumnsRenamed({k: v for k, v in (aliases or ALIASES).items() if k in have and v not in have})


def export(df: DataFrame, source: str, kind: str, need: Iterable[str], names: Mapping[str, str] | None = None, drop: Sequence[str] = ()) -> DataFrame:
    """A permitted export in the common columns, with its source and kind; ``drop`` leaves out personal columns."""
    rows = require_columns(df, need).withColumnsRenamed(dict(names or {})).drop(*drop)
    return rows.withColumns({"source": F.lit(source), "data_type": F.lit(kind)})


def first_reason(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that holds, NULL if none does; a NULL rule does not hold."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules])


def all_reasons(*rules: tuple[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules]))


def clean_news(df: DataFrame, zone: str = "Asia/Shanghai", unicode: bool = True) -> DataFrame:
    """(…, published_at, text, text_hash): one row for each article and stock, in order of time.

    Unreadable times raise, as a silent drop would move the panel.
    """
    require_columns(df, ["article_id", "stock_id", "published_at", "headline", "body"])
    local = F.try_to_timestamp(F.col("published_at").cast("string"))
    at = F.when(local.isNull(), F.raise_error(F.lit("invalid publication time")).cast("timestamp")).otherwise(F.to_utc_timestamp(local, zone))
    text = combine(clean(F.col("headline"), unicode), clean(F.col("body"), unicode))
    rows = df.withColumns({"published_at": at, "text": text}).withColumn("text_hash", F.sha2("text", 256))
    return first_wins(rows, ["article_id", "stock_id"], ["published_at", "text_hash"])


def clean_articles(df: DataFrame, least: int = 50, most: int = 50_000, boilerplate: Sequence[str] = (), order: str = "article_id") -> tuple[DataFrame, DataFrame]:
    """(rows, counts): richer body first (``pdf_text`` over ``body``), then time, length and copies as reasons to drop.

    ``counts`` has one row, from the same pass.  Copies are equal texts of one stock.
    """
    rows = renamed(df)
    require_columns(rows, ["title", "body", "published_at", order])
    if "stock_id" not in rows.columns:
        rows = rows.withColumn("stock_id", F.lit(""))
    tidy = lambda c: F.trim(F.regexp_replace(drop_lines(c, boilerplate), r"(?U)[^\S\n]+", " "))
    pdf = tidy(F.col("pdf_text")) if "pdf_text" in rows.columns else F.lit("")
    rows = rows.withColumns({"body_source": F.when(pdf != "", "pdf").otherwise("html_body"), "body_clean": F.when(pdf != "", pdf).otherwise(tidy(F.col("body"))), "title_clean": tidy(F.col("title"))})
    rows = rows.withColumn("text", F.regexp_replace(F.concat("title_clean", F.lit("。"), "body_clean"), "^[。 ]+|[。 ]+$", ""))
    rows = rows.withColumns({"published_at": F.try_to_timestamp(F.col("published_at").cast("string")), "text_hash": F.sha2("text", 256), "text_chars": F.char_length("text")})
    rows = rows.withColumn("__early", first_reason(("invalid_time", F.col("published_at").isNull()), ("invalid_length", ~F.col("text_chars").between(least, most))))
    copy = (F.row_number().over(Window.partitionBy(F.col("__early").isNull(), "text_hash", "stock_id").orderBy(order)) > 1) & F.col("__early").isNull()
    rows = rows.withColumn("__reason", F.coalesce("__early", F.when(copy, F.lit("duplicates")))).drop("__early")
    names = ("invalid_time", "invalid_length", "duplicates")
    counts = rows.agg(F.count(F.lit(1)).alias("raw_rows"), *[F.count_if(F.col("__reason") == n).alias(n) for n in names], F.count_if(F.col("__reason").isNull()).alias("clean_rows"), F.count_if(F.col("__reason").isNull() & (F.col("body_source") == "pdf")).alias("body_source_pdf"))
    return rows.where(F.col("__reason").isNull()).drop("__reason"), counts


def clean_bars(df: DataFrame, names: Mapping[str, str] | None = None) -> DataFrame:
    """Daily bars with positive prices, the last row of each stock and day by ``order`` if there is one."""
    rows = df.withColumnsRenamed(dict(names or {}))
    require_columns(rows, ["stock_id", "date", "open", "high", "low", "close"])
    rows = rows.withColumns({"stock_id": code6("stock_id"), "date": F.col("date").try_cast("date"), **{c: number(c) for c in ("open", "high", "low", "close")}})
    rows = rows.dropna(subset=["stock_id", "date", "open", "high", "low", "close"]).where("least(open, high, low, close) > 0")
    return first_wins(rows, ["stock_id", "date"], ["order" if "order" in rows.columns else "close"], last=True)


def checked_prices(df: DataFrame) -> DataFrame:
    """Prices that must be right, with dates and numbers: bad dates, prices not over 0 and repeated keys raise.

    Keys are compared as they come out, so that a date in two spellings meets itself.
    """
    require_columns(df, ["stock_id", "date", "close"])
    rows = df.withColumns({"date": F.col("date").try_cast("date"), "close": number("close")})
    keys = rows.groupBy("stock_id", "date").agg(F.count(F.lit(1)).alias("n"), F.count_if(~(F.coalesce("close", F.lit(0.0)) > 0)).alias("c"))
    bad = keys.agg(F.sum(F.when(F.col("date").isNull(), F.col("n")).otherwise(0)).alias("d"), F.sum("c").alias("c"), F.sum(F.col("n") - 1).alias("k")).first()
    if bad["d"] or bad["c"] or bad["k"]:
        raise ContractError(f"{bad['d']} bad dates, {bad['c']} bad prices, {bad['k']} repeated keys")
    return rows


def validated(df: DataFrame, universe: DataFrame, period: str, code: str = "stock_id", prefix: str = "") -> DataFrame:
    """Announcement records with ``reason`` (NULL: valid), six-digit code, time, ``document_id``, ``text_model`` and ``source_period``.

    In this order: outside_stock_universe, non_announcement, non_direct_relation (where a relation is told),
    invalid_publication_time, empty_text_model.  ``universe`` has the column ``code``; it is joined by hash.
    """
    have = set(df.columns)
    pick = lambda *names: F.coalesce(*[F.col(n).cast("string") for n in names if n in have], F.lit(""))
    known = universe.select(code6(code).alias(code)).distinct().withColumn("__in", F.lit(True))
    rows = df.withColumns({code: code6(code), "text_model": pick("text_model", "text"), "__at": F.try_to_timestamp(pick("published_at", "announcement_date"))}).join(known, code, "left")
    relation = [("non_direct_relation", F.col("stock_relation").isNotNull() & (F.col("stock_relation") != "direct"))] if "stock_relation" in have else []
    reason = first_reason(
        ("outside_stock_universe", F.col("__in").isNull()), ("non_announcement", F.coalesce(F.col("content_type"), F.lit("")) != "announcement"), *relation,
        ("invalid_publication_time", F.col("__at").isNull()), ("empty_text_model", F.trim(F.regexp_replace("text_model", r"(?U)\s+", " ")) == ""),
    )
    own = document_id(F.col(code), pick("url"), pick("announcement_date"), pick("published_at"), pick("title_clean_final", "title"), pick("text_hash"))
    return rows.withColumns({"reason": reason, "document_id": F.concat(F.lit(prefix), own), "published_at": F.col("__at"), "source_period": F.lit(period)}).drop("__in", "__at")


def one_asset(df: DataFrame, code: str, value: str, *order: str) -> DataFrame:
    """One asset's rows, numbered 1..n in panel order; without rows this raises."""
    from tidemark.sources.sinks import numbered

    rows = df.where(F.col(code) == value)
    if not rows.head(1):
        raise ContractError(f"no rows of {value}")
    return numbered(rows, *order)


def between(df: DataFrame, at: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Rows from the day ``first`` to the day ``last``, both inclusive; rows without a time go."""
    rows = df.where(F.col(at).isNotNull())
    rows = rows if first is None else rows.where(F.col(at) >= F.lit(first).cast("timestamp"))
    return rows if last is None else rows.where(F.col(at) < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp"))


def document_id(*parts: Column, size: int = 32) -> Column:
    return F.left(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), F.lit(size))


def url_date(url: Column) -> Column:
    """The day that a url's path names, as 2024-01-02, 2024/01/02 or 20240102."""
    path = F.regexp_extract(url, r"^[a-z]+://[^/]*(/[^?#]*)", 1)
    parts = [F.regexp_extract(path, r"(?<!\d)((?:19|20)\d{2})[-/]?(\d{2})[-/]?(\d{2})(?!\d)", i) for i in (1, 2, 3)]
    return F.concat_ws("-", *parts).try_cast("date")


def date_conflict(url: Column, published: Column, days: int = 1) -> Column:
    return F.abs(F.datediff(url_date(url), published)) > days


def page_reason(title: Column, url: Column, url_rules: Mapping[str, str], title_rules: Mapping[str, str]) -> Column:
    path = F.regexp_extract(url, r"^[a-z]+://[^/]*(/[^?#]*)", 1)
    return first_reason(*[(n, path.rlike(p)) for n, p in url_rules.items()], *[(n, F.trim(title).rlike(p)) for n, p in title_rules.items()])


def labelled_by_words(text: Column, classes: Sequence[tuple[str, Sequence[str]]], otherwise: str = "other") -> Column:
    """The first class one of whose words is in the text."""
    out = None
    for name, words in classes:
        hit = F.lit(False)
        for w in words:
            hit = hit | (F.instr(text, w) > 0)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def exploded_targets(df: DataFrame, ids: str, key: Sequence[str], order: str, name: str = "target") -> DataFrame:
    """One row for each record and distinct target; of equal (target, key) the first in order."""
    rows = df.withColumn(name, F.explode(F.array_distinct(ids)))
    return first_wins(rows, [name, *key], [order])


def spans_to_positions(offsets: Column, start: Column, end: Column) -> Column:
    """Positions of the tokens (structs of start and end) that overlap a span."""
    marked = F.transform(offsets, lambda o, i: F.when((o["start"] < end) & (o["end"] > start), i))
    return F.array_compact(marked)


def prompt_variants(df: DataFrame, segments: Mapping[str, Sequence[Column]], sep: str = "\n") -> DataFrame:
    """One row for each variant: its segments joined; empty ones leave no separator."""
    cells = [F.struct(F.lit(k).alias("variant"), F.array_join(F.filter(F.array(*v), lambda x: x.isNotNull() & (x != "")), sep).alias("prompt")) for k, v in segments.items()]
    return df.withColumn("__v", F.explode(F.array(*cells))).select(*df.columns, "__v.*")


def _decoded(raw: bytes | None) -> str | None:
    import gzip
    import re
    import zlib

    if raw is None:
        return None
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    elif raw[:1] == b"\x78":
        try:
            raw = zlib.decompress(raw)
        except zlib.error:
            pass
    named = re.search(rb"charset=[\"']?([A-Za-z0-9_-]+)", raw[:4096])
    for charset in [*([named[1].decode("ascii")] if named else []), "utf-8", "gb18030"]:
        try:
            return raw.decode(charset)
        except (UnicodeDecodeError, LookupError):
            continue
    return raw.decode("utf-8", "replace")


@F.pandas_udf(StringType())
def decoded(raw: pd.Series) -> pd.Series:
    """Bytes of a page as text: unpacked, by the charset that it names, else UTF-8, else GB 18030."""
    return raw.map(_decoded)


def diverse(df: DataFrame, by: str, key: str, tokens: str, score: str, quota: int) -> DataFrame:
    """(by, key, place): farthest first within each group: the best score, then whichever overlaps least with those chosen.

    Exact over all rows of a group: each pick is a grouped minimum, after which every row's largest overlap with the
    chosen ones is brought up to date against the last pick and written.  No group is ever gathered.
    """
    words = F.array_distinct(F.coalesce(F.col(tokens), F.array().cast(df.schema[tokens].dataType)))
    left = settle(df.select(F.col(by).alias("__by"), F.col(key).alias("__key"), words.alias("__w"), F.coalesce(-F.col(score), F.lit(float("inf"))).alias("__s"), F.lit(0.0).alias("__near")))
    chosen = []
    for place in range(1, quota + 1):
        pick = left.groupBy("__by").agg(F.min(F.struct("__near", "__s", "__key", "__w")).alias("p"))
        pick = settle(pick.select(F.col("__by").alias("__g"), F.col("p.__key").alias("__k"), F.col("p.__w").alias("__o")))
        groups = pick.limit(10_001).count()
        if not groups:
            break
        chosen.append(pick.select(F.col("__g").alias(by), F.col("__k").alias(key), F.lit(place).alias("place")))
        if place < quota:
            last = F.broadcast(pick) if groups <= 10_000 else pick
            rows = left.join(last, F.col("__by").eqNullSafe(F.col("__g"))).where(~F.col("__key").eqNullSafe(F.col("__k")))
            least = F.least(F.size("__w"), F.size("__o"))
            overlap = F.when(least > 0, F.size(F.array_intersect("__w", "__o")) / least).otherwise(F.lit(0.0))
            left = settle(rows.select(*[c for c in left.columns if c != "__near"], F.greatest("__near", overlap).alias("__near")))
    none = df.select(by, key, F.lit(0).alias("place")).limit(0)
    return reduce(DataFrame.unionByName, chosen, none)
