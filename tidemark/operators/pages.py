"""What a page is: its date by the best source, its quality, its text without header and layout."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import SPACE, occurrences

#: Meta names that hold a date, in order of trust.
DATE_META = ("article:published_time", "bytedance:published_time", "publishdate", "pubdate", "date", "datepublished")
#: How dates are written in texts and in urls.
DATE_TEXT = r"(?:20\d{2}年\s*\d{1,2}月\s*\d{1,2}日(?:[^0-9]{0,12}\d{1,2}:\d{2}(?::\d{2})?)?|20\d{2}[-/]\d{1,2}[-/]\d{1,2}(?:[ T]\d{1,2}:\d{2}(?::\d{2})?(?:[+-]\d{2}:?\d{2})?)?)"
DATE_URL = r"/(20\d{2})[-_/](\d{1,2})[-_/](\d{1,2})"
#: Marks of navigation pages in titles and texts, and paths of old articles.
NAVIGATION_TITLES = ("新浪财经_", "股票首页", "港股|港股行情", "美股|美股行情", "新浪期货_", "新浪外汇_", "财经面对面_", "ESG|", "股票博客", "意见领袖", "财经会议", "个人理财", "银行_", "保险频道", "新浪信托")
NAVIGATION_WORDS = ("财经首页", "新浪首页", "财经导航", "行情中心", "登录", "注册", "自选股", "基金", "外汇", "期货", "股票行情")
OLD_PATHS = ("/t/", "/s/", "/e/", "/y/", "/o/", "/j/", "/view/", "/roll/", "/stock/t/", "/stock/s/", "/stock/e/", "/stock/y/", "/globe/")
#: Page marks, viewer notices, tags and links that layout removal replaces by a space, in this order.
LAYOUT = (
    r"第\s*\d+\s*页\s*(?:共\s*\d+\s*页)?|第\s*\d+\s*/\s*\d+\s*页",
    r"当前浏览器不支持在线预览PDF文件|请升级IE版本后刷新阅读|移步下载|公告下载|浏览收藏",
    r"(?i)</?(?:p|br|div|span|table|tr|td|th|html|body|font|strong|b|i|u)(?:\s[^>]*)?>",
    r"(?i)(?:https?://|www\.)\S+",
)


def dated(meta: Column, title: Column, body: Column, visible: Column, url: Column) -> Column:
    """(raw, at, day, year, source, confidence): the date by meta data, title, body's start, text or url, in that order.

    ``at`` is ISO text with a +08:00 offset, midnight without a time; all but the confidence are NULL without a date.
    """
    found = lambda c: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), DATE_TEXT, 0), F.lit(""))
    told = F.coalesce(*[F.nullif(F.try_element_at(meta, F.lit(k)), F.lit("")) for k in DATE_META])
    path = F.nullif(F.concat_ws("-", *[F.nullif(F.regexp_extract(F.coalesce(url, F.lit("")), DATE_URL, i), F.lit("")) for i in (1, 2, 3)]), F.lit(""))
    steps = (("meta", told, 1.0), ("title", found(title), 0.9), ("body_front", found(F.left(F.coalesce(body, F.lit("")), F.lit(1200))), 0.85), ("visible_text", found(visible), 0.75), ("url", path, 0.55))
    best = F.coalesce(*[F.when(c.isNotNull(), F.struct(c.alias("raw"), F.lit(n).alias("source"), F.lit(x).alias("confidence"))) for n, c, x in steps])
    tidy = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(best["raw"]), "[年月]", "-"), "日", ""), SPACE, " ")
    part = lambda i: F.regexp_extract(tidy, r"(20\d{2})[-/]([0-9]{1,2})[-/]([0-9]{1,2})(?:[ T]+([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?)?", i)
    day = F.when(part(1) != "", F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")))
    clock = F.when(part(4) != "", F.concat(F.lpad(part(4), 2, "0"), F.lit(":"), part(5), F.lit(":"), F.when(part(6) == "", "00").otherwise(part(6)))).otherwise("00:00:00")
    return F.struct(best["raw"].alias("raw"), F.concat(day, F.lit("T"), clock, F.lit("+08:00")).alias("at"), day.alias("day"), F.left(day, F.lit(4)).cast("int").alias("year"), best["source"].alias("source"), F.coalesce(best["confidence"], F.lit(0.0)).alias("confidence"))


def body_quality(url: Column, title: Column, body: Column, in_article: Column, year: Column, least: int) -> Column:
    """too_short, navigation_only, low_quality (no year) or valid; ``in_article``: the page marks an article region."""
    low_title, low_body = F.lower(F.trim(F.coalesce(title, F.lit("")))), F.lower(F.coalesce(body, F.lit("")))
    path = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1))
    menu, old, hits = F.lit(False), F.lit(False), F.lit(0)
    for m in NAVIGATION_TITLES:
        menu = menu | F.contains(low_title, F.lit(m.lower()))
    for p in OLD_PATHS:
        old = old | path.startswith(p)
    for w in NAVIGATION_WORDS:
        hits = hits + occurrences(low_body, w.lower())
    crowded = ~F.coalesce(in_article, F.lit(False)) & (hits >= 4) & ~old
    return F.when(F.char_length(F.coalesce(body, F.lit(""))) < least, "too_short").when(menu | crowded, "navigation_only").when(F.coalesce(year, F.lit(0)) == 0, "low_quality").otherwise("valid")


def without_layout(text: Column) -> Column:
    """The text without page marks, viewer notices, tags, links and any white space; NULL is empty."""
    value = F.coalesce(text, F.lit(""))
    for pattern in LAYOUT:
        value = F.regexp_replace(value, f"(?U){pattern}", " ")
    return F.regexp_replace(F.regexp_replace(value, "[　﻿�]", " "), SPACE, "")


def trim_header(title: Column, body: Column, trail: str, promos: Sequence[str], reach: int = 800) -> Column:
    """The body without what a page puts before it.

    Where the breadcrumb ``trail`` stands in the first ``reach`` characters, the text starts after the last title there, or
    at the first date if no title is.  Then leading promotions go, however many follow each other: a repeated group
    is its own fixed point.
    """
    head = F.left(body, F.lit(reach))
    name = F.nullif(title, F.lit(""))
    last = F.char_length(head) - F.coalesce(F.instr(F.reverse(head), F.reverse(name)), F.lit(0)) + 1
    after = F.when(F.contains(head, name), F.substring(body, last + 1, F.char_length(body)))
    before_date = F.char_length(F.regexp_extract(head, rf"(?s)^(.*?){DATE_TEXT}", 1))
    at_date = F.when(F.regexp_like(head, F.lit(DATE_TEXT)), F.substring(body, before_date + 1, F.char_length(body)))
    cut = F.when(F.contains(head, F.lit(trail)), F.coalesce(after, at_date, body)).otherwise(body)
    cut = F.regexp_replace(cut, r"(?U)^\s+", "")
    return F.regexp_replace(cut, r"(?U)^(?:(?:" + "|".join(promos) + r")\s*)+", "") if promos else cut


def literal(*phrases: str) -> list[str]:
    """Phrases as patterns."""
    return [re.escape(p) for p in phrases]
