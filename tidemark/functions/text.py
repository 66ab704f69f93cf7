"""Text expressions.  All are built in but the three that need Unicode tables or an HTML parser, which are Arrow UDFs."""

from __future__ import annotations

import functools
import html
import re
import unicodedata
from collections.abc import Iterable, Mapping
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

#: The financial word lists, whose counts must equal those of other implementations.
LEXICON: dict[str, tuple[str, ...]] = {
    "positive": ("上涨", "增长", "利好", "超预期", "盈利", "突破", "增持", "回升", "改善", "上调", "高于预期", "业绩预增", "扭亏", "订单增加", "获奖", "回购", "分红", "扩张", "创新高", "景气", "复苏", "强劲", "领先"),
    "negative": ("下跌", "下降", "亏损", "利空", "风险", "暴跌", "减持", "回落", "恶化", "下调", "低于预期", "业绩预亏", "亏损扩大", "订单减少", "减值", "违约", "退市", "暂停上市", "大幅下滑", "大幅下降", "承压", "疲软"),
    "risk": ("风险", "风险提示", "重大风险", "经营风险", "市场风险", "信用风险", "流动性风险", "减值", "质押", "担保", "违约", "处罚", "监管措施", "退市风险", "商誉减值", "无法保证"),
    "uncertainty": ("可能", "或许", "不确定", "预计", "预期", "大概", "或将", "尚未确定", "存在不确定性", "不排除", "难以判断", "取决于", "有待观察"),
    "litigious": ("诉讼", "仲裁", "纠纷", "违法", "违规", "处罚", "被调查", "立案", "问询函", "监管函", "行政处罚"),
    "constraining": ("限制", "禁止", "约束", "监管", "冻结", "暂停", "终止", "延期", "无法", "不利影响", "受限"),
}
#: Words that negate a phrase right before it.
NEGATIONS = ("不", "未", "无", "没有", "并非", "并未", "否认", "尚无")
#: Contractions, in the order in which they are expanded.
CONTRACTIONS = (("can't", "cannot"), ("won't", "will not"), ("n't", " not"), ("'re", " are"), ("'ve", " have"), ("'ll", " will"), ("'d", " would"), ("'m", " am"), ("'s", " is"))
#: Token-exact word lists.
TOKEN_LEXICON: dict[str, tuple[str, ...]] = {
    "positive": ("增长", "上涨", "盈利", "利好", "改善", "增持", "突破"),
    "negative": ("下降", "下跌", "亏损", "利空", "风险", "减持", "违约"),
    "uncertainty": ("可能", "或许", "不确定", "风险", "预计", "大概"),
    "litigious": ("诉讼", "仲裁", "纠纷", "违法", "处罚"),
    "constraining": ("限制", "禁止", "约束", "监管", "冻结"),
}

SPACE = r"(?U)\s+"


@functools.cache
def _unpunctuated() -> re.Pattern[str]:
    """Runs of characters that are no punctuation, by Unicode category."""
    return re.compile("[^" + "".join(re.escape(chr(c)) for c in range(0x110000) if unicodedata.category(chr(c))[0] == "P") + "]+")


def normal_forms(value: str) -> str:
    """NFKC of each character, but punctuation stays as it is."""
    return _unpunctuated().sub(lambda run: "".join(unicodedata.normalize("NFKC", c) for c in run[0]), value)


@F.pandas_udf(StringType())
def _unicode(text: pd.Series) -> pd.Series:
    return text.map(lambda v: None if v is None else html.unescape(normal_forms(v)))


#: What cleaning replaces, in this order: links, tags, invisible characters, control characters.
CLEANING = (
    (r"(?i)(?:https?://|www\.)[^\s]+", " "),
    (r"<[^>]+>", " "),
    (r"[\u200b-\u200f\u202a-\u202e\u2060\ufeff]", ""),
    (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", ""),
)


def clean(text: Column, unicode: bool = True) -> Column:
    """One clean line: forms, entities, links, tags, invisible and control characters, white space; NULL is empty.

    ``unicode=False`` stays in the engine: it skips normal forms and entities.
    """
    value = F.coalesce(text, F.lit(""))
    value = _unicode(value) if unicode else value
    for pattern, to in (*CLEANING, (SPACE, " ")):
        value = F.regexp_replace(value, pattern, to)
    return F.trim(value)


def combine(title: Column, body: Column) -> Column:
    both = F.concat(F.lit("标题："), title, F.lit("。正文："), body)
    return F.when((title != "") & (body != ""), both).when(title != "", title).otherwise(body)


def occurrences(text: Column, phrase: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(phrase), F.lit("")))) / len(phrase)).cast("int")


def phrase_count(text: Column, phrases: Iterable[str]) -> Column:
    total = F.lit(0)
    for p in phrases:
        total = total + occurrences(text, p)
    return total


def negated_count(text: Column, phrases: Iterable[str], negations: Iterable[str] = NEGATIONS) -> Column:
    """Phrases with a negation right before them."""
    before = "|".join(re.escape(n) for n in sorted(negations, key=len, reverse=True))
    total = F.lit(0)
    for p in phrases:
        total = total + F.regexp_count(text, F.lit(f"(?<={before}){re.escape(p)}"))
    return total


def lexicon_features(text: Column, lexicon: Mapping[str, Iterable[str]] | None = None, negations: Iterable[str] = NEGATIONS) -> dict[str, Column]:
    """Counts and rates by category, and scores with and without negation."""
    lexicon = lexicon or LEXICON
    tokens = F.greatest(F.regexp_count(text, F.lit("[一-鿿]+|[A-Za-z]+(?:\\.[A-Za-z]+)?|[0-9]+(?:\\.[0-9]+)?%?")), F.lit(1))
    out: dict[str, Column] = {"word_count": tokens, "char_count": F.char_length(text)}
    for name, words in lexicon.items():
        out[f"{name}_count"] = phrase_count(text, words)
        out[f"{name}_rate"] = out[f"{name}_count"] / tokens
    pos, neg = out["positive_count"], out["negative_count"]
    no_pos, no_neg = negated_count(text, lexicon["positive"], negations), negated_count(text, lexicon["negative"], negations)
    adj_pos, adj_neg = F.greatest(pos - no_pos, F.lit(0)), F.greatest(neg - no_neg, F.lit(0))
    return out | {"negated_positive_count": no_pos, "negated_negative_count": no_neg, "adjusted_positive_count": adj_pos, "adjusted_negative_count": adj_neg, "adjusted_score": (adj_pos - adj_neg) / tokens, "score": (pos - neg) / tokens}


def expand_contractions(text: Column) -> Column:
    for old, new in CONTRACTIONS:
        text = F.regexp_replace(text, f"(?i){re.escape(old)}", new)
    return text


def word_model_text(text: Column) -> Column:
    value = F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(F.lower(expand_contractions(value)), SPACE, " "))


def words(text: Column, stops: Iterable[str] = ()) -> Column:
    """Latin words and runs of CJK characters; a dictionary segmenter may cut the runs (see max_match)."""
    found = F.regexp_extract_all(word_model_text(text), F.lit("[A-Za-z]+(?:'[A-Za-z]+)?|[一-鿿]+"), 0)
    stops = list(stops)
    return F.filter(found, lambda w: ~w.isin(stops)) if stops else found


def max_match(run: str, vocabulary: frozenset[str], longest: int) -> list[str]:
    """Greedy longest match from the left; characters in no word stand alone."""
    out, at = [], 0
    while at < len(run):
        size = next((n for n in range(min(longest, len(run) - at), 1, -1) if run[at : at + n] in vocabulary), 1)
        out.append(run[at : at + size])
        at += size
    return out


def segmenter(vocabulary: Iterable[str]):
    """An Arrow UDF from an array of words to one with the CJK runs cut at dictionary words."""
    known = frozenset(vocabulary)
    longest = max(map(len, known), default=1)

    @F.pandas_udf(ArrayType(StringType()))
    def cut(column: pd.Series) -> pd.Series:
        return column.map(lambda ws: None if ws is None else [p for w in ws for p in (max_match(w, known, longest) if "一" <= w[0] <= "鿿" else [w])])

    return cut


def token_lexicon(tokens: Column, lexicon: Mapping[str, Iterable[str]] | None = None) -> dict[str, Column]:
    """Token-exact counts; a word in two categories counts in both."""
    lexicon = lexicon or TOKEN_LEXICON
    listed = lambda words: F.size(F.filter(tokens, lambda w: w.isin(list(words))))
    out = {f"{k}_count": listed(v) for k, v in lexicon.items()}
    total = F.greatest(F.size(tokens), F.lit(1))
    return out | {"word_count": F.size(tokens), "token_score": (out["positive_count"] - out["negative_count"]) / total}


def title_key(title: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^0-9a-z一-鿿]+", "")


def drop_lines(text: Column, prefixes: Iterable[str]) -> Column:
    """The text without lines that start with one of the prefixes, or are empty."""
    starts = list(prefixes)

    def kept(line: Column) -> Column:
        bad = F.trim(line) == ""
        for p in starts:
            bad = bad | F.trim(line).startswith(p)
        return ~bad

    return F.array_join(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), kept), "\n")


def cut_footer(text: Column, markers: Iterable[str], after: int = 0) -> Column:
    """The text up to the earliest marker that stands past ``after`` characters."""
    places = [F.nullif(F.instr(text, m), F.lit(0)) for m in markers]
    first = F.array_min(F.array(*[F.when(p > after, p) for p in places]))
    return F.when(first.isNotNull(), F.rtrim(F.substring(text, F.lit(1), F.greatest(first - 1, F.lit(0))))).otherwise(text)


def body_lines(text: Column, skip: Iterable[str], stops: Iterable[str]) -> Column:
    """Lines up to the first that starts with a stop, without those in ``skip``."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), F.trim)

    def ends(line: Column) -> Column:
        hit = F.lit(False)
        for s in stops:
            hit = hit | line.startswith(s)
        return hit

    marks = F.array_position(F.transform(lines, ends), True)
    kept = F.when(marks > 0, F.slice(lines, F.lit(1), F.greatest(marks - 1, F.lit(0)).cast("int"))).otherwise(lines)
    return F.array_join(F.filter(kept, lambda x: (x != "") & ~x.isin(list(skip))), "\n")


def unwrap_lines(text: Column) -> Column:
    """Joins wrapped lines to paragraphs: a line that doesn't end a sentence takes the next; one pass of a fold."""
    done = r"[.!?:;。！？：；]$"

    def step(acc: Column, line: Column) -> Column:
        value = F.trim(line)
        return F.when(value == "", acc).when(acc == "", value).when(acc.rlike(done), F.concat(acc, F.lit("\n"), value)).otherwise(F.concat(acc, F.lit(" "), value))

    return F.aggregate(F.split(F.coalesce(text, F.lit("")), "\n"), F.lit(""), step)


def quality_flags(text: Column) -> dict[str, Column]:
    """Counts of character classes and whether most of a text is neither letters nor digits."""
    n = F.char_length(text)
    cells = {"letters": r"(?U)\p{L}", "digits": r"(?U)\p{Nd}", "spaces": r"(?U)\s", "replacement": "�"}
    out = {k: F.regexp_count(text, F.lit(v)) for k, v in cells.items()}
    return out | {"chars": n, "odd_share": F.when(n > 0, (n - out["letters"] - out["digits"] - out["spaces"]) / n).otherwise(0.0)}


def resolve_time(text: Column, zone: str = "+08:00") -> Column:
    """ISO or Chinese dates, with or without a time and offset, as an instant; NULL if it is none of these."""
    raw = F.regexp_replace(F.regexp_replace(F.trim(text), "[年月/]", "-"), "日", "")
    has_zone = raw.rlike(r"(Z|[+-]\d{2}:\d{2})$")
    padded = F.regexp_replace(F.regexp_replace(raw, r"^(\d{4})-(\d)-", "$1-0$2-"), r"^(\d{4}-\d{2})-(\d)(?!\d)", "$1-0$2")
    padded = F.regexp_replace(F.replace(padded, F.lit("T"), F.lit(" ")), r"^(\d{4}-\d{2}-\d{2}) (\d):", "$1 0$2:")
    full = F.when(padded.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(padded, F.lit(" 00:00"))).otherwise(padded)
    return F.coalesce(*[F.try_to_timestamp(F.when(has_zone, full).otherwise(F.concat(full, F.lit(zone))), F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ssXXX", "yyyy-MM-dd HH:mmXXX", "yyyy-MM-dd HH:mm:ss.SSSXXX", "yyyy-MM-dd HH:mm:ss.SSSSSSXXX")])


def date_precision(text: Column) -> Column:
    return F.when(text.rlike(r"\d{1,2}:\d{2}"), "minute").when(text.rlike(r"\d{4}\D\d{1,2}\D\d{1,2}"), "date").otherwise("unknown")


def after_close(at: Column, precision: Column, hour: int = 15) -> Column:
    """At or after the close; only times to the minute can tell."""
    return F.when(precision == "minute", F.hour(at) >= hour)


#: The marks, the form of a legal company name, and the classes of time that masking replaces, in this order.
SUBJECT_MASK = "某公司"
TIME_MASK = "某时间"
COMPANY_NAME = r"[\u4e00-\u9fffA-Za-z0-9（）()·]{2,50}(?:股份有限公司|有限责任公司|有限公司)"
TIME_PATTERNS = (
    r"[〇○零一二三四五六七八九十百]{4}\s*年\s*(?:[〇○零一二三四五六七八九十百]{1,3}\s*月(?:\s*[〇○零一二三四五六七八九十百]{1,3}\s*日?)?)?",
    r"(?<!\d)(?:19|20)\d{2}\s*[年./-]\s*\d{1,2}\s*[月./-]\s*\d{1,2}\s*日?",
    r"(?<!\d)(?:19|20)\d{2}\s*年\s*\d{1,2}\s*月",
    r"(?<!\d)(?:19|20)\d{2}\s*(?:年|年度|财年)",
    r"(?<!\d)\d{1,2}\s*月\s*\d{1,2}\s*日",
    r"(?<!\d)\d{1,2}\s*[时:]\s*\d{2}\s*分?",
    r"第[一二三四1-4]季度|上半年|下半年|年初|年末|年底",
)


def mask(text: str, name: str | None = None, code: str | None = None, most: int = 1000) -> str:
    """A subject's name and code, legal company names and times replaced until nothing changes.

    A replacement may uncover the next match; raises if that takes more than ``most`` rounds.  Names count from two
    characters on, as written and without their white space.
    """
    steps = [(re.escape(n), SUBJECT_MASK) for n in sorted({name or "", re.sub(r"\s+", "", name or "")}, key=lambda n: (-len(n), n)) if len(n) > 1]
    steps += [(rf"(?<!\d){re.escape(code)}(?!\d)", SUBJECT_MASK)] if code else []
    rules = [(re.compile(p), to) for p, to in (*steps, (COMPANY_NAME, SUBJECT_MASK), *((p, TIME_MASK) for p in TIME_PATTERNS))]
    for _ in range(most):
        before = text
        for pattern, to in rules:
            text = pattern.sub(to, text)
        if text == before:
            return text
    raise ValueError("masking did not settle")


@F.pandas_udf(StringType())
def masked(text: pd.Series, name: pd.Series, code: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else mask(t, n, c) for t, n, c in zip(text, name, code, strict=True)])


def leaks(name: Column, code: Column, fields: Mapping[str, tuple[Column, Column]]) -> dict[str, Column]:
    """For each class of identity and time whether a masked field still shows it, and whether each field was masked.

    ``fields``: name of a field to its (original, masked) columns.  Fields are looked at one by one, so joining them
    makes no false date.  All classes are built-in expressions.
    """
    hidden = [F.coalesce(m, F.lit("")) for _, m in fields.values()]
    bare = F.regexp_replace(F.coalesce(name, F.lit("")), SPACE, "")
    anywhere = lambda test: reduce(lambda a, b: a | b, [test(m) for m in hidden])
    wide = lambda p: F.lit(f"(?U){p}")
    named = (F.char_length(bare) >= 2) & (bare != SUBJECT_MASK)
    coded = F.concat(F.lit(r"(?U)(?<!\d)\Q"), code, F.lit(r"\E(?!\d)"))
    out = {
        "stock_name_remaining": named & anywhere(lambda m: F.contains(F.regexp_replace(m, SPACE, ""), bare)),
        "stock_code_remaining": F.coalesce((code != "") & anywhere(lambda m: F.regexp_like(m, coded)), F.lit(False)),
        "legal_company_name_remaining": anywhere(lambda m: F.regexp_like(m, wide(COMPANY_NAME))),
        "calendar_date_remaining": anywhere(lambda m: F.regexp_like(m, wide("|".join(f"(?:{p})" for p in TIME_PATTERNS)))),
    }
    return out | {f"{k}_was_masked": F.coalesce(m, F.lit("")) != F.coalesce(o, F.lit("")) for k, (o, m) in fields.items()}


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.text, self.body, self.links, self.meta = [], [], [], [], {}
        self.skip, self.side, self.stack = 0, 0, []

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        if tag == "a" and own.get("href"):
            self.links.append(own["href"])
        if tag == "meta" and own.get("content") and (key := own.get("name") or own.get("property")):
            self.meta[key.lower()] = own["content"].strip()
        if tag in ("meta", "br", "img", "input", "link", "hr"):
            return
        side = tag in ("nav", "footer", "aside") or re.search(r"nav|comment|advert|recommend|footer|sidebar|login|toolbar", f"{own.get('id') or ''} {own.get('class') or ''}", re.I)
        self.stack.append((tag, tag in ("script", "style", "noscript", "template"), bool(side)))
        self.skip += self.stack[-1][1]
        self.side += self.stack[-1][2]

    def handle_endtag(self, tag):
        if any(t == tag for t, *_ in self.stack):
            while self.stack:
                t, skip, side = self.stack.pop()
                self.skip -= skip
                self.side -= side
                if t == tag:
                    break

    def handle_data(self, data):
        value = re.sub(r"\s+", " ", data).strip()
        if self.skip or not value:
            return
        if self.stack and self.stack[-1][0] == "title":
            self.title.append(value)
            return
        self.text.append(value)
        if not self.side:
            self.body.append(value)


PAGE = StructType([*(StructField(c, StringType()) for c in ("title", "text", "body")), StructField("links", ArrayType(StringType())), StructField("meta", MapType(StringType(), StringType()))])


@F.pandas_udf(PAGE)
def parse_html(pages: pd.Series) -> pd.DataFrame:
    out = []
    for page in pages:
        p = _Page()
        p.feed(page or "")
        p.close()
        out.append((" ".join(p.title), " ".join(p.text), " ".join(p.body), p.links, p.meta))
    return pd.DataFrame(out, columns=["title", "text", "body", "links", "meta"])


#: Query parameters that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "spm", "from", "ref")


def normal_url(url: Column, tracking: Iterable[str] = TRACKING) -> Column:
    """Scheme and host in lower case, no fragment, no tracking parameters, "/" for no path; NULL unless http(s)."""
    bare = F.regexp_replace(url, "#.*$", "")
    scheme, rest = F.lower(F.regexp_extract(bare, r"^(?i)(https?)://", 1)), F.regexp_replace(bare, r"^(?i)https?://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?]*(/[^?]*)", 1)
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    names = list(tracking)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.split(p, "=")[0]).isin(names))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(scheme != "", F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), tail))


def url_id(url: Column, size: int = 24) -> Column:
    return F.left(F.sha2(url, 256), F.lit(size))


def contains_code(text: Column, code: Column) -> Column:
    """The digits of ``code`` stand in the text with no digit on either side."""
    return F.regexp_like(text, F.concat(F.lit(r"(?<!\d)\Q"), code, F.lit(r"\E(?!\d)")))


def codes_in(text: Column, digits: int = 6) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?<![0-9])[0-9]{{{digits}}}(?![0-9])"), 0))


def memory_gib(text: Column) -> Column:
    """'512M', '36G', '1.5T' or bare kilobytes, in GiB."""
    value, unit = F.regexp_extract(text, r"^([0-9.]+)", 1).try_cast("double"), F.upper(F.regexp_extract(text, r"([KMGTPkmgtp])", 1))
    power = F.when(unit == "M", 1).when(unit == "G", 2).when(unit == "T", 3).when(unit == "P", 4).otherwise(0)
    return value * F.pow(F.lit(1024.0), power) / 1024**2


def tfidf(df: DataFrame, key: str, tokens: Column, min_df: int = 1, max_terms: int | None = None, sublinear: bool = True) -> DataFrame:
    """(key, term, weight): (1 + ln tf) (ln((1 + n) / (1 + df)) + 1), each document at unit length.

    Long form: one row for each document and term, so no vocabulary is held in one place.
    """
    from pyspark.sql import Window

    each = df.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    docs = df.select(F.count(F.lit(1)).alias("n"))
    seen = each.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    if max_terms:
        seen = seen.orderBy(F.desc("df"), "term").limit(max_terms)
    tf = 1 + F.log(F.col("tf")) if sublinear else F.col("tf")
    rows = each.join(seen, "term").join(docs).withColumn("raw", tf * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    return rows.withColumn("weight", F.col("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))).select(key, "term", "weight")


def screening(df: DataFrame, key: str, tokens: Column, label: str, most: int = 500) -> DataFrame:
    """(term, gap): terms by the absolute gap of their share of words in the two classes."""
    each = df.select(label, F.explode(tokens).alias("term")).groupBy("term").agg(F.sum(F.col(label).cast("double")).alias("p"), F.sum(1 - F.col(label).cast("double")).alias("q"))
    total = each.agg(F.sum("p").alias("tp"), F.sum("q").alias("tq"))
    gap = F.col("p") / F.nullif("tp", F.lit(0.0)) - F.col("q") / F.nullif("tq", F.lit(0.0))
    return each.join(total).select("term", gap.alias("gap")).orderBy(F.desc(F.abs("gap")), "term").limit(most)
