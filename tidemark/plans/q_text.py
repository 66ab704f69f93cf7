"""Queries: text, deduplication, entities, vectors and learning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions import vectors as vx
from tidemark.operators import dedup, entities, learning
from tidemark.plans.base import query, r6, signals, table

_TITLE = "docs AS (SELECT doc_id, text, lang, source, string_split(text, chr(10))[1] AS title FROM documents)"


def docs(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, text, lang, source, title): the first line is the title."""
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source", F.split("text", "\n")[0].alias("title"))


# ---- text ------------------------------------------------------------------------------------------------------


@query("x_clean", r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(https?://|www\.)[^\s]+', ' ', 'gi'), '<[^>]+>', ' ', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '\s+', ' ', 'g')) AS clean FROM pages")
def x_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", tx.clean(F.col("html"), unicode=False).alias("clean"))


@query("x_clean_unicode")
def x_clean_unicode(spark: SparkSession, d: str) -> DataFrame:
    """Normal forms and entities need Unicode tables that DuckDB lacks; tests hold them against the standard library."""
    return table(spark, d, "pages").select("page_id", tx.clean(F.col("html")).alias("clean"))


@query("x_combine", f"WITH {_TITLE}, c AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE title END AS t, CASE WHEN doc_id % 7 = 0 THEN '' ELSE substr(text, length(title) + 2) END AS b FROM docs) SELECT doc_id, sha256(CASE WHEN t <> '' AND b <> '' THEN '标题：' || t || '。正文：' || b WHEN t <> '' THEN t ELSE b END) AS text_hash FROM c")
def x_combine(spark: SparkSession, d: str) -> DataFrame:
    t = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("title"))
    b = F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.substring("text", F.char_length("title") + 2, F.char_length("text")))
    return docs(spark, d).select("doc_id", F.sha2(tx.combine(t, b), 256).alias("text_hash"))


@query("x_lexicon", r"SELECT doc_id, ((length(text) - length(replace(text, 'the', ''))) / 3 + (length(text) - length(replace(text, 'an', ''))) / 2)::INT AS positive_count, ((length(text) - length(replace(text, 'er', ''))) / 2)::INT AS negative_count, greatest(len(regexp_extract_all(text, '[一-鿿]+|[A-Za-z]+(?:\.[A-Za-z]+)?|[0-9]+(?:\.[0-9]+)?%?')), 1)::INT AS word_count, round((((length(text) - length(replace(text, 'the', ''))) / 3 + (length(text) - length(replace(text, 'an', ''))) / 2) - (length(text) - length(replace(text, 'er', ''))) / 2) / greatest(len(regexp_extract_all(text, '[一-鿿]+|[A-Za-z]+(?:\.[A-Za-z]+)?|[0-9]+(?:\.[0-9]+)?%?')), 1), 6) + 0 AS score FROM documents")
def x_lexicon(spark: SparkSession, d: str) -> DataFrame:
    cells = tx.lexicon_features(F.col("text"), {"positive": ("the", "an"), "negative": ("er",)}, ("of",))
    return docs(spark, d).select("doc_id", *[cells[c].alias(c) for c in ("positive_count", "negative_count", "word_count")], r6(cells["score"]).alias("score"))


@query("x_lexicon_negation", "SELECT doc_id, len(regexp_extract_all(text, 'ofthe'))::INT + len(regexp_extract_all(text, 'ofan'))::INT AS negated_positive_count, len(regexp_extract_all(text, 'ofer'))::INT AS negated_negative_count FROM documents")
def x_lexicon_negation(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    return docs(spark, d).select("doc_id", tx.negated_count(c, ("the", "an"), ("of",)).alias("negated_positive_count"), tx.negated_count(c, ("er",), ("of",)).alias("negated_negative_count"))


@query("x_contractions", "SELECT item_id, regexp_replace(regexp_replace(regexp_replace('Can''t stop; I''ll say they''re ' || text || '''s', 'can''t', 'cannot', 'gi'), '''re', ' are', 'gi'), '''ll', ' will', 'gi') AS partly FROM benchmark")
def x_contractions(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("Can't stop; I'll say they're "), "text", F.lit("'s"))
    full = tx.expand_contractions(raw)
    return table(spark, d, "benchmark").select("item_id", F.concat(F.regexp_replace(full, " is$", ""), F.lit("'s")).alias("partly"))


def _expanded(text: str) -> str:
    """The SQL that expands contractions in markup-free, lower-case text."""
    sql = f"regexp_replace(coalesce({text}, ''), '<[^>]+>', ' ', 'g')"
    for old, new in tx.CONTRACTIONS:
        sql = f"regexp_replace({sql}, '{old.replace(chr(39), chr(39) * 2)}', '{new}', 'gi')"
    return f"lower({sql})"


_APOSTROPHES = "coalesce(text, '') || ' It''s <b>what</b> they''re saying: he can''t, o''clock'"


@query("x_tokens", rf"WITH w AS (SELECT doc_id, regexp_extract_all({_expanded(_APOSTROPHES)}, '[a-z]+(?:''[a-z]+)?|[一-鿿]+') AS w FROM documents) SELECT doc_id, len(w)::INT AS n_tokens, sha256(array_to_string(w, ' ')) AS tokens FROM w")
def x_tokens(spark: SparkSession, d: str) -> DataFrame:
    more = F.concat(F.coalesce("text", F.lit("")), F.lit(" It's <b>what</b> they're saying: he can't, o'clock"))
    rows = docs(spark, d).select("doc_id", tx.words(more).alias("w"))
    return rows.select("doc_id", F.size("w").alias("n_tokens"), F.sha2(F.array_join("w", " "), 256).alias("tokens"))


@query("x_token_lexicon", r"WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents) SELECT doc_id, len(list_filter(w, lambda x: x IN ('the', 'and')))::INT AS positive_count, len(list_filter(w, lambda x: x IN ('of', 'the')))::INT AS negative_count FROM w")
def x_token_lexicon(spark: SparkSession, d: str) -> DataFrame:
    rows = docs(spark, d).select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0).alias("w"))
    cells = tx.token_lexicon(F.col("w"), {"positive": ("the", "and"), "negative": ("of", "the")})
    return rows.select("doc_id", cells["positive_count"].alias("positive_count"), cells["negative_count"].alias("negative_count"))


@query("x_bigrams", f"WITH {_TITLE}, k AS (SELECT doc_id, regexp_replace(lower(title), '[^0-9a-z]+', '', 'g') AS k FROM docs), b AS (SELECT doc_id, k, CASE WHEN length(k) >= 2 THEN list_distinct(list_transform(range(1, length(k)), lambda i: substr(k, i, 2))) WHEN length(k) = 1 THEN [k] ELSE [] END AS g FROM k) SELECT doc_id, k AS title_key, len(g)::INT AS n_bigrams FROM b")
def x_bigrams(spark: SparkSession, d: str) -> DataFrame:
    rows = docs(spark, d).select("doc_id", tx.title_key(F.col("title")).alias("title_key"))
    return rows.select("doc_id", "title_key", F.size(vx.bigrams(F.col("title_key"))).alias("n_bigrams"))


@query("x_url_norm", r"""WITH p AS (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS bare FROM pages), q AS (SELECT page_id, lower(regexp_extract(bare, '^(https?)://', 1)) AS scheme, lower(regexp_extract(bare, '^https?://([^/?]*)', 1)) AS host, regexp_extract(bare, '^https?://[^/?]*(/[^?]*)', 1) AS path, list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda x: x <> '' AND lower(string_split(x, '=')[1]) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'spm', 'from', 'ref')) AS kept FROM p),
 n AS (SELECT page_id, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url FROM q) SELECT page_id, url, left(sha256(url), 24) AS article_id FROM n""")
def x_url_norm(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select("page_id", tx.normal_url(F.col("url")).alias("url"))
    return rows.select("page_id", "url", tx.url_id(F.col("url")).alias("article_id"))


@query("x_html_title", r"SELECT page_id, replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&'), '&lt;', '<') AS title FROM pages")
def x_html_title(spark: SparkSession, d: str) -> DataFrame:
    raw = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, d, "pages").select("page_id", F.replace(F.replace(raw, F.lit("&amp;"), F.lit("&")), F.lit("&lt;"), F.lit("<")).alias("title"))


@query("x_html_parse")
def x_html_parse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", tx.parse_html("html").alias("p")).select("page_id", "p.title", F.char_length("p.body").alias("body_chars"), F.size("p.links").alias("n_links"), F.char_length("p.text").alias("text_chars"))


@query("x_quality_flags", r"SELECT doc_id, len(regexp_extract_all(text, '\p{L}'))::INT AS letters, len(regexp_extract_all(text, '\p{Nd}'))::INT AS digits, length(text)::INT AS chars FROM documents")
def x_quality_flags(spark: SparkSession, d: str) -> DataFrame:
    cells = tx.quality_flags(F.col("text"))
    return docs(spark, d).select("doc_id", *[cells[c].alias(c) for c in ("letters", "digits", "chars")])


@query("x_drop_lines", "WITH l AS (SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(trim(x), 'Licensed') AND NOT starts_with(trim(x), 'The')), chr(10)) AS t FROM documents) SELECT doc_id, sha256(t) AS kept FROM l")
def x_drop_lines(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.sha2(tx.drop_lines(F.col("text"), ("Licensed", "The")), 256).alias("kept"))


@query("x_cut_footer", "WITH p AS (SELECT doc_id, text, list_min(list_filter([strpos(text, 'Licensed under'), strpos(text, 'that the')], lambda x: x > 10)) AS p FROM documents) SELECT doc_id, length(CASE WHEN p IS NULL THEN text ELSE rtrim(left(text, p - 1), ' ') END)::INT AS chars FROM p")
def x_cut_footer(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.char_length(tx.cut_footer(F.col("text"), ("Licensed under", "that the"), after=10)).alias("chars"))


@query("x_unwrap_lines")
def x_unwrap_lines(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.sha2(tx.unwrap_lines(F.col("text")), 256).alias("paragraphs"))


@query("x_code_scan", "SELECT doc_id, len(list_distinct(regexp_extract_all(text, '[0-9]{4,}')))::INT AS n_codes FROM documents")
def x_code_scan(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.size(F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]{4,}"), 0))).alias("n_codes"))


@query("x_parse_time", "SELECT event_id, ts::TIMESTAMP AS at, CASE WHEN event_id % 3 = 2 THEN 'date' ELSE 'minute' END AS precision FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN date_trunc('second', ts) WHEN event_id % 3 = 1 THEN date_trunc('minute', ts) - INTERVAL 8 HOUR ELSE date_trunc('day', ts) - INTERVAL 8 HOUR END AS ts FROM events)")
def x_parse_time(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    raw = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy年M月d日 H:mm")).otherwise(F.date_format("ts", "yyyy/M/d"))
    return e.select("event_id", tx.resolve_time(raw).cast("timestamp_ntz").alias("at"), tx.date_precision(raw).alias("precision"))


#: What is put behind each eighth document's text: nothing, or one class of identity or time.
_SIGNS = ("", " 于2024年1月2日", " 二〇二四年三月", " 第三季度", " 上海东方股份有限公司", " (600519)", " 贵州 茅台", " 2023财年 12:30")


def _signed(spark: SparkSession, d: str) -> DataFrame:
    sign = F.element_at(F.array(*[F.lit(x) for x in _SIGNS]), (F.pmod("doc_id", F.lit(8)) + 1).cast("int"))
    return docs(spark, d).select("doc_id", "title", F.concat(F.coalesce("text", F.lit("")), sign).alias("body"), F.lit("贵州茅台").alias("name"), F.lit("600519").alias("code"))


@query("x_mask_fixpoint")
def x_mask_fixpoint(spark: SparkSession, d: str) -> DataFrame:
    """Repetition to a fixed point has no SQL form; tests hold the masks against literal cases of each class."""
    return _signed(spark, d).select("doc_id", F.sha2(tx.masked("body", "name", "code"), 256).alias("masked"))


_SIGNED = "s AS (SELECT doc_id, coalesce(text, '') || [" + ", ".join(f"'{x}'" for x in _SIGNS) + "][(((doc_id % 8) + 8) % 8 + 1)::INT] AS body FROM documents)"
_TIME_SQL = "|".join(f"(?:{p})" for p in tx.TIME_PATTERNS).replace(r"(?<!\d)", r"(?:^|[^\d])")


@query("x_leaks", rf"WITH {_SIGNED} SELECT doc_id, contains(regexp_replace(body, '\s+', '', 'g'), '贵州茅台') AS stock_name_remaining, regexp_matches(body, '(?:^|[^\d])600519(?:$|[^\d])') AS stock_code_remaining, regexp_matches(body, '{tx.COMPANY_NAME.replace(chr(92) + 'u4e00', '一').replace(chr(92) + 'u9fff', '鿿')}') AS legal_company_name_remaining, regexp_matches(body, '{_TIME_SQL}') AS calendar_date_remaining, false AS title_was_masked, doc_id % 8 <> 0 AS body_was_masked FROM s")
def x_leaks(spark: SparkSession, d: str) -> DataFrame:
    rows = _signed(spark, d).join(docs(spark, d).select("doc_id", F.coalesce("text", F.lit("")).alias("plain")), "doc_id")
    cells = tx.leaks(F.col("name"), F.col("code"), {"title": (F.col("title"), F.col("title")), "body": (F.col("plain"), F.col("body"))})
    return rows.select("doc_id", *[c.alias(k) for k, c in cells.items()])


@query("x_memory", "SELECT s_suppkey, round(CASE s_suppkey % 3 WHEN 0 THEN (s_suppkey + 1) / 1024 WHEN 1 THEN (s_suppkey + 1)::DOUBLE ELSE (s_suppkey + 1) / 1048576 END, 9) AS gib FROM supplier")
def x_memory(spark: SparkSession, d: str) -> DataFrame:
    n = (F.col("s_suppkey") + 1).cast("string")
    raw = F.when(F.col("s_suppkey") % 3 == 0, F.concat(n, F.lit("M"))).when(F.col("s_suppkey") % 3 == 1, F.concat(n, F.lit("g"))).otherwise(n)
    return table(spark, d, "supplier").select("s_suppkey", F.round(tx.memory_gib(raw), 9).alias("gib"))


_WORDS = r"w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents)"


def _words(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0).alias("w"))


@query("x_tfidf", f"WITH {_WORDS}, t AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents), f AS (SELECT term, count(*) AS df FROM t GROUP BY term HAVING count(*) >= 5), r AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS raw FROM t JOIN f USING (term), n) SELECT doc_id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) + 0 AS weight FROM r")
def x_tfidf(spark: SparkSession, d: str) -> DataFrame:
    return tx.tfidf(_words(spark, d), "doc_id", F.col("w"), min_df=5).select("doc_id", "term", r6("weight").alias("weight"))


@query("x_screening", f"WITH w AS (SELECT l.quality AS y, unnest(regexp_extract_all(lower(d.text), '[a-z]+')) AS term FROM documents d JOIN labels l USING (doc_id)), c AS (SELECT term, sum(y)::DOUBLE AS p, sum(1 - y)::DOUBLE AS q FROM w GROUP BY term), t AS (SELECT sum(p) AS tp, sum(q) AS tq FROM c), g AS (SELECT term, p / tp - q / tq AS gap FROM c, t) SELECT term, round(gap, 8) + 0 AS gap FROM g ORDER BY abs(gap) DESC, term LIMIT 50")
def x_screening(spark: SparkSession, d: str) -> DataFrame:
    rows = docs(spark, d).join(table(spark, d, "labels"), "doc_id").select("doc_id", "quality", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0).alias("w"))
    return tx.screening(rows, "doc_id", F.col("w"), "quality", 50).select("term", F.round("gap", 8).alias("gap"))


@query("x_contamination", "WITH b AS (SELECT item_id, text AS head FROM benchmark) SELECT b.item_id, count(d.doc_id) AS n_documents FROM b LEFT JOIN documents d ON contains(d.text, b.head) GROUP BY b.item_id")
def x_contamination(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark passages found whole in documents: runs of four words meet in a hash join, then the text is checked.

    Passages of less than six words may end inside the fifth, so they are looked for in every text.
    """
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("head"))
    texts = docs(spark, d).where("doc_id is not null").select("doc_id", "text")
    cut = lambda c: F.regexp_extract_all(c, F.lit(r"[^\x20\x09-\x0D]+"), 0)
    run = lambda w, i: F.xxhash64(*(F.get(w, i + j) for j in range(4)))
    long = F.coalesce(F.size(cut("head")), F.lit(0)) >= 6
    # the second to fifth words of a passage of six or more are whole words in any text that holds it
    probe = b.where(long).groupBy("item_id", "head").agg(F.count(F.lit(1)).alias("times")).withColumn("k", run(cut("head"), F.lit(1)))
    # words are a column of their own: a lambda would cut the text anew for each run; empty ends and short texts make runs that nothing meets
    words = texts.withColumn("w", F.split("text", r"[\x20\x09-\x0D]+"))
    runs = words.select("doc_id", "text", F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 4, F.lit(0))), lambda i: run(F.col("w"), i))).alias("ks"))
    each = F.explode_outer("ks").alias("k")  # the inner explode would get a filter on its size, with the cutting in the lambda again
    inside = F.contains("text", F.col("head"))
    if probe.limit(10_001).count() <= 10_000:
        # the text stays where it is: joined and checked in the stage that reads it
        found = runs.select("text", each).join(F.broadcast(probe), "k").where(inside).select("item_id", "times")
    else:
        # runs go to the join without their texts, so what moves grows with a text's length and not with its square
        met = runs.select("doc_id", each).join(probe, "k").drop("k").distinct()
        found = met.join(texts, "doc_id").where(inside).select("item_id", "times")
    short = b.where(~long & F.col("head").isNotNull()).select("item_id", "head", F.lit(1).cast("long").alias("times"))
    if n := short.limit(10_001).count():
        found = found.unionByName(texts.join(F.broadcast(short) if n <= 10_000 else short, inside).select("item_id", "times"))
    return b.select("item_id", F.lit(0).cast("long").alias("times")).unionByName(found).groupBy("item_id").agg(F.sum("times").alias("n_documents"))


@query("x_conversation_fold", "SELECT conv_id, count(*) AS turns, sha256(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS transcript FROM conversations GROUP BY conv_id")
def x_conversation_fold(spark: SparkSession, d: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.col("role"), F.lit(": "), F.col("text")).alias("t"))))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sha2(F.array_join(F.transform(turns, lambda x: x["t"]), "\n"), 256).alias("transcript"))


# ---- deduplication and entities ------------------------------------------------------------------------------


@query("dd_hash_first", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def dd_hash_first(spark: SparkSession, d: str) -> DataFrame:
    return dedup.first_wins(docs(spark, d).withColumn("h", F.sha2("text", 256)), ["source", "h"], ["doc_id"]).select("doc_id")


@query("dd_keep_last", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang, length(text) ORDER BY doc_id DESC) AS r FROM documents) WHERE r = 1")
def dd_keep_last(spark: SparkSession, d: str) -> DataFrame:
    return dedup.first_wins(docs(spark, d).withColumn("n", F.char_length("text")), ["lang", "n"], ["doc_id"], last=True).select("doc_id")


def _news(spark: SparkSession, d: str) -> DataFrame:
    rows = docs(spark, d)
    return rows.select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("u"), (F.col("doc_id") % 200).cast("string"))).alias("url"),
        F.when(F.col("doc_id") % 3 < 2, F.concat(F.lit(" a"), (F.col("doc_id") % 150).cast("string"))).alias("article"), "title", F.col("text").alias("summary"),
    )


@query("dd_tiered", f"WITH {_TITLE}, k AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'u' || doc_id % 200 ELSE '' END AS u, CASE WHEN doc_id % 3 < 2 THEN 'a' || doc_id % 150 ELSE '' END AS a, regexp_replace(lower(title), '[^0-9a-z一-鿿]+', '', 'g') || '|' || regexp_replace(lower(text), '[^0-9a-z一-鿿]+', '', 'g') AS t FROM docs), r AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY doc_id) AS ru, row_number() OVER (PARTITION BY a ORDER BY doc_id) AS ra, row_number() OVER (PARTITION BY t ORDER BY doc_id) AS rt FROM k) SELECT doc_id, (u <> '' AND ru > 1) OR (u = '' AND a <> '' AND ra > 1) OR (u = '' AND a = '' AND rt > 1) AS duplicate FROM r")
def dd_tiered(spark: SparkSession, d: str) -> DataFrame:
    return dedup.tiered(dedup.news_keys(_news(spark, d), "url", "article", "title", "summary"), "doc_id").select("doc_id", "duplicate")


@query("dd_greedy_keys")
def dd_greedy_keys(spark: SparkSession, d: str) -> DataFrame:
    """Order-dependent over three keys; tests hold it against one pass in order."""
    rows = dedup.news_keys(_news(spark, d), "url", "article", "title", "summary")
    return dedup.greedy(rows.select("doc_id", F.nullif("url_key", F.lit("")).alias("u"), F.nullif("article_key", F.lit("")).alias("a"), "text_key"), [["u"], ["a"], ["text_key"]], "doc_id").select("doc_id")


_NOV = """n AS (SELECT vec_id, label AS asset, vec_id // 40 AS rank, embedding::DOUBLE[] AS v FROM embeddings)"""


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("label").alias("asset"), F.floor(F.col("vec_id") / 40).alias("rank"), F.col("embedding").cast("array<double>").alias("v"))


@query("dd_rolling_novelty", f"WITH {_NOV}, p AS (SELECT a.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS s FROM n a JOIN n b ON a.asset = b.asset AND b.rank BETWEEN a.rank - 5 AND a.rank AND b.vec_id < a.vec_id), m AS (SELECT vec_id, max(s) AS s FROM p GROUP BY vec_id) SELECT n.vec_id, m.s + 0 AS max_prior, m.s IS NULL OR m.s < 0.9 AS novel FROM n LEFT JOIN m USING (vec_id)")
def dd_rolling_novelty(spark: SparkSession, d: str) -> DataFrame:
    got = dedup.novelty(_vectors(spark, d), "asset", "rank", "vec_id", "vec_id", "v")
    return got.select("vec_id", r6("max_prior").alias("max_prior"), F.coalesce(r6("max_prior") < 0.9, F.lit(True)).alias("novel"))


@query("e_resolve", r"""WITH u AS (SELECT s_suppkey AS id, 'name' || s_suppkey AS name, (1000 + s_suppkey)::VARCHAR AS code FROM supplier), t AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'x ' || (1000 + user_id % 120) || ' y' WHEN event_id % 3 = 1 THEN 'about name' || user_id % 120 || ', today' ELSE 'name' || user_id % 120 || ' (' || (1000 + user_id % 120) || ')' END AS text, user_id FROM events),
 e AS (SELECT event_id, code, 'code' AS k FROM t JOIN u ON list_contains(regexp_extract_all(text, '[0-9]{4}'), code) UNION SELECT event_id, code, 'name' FROM t JOIN u ON list_contains(regexp_extract_all(text, '[a-z0-9]+'), name)) SELECT event_id, code, CASE WHEN count(DISTINCT k) > 1 THEN 'gold' ELSE 'silver' END AS level FROM e GROUP BY ALL""")
def e_resolve(spark: SparkSession, d: str) -> DataFrame:
    n = (F.col("user_id") % 120).cast("string")
    code = (F.col("user_id") % 120 + 1000).cast("string")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("x "), code, F.lit(" y"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("about name"), n, F.lit(", today"))).otherwise(F.concat(F.lit("name"), n, F.lit(" ("), code, F.lit(")")))
    rows = table(spark, d, "events").select("event_id", text.alias("text"))
    universe = table(spark, d, "supplier").select((F.col("s_suppkey") + 1000).cast("string").alias("code"), F.array(F.concat(F.lit("name"), F.col("s_suppkey").cast("string"))).alias("names"))
    found = entities.resolve(entities.by_code(rows, "event_id", F.col("text"), universe, "code", digits=4), entities.by_name(rows, "event_id", F.col("text"), universe, "code", F.col("names")), key="event_id", code="code")
    return found.select("event_id", "code", "level")


@query("e_aliases", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '*STalpha' || ';' || 'alpha' WHEN s_suppkey % 3 = 1 THEN 'STbet' ELSE 'gamma' END AS aliases FROM supplier")
def e_aliases(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("s_suppkey") % 3 == 0, "*STalpha").when(F.col("s_suppkey") % 3 == 1, "STbet").otherwise("gamma")
    return table(spark, d, "supplier").select("s_suppkey", F.array_join(entities.aliases(name), ";").alias("aliases"))


@query("e_relation", "SELECT doc_id, CASE WHEN strpos(text, 'thing') > 0 THEN 'direct' WHEN strpos(text, 'que') > 0 OR strpos(text, 'der') > 0 THEN 'market' ELSE 'unrelated' END AS relation FROM documents")
def e_relation(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", entities.relation(F.col("text"), F.lit("thing"), ("que", "der")).alias("relation"))


# ---- vectors and learning ----------------------------------------------------------------------------------------


@query("v_cosine_topk", "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, round(list_cosine_similarity(a.v, b.v), 6) + 0 AS similarity FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, neighbour) AS place FROM p) SELECT query, neighbour, similarity, place FROM r WHERE place <= 5")
def v_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    got = learning.neighbours(v.where("vec_id % 20 = 0"), v, "vec_id", "v", 5)
    return got.select("query", "neighbour", r6("similarity").alias("similarity"), F.col("place").cast("long").alias("place"))


@query("v_centroid", "WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) SELECT label, pos::INT AS pos, round(avg(x), 6) + 0 AS mean FROM x GROUP BY ALL")
def v_centroid(spark: SparkSession, d: str) -> DataFrame:
    m = learning.moments(table(spark, d, "embeddings"), ["label"], "embedding")
    return m.select("label", "pos", r6(F.col("s") / F.col("n")).alias("mean"))


@query("v_fisher", "WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings), c AS (SELECT pos, label, count(*) AS n, avg(x) AS m, sum(x * x) - count(*) * avg(x) * avg(x) AS w FROM x GROUP BY ALL), t AS (SELECT pos, avg(x) AS g FROM x GROUP BY pos) SELECT pos::INT AS pos, round(sum(n * (m - g) * (m - g)) / sum(w), 6) + 0 AS fisher FROM c JOIN t USING (pos) GROUP BY pos")
def v_fisher(spark: SparkSession, d: str) -> DataFrame:
    got = learning.fisher(learning.moments(table(spark, d, "embeddings"), ["label"], "embedding"), "label")
    return got.select("pos", r6("fisher").alias("fisher"))


@query("v_knn_vote", "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id AS query, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 9) DESC, b.vec_id) AS r FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) SELECT query, label, round(count(*) / 10, 6) + 0 AS share FROM p WHERE r <= 10 GROUP BY ALL")
def v_knn_vote(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    found = learning.neighbours(v.where("vec_id % 20 = 0"), v, "vec_id", "v", 10)
    return learning.neighbour_vote(found, table(spark, d, "embeddings"), "vec_id", "label").select("query", "label", r6("share").alias("share"))


@query("v_pooling", "WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings), p AS (SELECT vec_id, pos % 8 AS dim, avg(x) AS mean, max(x) AS top FROM x GROUP BY ALL) SELECT vec_id, round(sum((dim + 1) * mean), 5) + 0 AS mean_pooled, round(sum((dim + 1) * top), 5) + 0 AS max_pooled FROM p GROUP BY vec_id")
def v_pooling(spark: SparkSession, d: str) -> DataFrame:
    """Mean and largest of eight tokens of eight dimensions cut from each vector; dimensions weigh differently."""
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(F.col("v"), i * 8 + 1, F.lit(8)))
    total = lambda pooled: F.round(F.aggregate(F.zip_with(pooled, F.array(*[F.lit(float(k)) for k in range(1, 9)]), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x), 5)
    return v.select("vec_id", total(vx.mean_pool(tokens, size=8)).alias("mean_pooled"), total(vx.max_pool(tokens)).alias("max_pooled"))


@query("v_three_point", "WITH e AS (SELECT vec_id, embedding[1:22]::DOUBLE[] AS low, embedding[22:43]::DOUBLE[] AS mid, embedding[43:64]::DOUBLE[] AS high FROM embeddings), s AS (SELECT vec_id, unnest(low) AS l, unnest(mid) AS m, unnest(high) AS h FROM e) SELECT vec_id, round(sqrt(sum((h - m) * (h - m))) + sqrt(sum((l - m) * (l - m))), 6) + 0 AS magnitude, round(sqrt(sum((h - l) * (h - l))) / (sqrt(sum((h - m) * (h - m))) + sqrt(sum((l - m) * (l - m))) + 1e-8), 6) + 0 AS clarity, round(sqrt(sum((m - (h + l) / 2) * (m - (h + l) / 2))), 6) + 0 AS curvature FROM s GROUP BY vec_id")
def v_three_point(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("v")
    cells = vx.three_point(F.slice(v, 1, 22), F.slice(v, 22, 22), F.slice(v, 43, 22))
    return _vectors(spark, d).select("vec_id", *[r6(cells[c]).alias(c) for c in ("magnitude", "clarity", "curvature")])


@query("v_gate_select", "WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), c AS (SELECT pos, label, count(*) AS n, avg(x) AS m, sum(x * x) - count(*) * avg(x) * avg(x) AS w FROM x GROUP BY ALL), t AS (SELECT pos, avg(x) AS g FROM x GROUP BY pos), f AS (SELECT pos, sum(n * (m - g) * (m - g)) / sum(w) AS f FROM c JOIN t USING (pos) GROUP BY pos), k AS (SELECT pos FROM f ORDER BY f DESC, pos LIMIT 4) SELECT vec_id, round(sum(embedding[pos]::DOUBLE), 6) + 0 AS gated FROM embeddings, k GROUP BY vec_id")
def v_gate_select(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    best = learning.top_positions(learning.fisher(learning.moments(e, ["label"], "embedding"), "label"), 4)
    picked = learning.select_positions(F.col("embedding"), best)
    return e.select("vec_id", r6(F.aggregate(picked, F.lit(0.0), lambda s, x: s + x.cast("double"))).alias("gated"))


@query("v_cluster_means", "WITH g AS (SELECT label, sum(embedding[1]::DOUBLE) AS s, count(*) AS n FROM embeddings GROUP BY label) SELECT label, round((s + 20 * (sum(s) OVER () / sum(n) OVER ())) / (n + 20), 6) + 0 AS mean FROM g")
def v_cluster_means(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("x"))
    return learning.shrunk_cluster_means(rows, "label", "x", 20.0).select("label", r6("mean").alias("mean"))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").withColumns({"y": F.col("embedding")[3].cast("double") * 2 + F.col("embedding")[5].cast("double"), "year": (F.col("vec_id") % 9).cast("int")})
    return learning.as_vector(rows.select("vec_id", "label", "embedding", "y", "year"), "embedding")


@query("l_ridge_roll")
def l_ridge_roll(spark: SparkSession, d: str) -> DataFrame:
    """Six periods to fit, two to choose the penalty, one to test."""
    from tidemark.operators.metrics import regression_scores

    rows = _labelled(spark, d).cache()

    def one(fit: DataFrame, check: DataFrame, test: DataFrame) -> DataFrame:
        error = lambda got: -(got.agg(F.avg(F.pow(F.col("y") - F.col("prediction"), 2))).first()[0] or 0.0)
        alpha, _ = learning.choose(fit, check, (0.1, 1.0), lambda f, a: learning.ridge(f, a, label="y"), error, most=1)
        both = fit.unionByName(check)
        return learning.ridge(both, alpha, label="y").fit(both).transform(test)

    got = learning.rolling(rows, "year", learning.rolling_windows(range(9)), one)
    return regression_scores(got, "y", "prediction", "fold")


@query("l_pca_energy")
def l_pca_energy(spark: SparkSession, d: str) -> DataFrame:
    model = learning.reducer(8).fit(_labelled(spark, d))
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(model.stages[1].explainedVariance)], "component int, share double")


@query("l_kmeans_soft")
def l_kmeans_soft(spark: SparkSession, d: str) -> DataFrame:
    import numpy as np
    from pyspark.ml.clustering import KMeans

    rows = _labelled(spark, d)
    centres = np.array(KMeans(k=4, seed=7).fit(rows).clusterCenters())
    return learning.soft_assign(rows, centres, "embedding").select("vec_id", "posterior")


@query("l_classifiers")
def l_classifiers(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    from tidemark.operators.metrics import binary_scores

    rows = _labelled(spark, d).withColumn("target", (F.col("y") > 0).cast("double"))
    fit, test = rows.where("year < 6").cache(), rows.where("year >= 6")
    out = None
    for name in ("logistic", "naive_bayes", "forest"):
        got = learning.CLASSIFIERS[name](labelCol="target").fit(fit).transform(test).withColumn("p", vector_to_array("probability")[1])
        part = binary_scores(got, "target", "p").select(F.lit(name).alias("classifier"), "n", "accuracy", "auc", "log_loss")
        out = part if out is None else out.unionByName(part)
    return out


@query("l_fusion", "WITH x AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, CASE WHEN vec_id % 3 > 0 THEN embedding[3]::DOUBLE END AS c FROM embeddings) SELECT vec_id, round((a + b + coalesce(c, 0)) / 3, 6) + 0 AS equal, round((2 * a + b + coalesce(c, 0)) / 4, 6) + 0 AS weighted FROM x")
def l_fusion(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("embedding")
    rows = table(spark, d, "embeddings").select("vec_id", *[x[i].cast("double").alias(c) for i, c in enumerate("ab")], F.when(F.col("vec_id") % 3 > 0, x[2].cast("double")).alias("c"))
    return rows.select("vec_id", r6(learning.fuse(rows, "abc")).alias("equal"), r6(learning.fuse(rows, "abc", (2.0, 1.0, 1.0))).alias("weighted"))


@query("l_stacking")
def l_stacking(spark: SparkSession, d: str) -> DataFrame:
    rows = _labelled(spark, d).withColumns({f"m{i}": F.col("embedding")[i].cast("double") for i in range(8)})
    got = learning.stacked(rows.where("year < 6"), rows.where("year >= 6"), [f"m{i}" for i in range(8)], "y", maxIter=5)
    return got.select("vec_id", "y", "prediction")


@query("l_factor_ranking", None)
def l_factor_ranking(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.xsection import daily_ic

    s = signals(spark, d)
    long = s.select("date", "actual", F.explode(F.create_map(F.lit("raw"), F.col("pred"), F.lit("noise"), F.col("asset") * F.lit(1.0))).alias("factor", "pred"))
    return learning.factor_ranking(daily_ic(long, "date", "actual", "pred", by=("factor",)), "factor")


@query("l_mlp_forward", "WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings), h AS (SELECT vec_id, sum(CASE WHEN pos % 2 = 0 THEN x ELSE -x END) + 0.1::DOUBLE AS a, sum(x * pos / 64) AS b FROM e GROUP BY vec_id) SELECT vec_id, round(2 * greatest(a, 0) - greatest(b, 0) + 0.5::DOUBLE, 5) + 0 AS y FROM h")
def l_mlp_forward(spark: SparkSession, d: str) -> DataFrame:
    import numpy as np

    pos = np.arange(64)
    layers = [(np.stack((np.where(pos % 2 == 0, 1.0, -1.0), pos / 64), 1), np.array([0.1, 0.0])), (np.array([[2.0], [-1.0]]), np.array([0.5]))]
    v = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.round(learning.mlp_forward(v, layers)[0], 5).alias("y"))


@query("l_hash_features")
def l_hash_features(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.feature import HashingTF, Normalizer

    rows = _words(spark, d)
    got = Normalizer(inputCol="tf", outputCol="unit", p=2.0).transform(HashingTF(inputCol="w", outputCol="tf", numFeatures=1 << 18).transform(rows))
    return got.select("doc_id", F.size("w").alias("n_words"), F.col("unit").cast("string").alias("features"))


@query("l_word2vec")
def l_word2vec(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators import wordvectors

    rows = docs(spark, d).select("doc_id", "text")
    return wordvectors.encode(rows, "doc_id", "text", *wordvectors.fit(rows, "text", size=16, least=5, seed=7))


@query("w_rank_window_rows", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice) AS position FROM lineitem")
def w_rank_window_rows(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", place.cast("long").alias("position"))
