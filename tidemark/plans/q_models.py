"""Queries: pages, records, representations, gates, fusions and choices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import clusters, dedup, entities, fusion, gates, joins, learning, pages, records, representations, windows
from tidemark.plans.base import PANEL, SIGNALS, panel, query, r6, signals, table

_S = F.lit


def _case(key: str, n: int, *values: object) -> F.Column:
    """The value whose place is the key modulo ``n``; the last one for all other places."""
    at = F.pmod(F.col(key), _S(n))
    out = None
    for i, v in enumerate(values[:-1]):
        out = F.when(at == i, v) if out is None else out.when(at == i, v)
    return out.otherwise(values[-1])


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.coalesce("text", _S("")).alias("text"), "lang", "source")


# ---- pages -----------------------------------------------------------------------------------------------------


@query("x_date_ladder", """SELECT p.page_id, v.raw, v.iso, v.day, v.year, v.source, v.confidence FROM pages p JOIN (VALUES
 (0, '2024-03-05 08:07', '2024-03-05T08:07:00+08:00', '2024-03-05', 2024, 'meta', 1.0::DOUBLE),
 (1, '2023年4月6日 9:05', '2023-04-06T09:05:00+08:00', '2023-04-06', 2023, 'meta', 1.0),
 (2, '2022/1/9', '2022-01-09T00:00:00+08:00', '2022-01-09', 2022, 'title', 0.9),
 (3, '2021年7月8日 消息 10:11:12', '2021-07-08T00:00:00+08:00', '2021-07-08', 2021, 'body_front', 0.85),
 (4, '2020-12-31T23:59', '2020-12-31T23:59:00+08:00', '2020-12-31', 2020, 'visible_text', 0.75),
 (5, '2019-5-6', '2019-05-06T00:00:00+08:00', '2019-05-06', 2019, 'url', 0.55),
 (6, NULL, NULL, NULL, NULL, NULL, 0.0)) v(k, raw, iso, day, year, source, confidence) ON ((p.page_id % 7) + 7) % 7 = v.k""")
def x_date_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Each page gets a date in one place, or in none; the SQL lists what each place must give."""
    empty = F.create_map(_S(""), _S(""))
    meta = _case("page_id", 7, F.create_map(_S("date"), _S("2024-03-05 08:07")), F.create_map(_S("datepublished"), _S("2000-01-01"), _S("pubdate"), _S("2023年4月6日 9:05")), empty)
    title, body = _case("page_id", 7, *[_S("none")] * 2, _S("Report 2022/1/9"), _S("none")), _case("page_id", 7, *[_S("plain")] * 3, _S("by 2021年7月8日 消息 10:11:12 end"), _S("plain"))
    seen, url = _case("page_id", 7, *[_S("")] * 4, _S("at 2020-12-31T23:59 on"), _S("")), _case("page_id", 7, *[_S("http://h/a.html")] * 5, _S("http://h/2019/5/6/a.html"), _S("http://h/a.html"))
    return table(spark, d, "pages").select("page_id", pages.dated(meta, title, body, seen, url).alias("p")).select("page_id", "p.raw", F.col("p.at").alias("iso"), "p.day", "p.year", "p.source", F.col("p.confidence").alias("confidence"))


@query("x_body_quality", "SELECT page_id, ['too_short', 'navigation_only', 'navigation_only', 'valid', 'low_quality', 'valid'][((page_id % 6) + 6) % 6 + 1] AS quality FROM pages")
def x_body_quality(spark: SparkSession, d: str) -> DataFrame:
    crowd = F.concat(_S("登录 注册 基金 外汇 "), F.coalesce("html", _S("")), F.repeat(_S("x"), 40))
    plain = F.concat(F.coalesce("html", _S("")), F.repeat(_S("x"), 40))
    body = _case("page_id", 6, _S("x"), plain, crowd, crowd, plain)
    url = _case("page_id", 6, *[_S("http://h/news/1.html")] * 3, _S("http://h/t/1.html"), _S("http://h/news/1.html"))
    year = _case("page_id", 6, *[_S(2024)] * 4, _S(None).cast("int"), _S(2024))
    title = _case("page_id", 6, _S("t"), _S("股票首页 今日"), _S("t"))
    return table(spark, d, "pages").select("page_id", pages.body_quality(url, title, body, _S(False), year, 20).alias("quality"))


_NOISY = "coalesce(text, '') || ' 第 3 页 共 9 页<br>公告下载 www.a.b/c end　x' || chr(65533)"


def _without_layout_sql(text: str) -> str:
    for p in pages.LAYOUT:
        text = f"regexp_replace({text}, '{p}', ' ', 'g')"
    return f"regexp_replace(regexp_replace({text}, '[　' || chr(65279) || chr(65533) || ']', ' ', 'g'), '\\s+', '', 'g')"


@query("x_layout_noise", f"SELECT doc_id, sha256({_without_layout_sql(_NOISY)}) AS kept FROM documents")
def x_layout_noise(spark: SparkSession, d: str) -> DataFrame:
    noisy = F.concat("text", _S(" 第 3 页 共 9 页<br>公告下载 www.a.b/c end　x�"))
    return _docs(spark, d).select("doc_id", F.sha2(pages.without_layout(noisy), 256).alias("kept"))


@query("x_trim_header", "SELECT doc_id, sha256(CASE WHEN doc_id % 2 = 0 THEN 'Body ' ELSE '2024年1月2日 Body ' END || coalesce(text, '')) AS kept FROM documents")
def x_trim_header(spark: SparkSession, d: str) -> DataFrame:
    title = F.concat(_S("Title "), F.col("doc_id").cast("string"), _S("#"))
    head = F.when(F.col("doc_id") % 2 == 0, F.concat(_S("Home > 正文 "), title, _S(" by x "), title, _S("  收藏本文 下载APP 收藏本文 "))).otherwise("Home > 正文 2024年1月2日 ")
    body = F.concat(head, _S("Body "), "text")
    return _docs(spark, d).select("doc_id", F.sha2(pages.trim_header(title, body, "> 正文", pages.literal("收藏本文", "下载APP")), 256).alias("kept"))


# ---- records and entities ----------------------------------------------------------------------------------------


@query("p_validate", "WITH r AS (SELECT doc_id, ((doc_id % 7) + 7) % 7 AS k, source FROM documents) SELECT doc_id, CASE k WHEN 0 THEN 'outside_stock_universe' WHEN 1 THEN 'non_announcement' WHEN 2 THEN 'non_direct_relation' WHEN 3 THEN 'invalid_publication_time' WHEN 4 THEN 'empty_text_model' END AS reason, left(sha256(CASE WHEN k = 0 THEN '999999' ELSE '600001' END || '|||' || CASE WHEN k = 3 THEN 'bad' ELSE '2024-01-02 03:04:05' END || '|' || coalesce(source, '') || '|'), 32) AS document_id FROM r")
def p_validate(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select(
        "doc_id", _case("doc_id", 7, _S("999999"), _S("600001.0")).alias("stock_id"), _case("doc_id", 7, _S("announcement"), _S("news"), _S("announcement")).alias("content_type"),
        _case("doc_id", 7, *[_S("direct")] * 2, _S("indirect"), _S(None).cast("string")).alias("stock_relation"), _case("doc_id", 7, *[_S("2024-01-02 03:04:05")] * 3, _S("bad"), _S("2024-01-02 03:04:05")).alias("published_at"),
        F.col("source").alias("title"), _case("doc_id", 7, *[F.concat(_S("x"), "text")] * 4, _S(" 　"), F.concat(_S("x"), "text")).alias("text"),
    )
    universe = spark.createDataFrame([("600001",), ("1",)], "stock_id string")
    return records.validated(rows, universe, "test").select("doc_id", "reason", "document_id")


@query("p_one_asset", f"WITH {PANEL} SELECT date, close, row_number() OVER (ORDER BY date) AS row_index FROM panel WHERE asset = (SELECT min(asset) FROM panel)")
def p_one_asset(spark: SparkSession, d: str) -> DataFrame:
    rows = panel(spark, d)
    first = rows.agg(F.min("asset")).first()[0]
    return records.one_asset(rows, "asset", first, "date").select("date", "close", "row_index")


@query("p_between", "SELECT event_id FROM events WHERE ts >= (SELECT min(ts)::DATE + 5 FROM events) AND ts < (SELECT min(ts)::DATE + 16 FROM events)")
def p_between(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    first = events.agg(F.date_add(F.to_date(F.min("ts")), 5).cast("string").alias("a"), F.date_add(F.to_date(F.min("ts")), 15).cast("string").alias("b")).first()
    return records.between(events, "ts", first["a"], first["b"]).select("event_id")


@query("e_ladder", "SELECT doc_id, ['600001', '600002', '600003', '600003'][((doc_id % 5) + 5) % 5 + 1] AS code, ['code_in_title', 'code_in_body', 'unambiguous_name_in_title', 'unambiguous_name_in_body'][((doc_id % 5) + 5) % 5 + 1] AS evidence, CASE WHEN ((doc_id % 5) + 5) % 5 = 3 THEN 'silver' ELSE 'gold' END AS confidence FROM documents WHERE ((doc_id % 5) + 5) % 5 < 4")
def e_ladder(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select(
        "doc_id", _case("doc_id", 5, _S("about (600001) now"), _S("none"), _S("*ST Alpha Beta Co says"), _S("none")).alias("title"),
        F.concat(_case("doc_id", 5, _S("x"), _S("code 600002"), _S("x"), _S("from Alpha Beta Co"), _S("x")), _S(" | "), F.regexp_replace("text", "[0-9]", "")).alias("body"),
    )
    universe = spark.createDataFrame([("600001", "Gamma Delta"), ("600002", "Epsilon Zeta"), ("600003", "*ST Alpha Beta Co")], "code string, name string")
    given = rows.select("doc_id", _S("600003").alias("code"))
    return entities.ladder(rows, "doc_id", "title", "body", given, universe, "code", "name").select("doc_id", "code", "evidence", "confidence")


@query("dd_union", "WITH u AS (SELECT doc_id, 'a' AS origin, coalesce(source, '') AS url, md5(coalesce(text, '')) AS h FROM documents UNION ALL SELECT doc_id + 10000000, 'b', '', md5(coalesce(text, '')) FROM documents WHERE doc_id % 3 = 0), f AS (SELECT *, row_number() OVER (PARTITION BY url, h ORDER BY doc_id) AS r FROM u) SELECT doc_id, origin, CASE WHEN r = 1 THEN 'kept' ELSE 'same' END AS status FROM f")
def dd_union(spark: SparkSession, d: str) -> DataFrame:
    """Two collectors' files in one, missing columns filled; the first of each (url, text) stays, the others are a side output."""
    a = _docs(spark, d).select("doc_id", _S("a").alias("origin"), F.coalesce("source", _S("")).alias("url"), "text")
    b = _docs(spark, d).where("doc_id % 3 = 0").select((F.col("doc_id") + 10_000_000).alias("doc_id"), _S("b").alias("origin"), "text")
    every = a.unionByName(b, allowMissingColumns=True).select("doc_id", "origin", F.coalesce("url", _S("")).alias("url"), F.md5("text").alias("h"))
    kept = dedup.first_wins(every, ["url", "h"], ["doc_id"]).select("doc_id", "origin", _S("kept").alias("status"))
    side = every.join(kept.select("doc_id"), "doc_id", "left_anti").select("doc_id", "origin", _S("same").alias("status"))
    return kept.unionByName(side)


@query("j_stock_map", f"WITH {SIGNALS}, m AS (SELECT DISTINCT user_id AS asset, 'S' || lpad((user_id % 40)::VARCHAR, 3, '0') AS code FROM events) SELECT s.asset, s.date, m.code, s.pred FROM signals s JOIN m USING (asset)")
def j_stock_map(spark: SparkSession, d: str) -> DataFrame:
    """A table of predictions joined to a map that must be unique by asset."""
    names = table(spark, d, "events").select(F.col("user_id").alias("asset"), F.concat(_S("S"), F.lpad((F.col("user_id") % 40).cast("string"), 3, "0")).alias("code")).distinct()
    return joins.validated_join(signals(spark, d), names, ["asset"], how="inner", strict=True).select("asset", "date", "code", "pred")


@query("w_market_forward", f"WITH {SIGNALS}, m AS (SELECT date, avg(actual) AS r FROM signals GROUP BY date) SELECT date, CASE WHEN count(r) OVER w = 3 THEN round(product(1 + r) OVER w - 1, 6) + 0 END AS r3 FROM m WINDOW w AS (ORDER BY date ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)")
def w_market_forward(spark: SparkSession, d: str) -> DataFrame:
    """One row a date: a window over a calendar is small."""
    market = signals(spark, d).groupBy("date").agg(F.avg("actual").alias("r")).withColumn("all", _S(0))
    return market.select("date", r6(windows.forward_product("r", "all", "date", 3)).alias("r3"))


@query("a_expost_edges", f"WITH {SIGNALS}, r AS (SELECT date, actual, ceil(count(*) OVER (PARTITION BY date) * 0.2::DOUBLE) AS n, row_number() OVER (PARTITION BY date ORDER BY actual DESC) AS up, row_number() OVER (PARTITION BY date ORDER BY actual) AS down FROM signals), g AS (SELECT date, avg(actual) FILTER (up <= n) AS t, avg(actual) FILTER (down <= n) AS b FROM r GROUP BY date) SELECT year(date)::INT AS year, count(*) AS days, round(avg(t), 6) + 0 AS top, round(avg(b), 6) + 0 AS bottom FROM g GROUP BY ALL")
def a_expost_edges(spark: SparkSession, d: str) -> DataFrame:
    return gates.expost_edges(signals(spark, d), "date", "actual").select("year", "days", r6("top").alias("top"), r6("bottom").alias("bottom"))


# ---- representations -----------------------------------------------------------------------------------------------


@query("l_char_tfidf", "WITH g AS (SELECT item_id, unnest(list_concat(list_transform(range(1, length(text)), lambda i: substr(text, i, 2)), list_transform(range(1, length(text) - 1), lambda i: substr(text, i, 3)))) AS term FROM benchmark), n AS (SELECT count(*) AS n FROM benchmark WHERE item_id % 2 = 0), f AS (SELECT term, ln((1 + n) / (1 + count(DISTINCT item_id))) + 1 AS idf FROM g, n WHERE item_id % 2 = 0 GROUP BY term, n HAVING count(DISTINCT item_id) >= 3 AND count(DISTINCT item_id) <= 0.9 * n), t AS (SELECT item_id, term, (1 + ln(count(*))) * any_value(idf) AS raw FROM g JOIN f USING (term) GROUP BY ALL) SELECT item_id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY item_id)), 6) + 0 AS weight FROM t")
def l_char_tfidf(spark: SparkSession, d: str) -> DataFrame:
    """Fitted on the even items, applied to all."""
    items = table(spark, d, "benchmark")
    cut = representations.char_grams(F.col("text"), 2, 3)
    model = representations.fit_tfidf(items.where("item_id % 2 = 0"), "item_id", cut, min_df=3, max_df=0.9)
    return model.transform(items, "item_id", cut).select("item_id", "term", r6("weight").alias("weight"))


_TERMS = "w AS (SELECT d.doc_id, l.quality AS y, unnest(regexp_extract_all(lower(d.text), '[a-z]+')) AS term FROM documents d JOIN labels l USING (doc_id))"
_SIDES = "s AS (SELECT sum(l.quality)::DOUBLE AS p, sum(1 - l.quality)::DOUBLE AS q FROM documents d JOIN labels l USING (doc_id))"


def _marked(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).join(table(spark, d, "labels"), "doc_id")
    return rows.select("doc_id", "quality", F.regexp_extract_all(F.lower("text"), _S("[a-z]+"), 0).alias("w"), (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("test"))


@query("l_class_gaps", f"WITH {_TERMS}, {_SIDES}, g AS (SELECT term, sum(y)::DOUBLE AS a, sum(1 - y)::DOUBLE AS b FROM w GROUP BY term HAVING count(DISTINCT doc_id) >= 2) SELECT term, round(a / greatest(p, 1) - b / greatest(q, 1), 8) + 0 AS gap FROM g, s")
def l_class_gaps(spark: SparkSession, d: str) -> DataFrame:
    return representations.class_gaps(_marked(spark, d), F.col("w"), "quality", min_df=2).select("term", F.round("gap", 8).alias("gap"))


@query("l_log_ratios", f"WITH {_TERMS}, e AS (SELECT DISTINCT doc_id, y, term FROM w), g AS (SELECT term, sum(y)::DOUBLE AS p, sum(1 - y)::DOUBLE AS q FROM e GROUP BY term), t AS (SELECT sum(p) AS tp, sum(q) AS tq, count(*) AS v FROM g) SELECT term, round(ln((p + 1) / (tp + v)) - ln((q + 1) / (tq + v)), 6) + 0 AS ratio FROM g, t")
def l_log_ratios(spark: SparkSession, d: str) -> DataFrame:
    return representations.log_ratios(_marked(spark, d), F.col("w"), "quality").select("term", r6("ratio").alias("ratio"))


@query("l_sestm")
def l_sestm(spark: SparkSession, d: str) -> DataFrame:
    """A fitted likelihood: tests hold its accuracy on rows it did not see."""
    rows = _marked(spark, d)
    model = representations.fit_sestm(rows.where(~F.col("test")), F.col("w"), "quality", most=200)
    return model.transform(rows.where("test"), F.col("w")).select("doc_id", "quality", "sentiment")


@query("l_nbsvm")
def l_nbsvm(spark: SparkSession, d: str) -> DataFrame:
    rows = _marked(spark, d)
    model = representations.fit_nbsvm(rows.where(~F.col("test")), F.col("w"), "quality", most=2000)
    return model.transform(rows.where("test"), F.col("w")).select("doc_id", "quality", "probability")


def _lengths() -> representations.Encoder:
    return lambda texts: np.array([[len(t), t.count("a"), t.count(" ")] for t in texts])


@query("l_encoded", "SELECT doc_id, length(coalesce(text, ''))::DOUBLE AS n, length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'a', ''))::DOUBLE AS a, length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', ''))::DOUBLE AS blanks FROM documents")
def l_encoded(spark: SparkSession, d: str) -> DataFrame:
    """An injected encoder that counts characters stands for a model, so that SQL can tell the vectors."""
    got = representations.encoded(_docs(spark, d).select("doc_id", "text"), "text", _lengths)
    return got.select("doc_id", *[F.col("features")[i].cast("double").alias(n) for i, n in enumerate(("n", "a", "blanks"))])


@query("l_representations")
def l_representations(spark: SparkSession, d: str) -> DataFrame:
    """(name, rows): every representation of the registry that needs no network, fitted on one half and applied to the other."""
    rows = table(spark, d, "benchmark").withColumn("y", F.pmod("item_id", _S(3)).cast("int") % 2)
    parts = rows.where("item_id % 2 = 0"), rows.where("item_id % 2 <> 0")
    out = None
    for name in ("lexicon", "lmmd", "bow", "tfidf", "char_tfidf", "sestm", "word2vec", "sentence"):
        got = representations.fit_representation(name, *parts, "item_id", "text", "y", _lengths)
        part = got.predict.groupBy().agg(F.count_distinct("item_id").alias("rows")).select(_S(name).alias("name"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


@query("l_tail_tuned")
def l_tail_tuned(spark: SparkSession, d: str) -> DataFrame:
    """The penalty of a ridge is chosen on the last fifth of the dates and the model fitted again on all."""
    rows = learning.as_vector(signals(spark, d).withColumn("x", F.array(F.col("pred") / 40, F.pmod("asset", _S(7)).cast("double"))), "x").select("asset", "date", "features", "actual")
    error = lambda model, part: -(model.transform(part).agg(F.avg(F.pow(F.col("actual") - F.col("prediction"), 2))).first()[0] or 0.0)
    model, best, _ = representations.tail_tuned(rows, "date", (0.1, 10.0, 1000.0), lambda part, a: learning.ridge(part, a, label="actual").fit(part), error)
    return model.transform(rows).select("asset", "date", "prediction", _S(best).alias("alpha"))


# ---- gates -----------------------------------------------------------------------------------------------------


_POS = "e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)"


@query("v_token_variance", f"WITH {_POS}, m AS (SELECT pos, greatest(avg(x * x) - avg(x) * avg(x), 0) AS v FROM e GROUP BY pos) SELECT (pos // 8)::INT AS token, round(avg(v), 6) + 0 AS score FROM m GROUP BY ALL")
def v_token_variance(spark: SparkSession, d: str) -> DataFrame:
    m = learning.moments(table(spark, d, "embeddings"), [], "embedding")
    return gates.variance_scores(m, 8).select("token", r6("score").alias("score"))


@query("v_token_fisher", f"WITH {_POS}, m AS (SELECT pos, label % 2 AS y, avg(x) AS mu, greatest(avg(x * x) - avg(x) * avg(x), 0) AS v FROM e GROUP BY ALL), p AS (SELECT pos, max(mu) FILTER (y = 1) - max(mu) FILTER (y = 0) AS gap, max(v) FILTER (y = 1) + max(v) FILTER (y = 0) AS spread FROM m GROUP BY pos) SELECT (pos // 8)::INT AS token, round(avg(gap * gap / (spread + 1e-12)), 6) + 0 AS score FROM p GROUP BY ALL")
def v_token_fisher(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").withColumn("y", F.col("label") % 2)
    return gates.fisher_scores(learning.moments(rows, ["y"], "embedding"), "y", 8).select("token", r6("score").alias("score"))


@query("v_token_figures", f"WITH {_POS}, m AS (SELECT pos, avg(x) AS mu, greatest(avg(x * x) - avg(x) * avg(x), 0) AS v, avg(x) FILTER (label = 0) AS base FROM e GROUP BY pos) SELECT (pos // 8)::INT AS token, round(avg(v), 6) + 0 AS variance_score, round(1 - sum(mu * base) / (sqrt(sum(mu * mu)) * sqrt(sum(base * base))), 5) + 0 AS context_cosine_distance, round(sqrt(avg((mu - base) * (mu - base) / (v + 1e-12))), 6) + 0 AS context_standardized_l2 FROM m GROUP BY ALL")
def v_token_figures(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    base = learning.moments(rows.where("label = 0"), [], "embedding").select("pos", (F.col("s") / F.col("n")).alias("base"))
    got = gates.token_figures(learning.moments(rows, [], "embedding"), base, 8)
    return got.select("token", r6("variance_score").alias("variance_score"), F.round("context_cosine_distance", 5).alias("context_cosine_distance"), r6("context_standardized_l2").alias("context_standardized_l2"))


@query("v_kept_tokens", "SELECT vec_id, array_to_string(list_transform(list_concat(embedding[41:48], embedding[1:8]), lambda x: round(x::DOUBLE, 4)::DECIMAL(12, 4)), ',') AS kept FROM embeddings")
def v_kept_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Two tokens out of eight, in the order asked for, as one flat vector."""
    kept = F.transform(gates.kept_tokens(F.col("embedding"), (5, 0), 8), lambda x: F.round(x.cast("double"), 4).cast("decimal(12,4)").cast("string"))
    return table(spark, d, "embeddings").select("vec_id", F.array_join(kept, ",").alias("kept"))


@query("v_variant_gates")
def v_variant_gates(spark: SparkSession, d: str) -> DataFrame:
    """(mode, variant, weight): five variants of a vector gated in each way; tests hold the figures against NumPy."""
    names = [f"v{i}" for i in range(5)]
    rows = table(spark, d, "embeddings").select("vec_id", (F.col("label") % 2).alias("y"), *[F.slice("embedding", 12 * i + 1, 12).alias(n) for i, n in enumerate(names)]).cache()
    out = [(mode, i, float(w)) for mode in ("uniform", "variance", "fisher", "logistic_l1") for i, w in enumerate(gates.variant_weights(rows, names, "y", mode))]
    own = gates.dynamic_weights(names, gates.variant_directions(rows, names, "y"))
    mean = rows.select(F.posexplode(own).alias("variant", "w")).groupBy("variant").agg(F.avg("w").alias("weight"))
    return spark.createDataFrame(out, "mode string, variant int, weight double").unionByName(mean.select(_S("dynamic").alias("mode"), "variant", "weight"))


@query("v_l1_gate")
def v_l1_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").withColumn("y", F.col("label") % 2)
    scores = gates.l1_scores(rows, "embedding", "y", 8, 8)
    return spark.createDataFrame([(i, float(s)) for i, s in enumerate(scores)], "token int, score double")


@query("k_kernel_alignment")
def k_kernel_alignment(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b"))
    return spark.createDataFrame([(gates.kernel_alignment(rows, "a", "b"), gates.kernel_alignment(rows, "a", "a"))], "cross double, own double")


@query("l_svd")
def l_svd(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return rows.select("vec_id", gates.projected(F.col("embedding"), gates.truncated_svd(rows, "embedding", 4)).alias("reduced"))


# ---- models and choices --------------------------------------------------------------------------------------------


@query("l_families")
def l_families(spark: SparkSession, d: str) -> DataFrame:
    """(family, accuracy) of every family of classifiers on every fifth vector; count models see signs."""
    rows = table(spark, d, "embeddings").select("vec_id", (F.col("label") % 2).cast("double").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("x"), F.transform("embedding", lambda x: (x > 0).cast("double")).alias("signs"))
    dense, signs = learning.as_vector(rows, "x").cache(), learning.as_vector(rows, "signs").cache()
    out = []
    for name, make in learning.CLASSIFIERS.items():
        part = signs if name in ("multinomial_bayes", "complement_bayes", "bernoulli_bayes") else dense
        more = {"layers": [64, 8, 2]} if name == "mlp" else {}
        got = make(featuresCol="features", labelCol="label", **more).fit(part.where("vec_id % 5 <> 0")).transform(part.where("vec_id % 5 = 0"))
        out.append((name, got.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]))
    return spark.createDataFrame(out, "family string, accuracy double")


@query("l_mixture_of_gaussians")
def l_mixture_of_gaussians(spark: SparkSession, d: str) -> DataFrame:
    rows = learning.as_vector(table(spark, d, "embeddings").withColumn("x", F.slice("embedding", 1, 8)), "x")
    got = clusters.ALGORITHMS["gaussian"](k=4, seed=3).fit(rows).transform(rows)
    return got.groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))


@query("l_token_tree")
def l_token_tree(spark: SparkSession, d: str) -> DataFrame:
    """Average-linkage groups of the labels' centroids, of which there are few."""
    rows = learning.centroids(table(spark, d, "embeddings"), "label", "embedding").orderBy("label").collect()
    labels = clusters.average_linkage(np.array([r["centroid"] for r in rows]), min(3, len(rows)))
    return spark.createDataFrame([(r["label"], int(c)) for r, c in zip(rows, labels, strict=True)], "label int, cluster int")


_TWO = "(asset * 37 % 101)::DOUBLE"


@query("b_late_fusion", f"""WITH {SIGNALS}, g(weight) AS (VALUES (0.0::DOUBLE), (0.25), (0.5), (0.75), (1.0)), m AS (SELECT weight, date, actual, weight * pred + (1 - weight) * {_TWO} AS mix FROM signals, g),
 r AS (SELECT weight, date, rank() OVER (PARTITION BY weight, date ORDER BY actual) + (count(*) OVER (PARTITION BY weight, date, actual) - 1) / 2 AS ra, rank() OVER (PARTITION BY weight, date ORDER BY mix) + (count(*) OVER (PARTITION BY weight, date, mix) - 1) / 2 AS rb FROM m),
 i AS (SELECT weight, date, covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0) AS ic FROM r GROUP BY ALL HAVING count(*) >= 5),
 s AS (SELECT weight, avg(ic) FILTER (day(date) % 2 = 0) AS v, avg(ic) FILTER (day(date) % 2 = 1) AS t FROM i GROUP BY weight) SELECT weight, round(v, 6) + 0 AS validation_ic, round(t, 6) + 0 AS test_ic, row_number() OVER (ORDER BY v DESC NULLS LAST, weight) = 1 AND v IS NOT NULL AS selected FROM s""")
def b_late_fusion(spark: SparkSession, d: str) -> DataFrame:
    rows = signals(spark, d).withColumn("other", (F.col("asset") * 37 % 101).cast("double"))
    even = F.dayofmonth("date") % 2 == 0
    got = fusion.late_fusion(rows.where(even), rows.where(~even), "date", "actual", "pred", "other")
    return got.select("weight", r6("validation_ic").alias("validation_ic"), r6("test_ic").alias("test_ic"), "selected")


@query("b_fusions")
def b_fusions(spark: SparkSession, d: str) -> DataFrame:
    """(asset, date, five fusions): fitted learners have no SQL; tests hold the fixed ones against their formulas."""
    rows = signals(spark, d).withColumns({"other": (F.col("asset") * 37 % 101).cast("double"), "third": F.col("pred") * F.col("pred") / 100})
    even = F.dayofmonth("date") % 2 == 0
    got = fusion.fused(rows.where(even), rows.where(~even), "date", "actual", ["pred", "other", "third"])
    return got.select("asset", "date", "equal_weight", "best_single", "ridge", "elastic_net", "boosting")


@query("l_select_year", "WITH s AS (SELECT user_id % 4 + 2020 AS test_year, event_type AS model, CASE WHEN any_value(event_type) = 'view' THEN NULL ELSE avg(value) END AS primary_score, stddev_samp(value) AS second, count(*) AS n, count(DISTINCT ts::DATE) AS days FROM events GROUP BY ALL), e AS (SELECT *, primary_score IS NOT NULL AND n >= 100 AND days >= 20 AND test_year <> 2023 AS ok FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY test_year ORDER BY ok DESC, primary_score DESC NULLS LAST, second DESC NULLS LAST, model) AS k FROM e) SELECT test_year, CASE WHEN count(*) FILTER (ok) > 0 THEN 'selected' ELSE 'insufficient_validation_data' END AS status, max(model) FILTER (k = 1 AND ok) AS selected_model, count(*) FILTER (ok) AS eligible_count, count(*) AS candidate_count FROM r GROUP BY test_year")
def l_select_year(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    score = F.when(F.first("event_type") != "view", F.avg("value"))
    scores = e.groupBy((F.col("user_id") % 4 + 2020).alias("test_year"), F.col("event_type").alias("model")).agg(score.alias("primary_score"), F.stddev_samp("value").alias("second"), F.count(F.lit(1)).alias("n"), F.count_distinct(F.to_date("ts")).alias("days"))
    ok = fusion.eligible(F.col("primary_score"), F.col("n"), 100, F.col("days"), 20) & (F.col("test_year") != 2023)
    return fusion.select_per_year(scores, "test_year", "model", ["primary_score", "second"], ok)
