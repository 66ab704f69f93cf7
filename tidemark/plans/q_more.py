"""Queries: records, identities, votes, thresholds, clusterings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import clusters, learning, metrics, records, xsection
from tidemark.operators.windows import average_rank, pct_rank
from tidemark.plans.base import PANEL, SIGNALS, panel, query, r6, signals, table
from tidemark.plans.q_text import _labelled


@query("p_clean_articles", "WITH n AS (SELECT doc_id, CASE WHEN doc_id % 11 <> 0 THEN 1 END AS ok, source, length(trim(regexp_replace(text, ' +', ' ', 'g'))) AS n, trim(regexp_replace(text, ' +', ' ', 'g')) AS text FROM documents), e AS (SELECT doc_id, source, CASE WHEN ok IS NULL THEN 'invalid_time' WHEN NOT n BETWEEN 200 AND 20000 THEN 'invalid_length' END AS r, text FROM n), k AS (SELECT doc_id, r, row_number() OVER (PARTITION BY r IS NULL, source, text ORDER BY doc_id) AS rn FROM e) SELECT count(*) AS raw_rows, count(*) FILTER (r = 'invalid_time') AS invalid_time, count(*) FILTER (r = 'invalid_length') AS invalid_length, count(*) FILTER (r IS NULL AND rn > 1) AS duplicates, count(*) FILTER (r IS NULL AND rn = 1) AS clean_rows FROM k")
def p_clean_articles(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("article_id"), F.col("source").alias("stock_id"), F.lit("").alias("headline"), F.col("text").alias("content"), F.when(F.col("doc_id") % 11 != 0, "2024-01-02 03:04:05").otherwise("no time").alias("published"))
    _, counts = records.clean_articles(rows, 200, 20_000)
    return counts.drop("body_source_pdf")


@query("p_clean_news", "SELECT doc_id AS article_id, sha256('标题：' || source || '。正文：' || lang) AS text_hash, (TIMESTAMP '2024-01-02 16:00:00' - INTERVAL 8 HOUR)::TIMESTAMP AS at FROM documents")
def p_clean_news(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("article_id"), F.col("source").alias("stock_id"), F.lit("2024-01-02 16:00:00").alias("published_at"), F.col("source").alias("headline"), F.col("lang").alias("body"))
    twice = rows.unionByName(rows)
    return records.clean_news(twice, unicode=False).select("article_id", "text_hash", F.col("published_at").cast("timestamp_ntz").alias("at"))


@query("p_clean_bars", f"WITH {PANEL} SELECT lpad(asset::VARCHAR, 6, '0') AS stock_id, date, close FROM panel WHERE open > 1 AND high > 1 AND low > 1 AND close > 1")
def p_clean_bars(spark: SparkSession, d: str) -> DataFrame:
    rows = panel(spark, d).select(F.concat(F.col("asset").cast("string"), F.lit(".0")).alias("code"), F.col("date").cast("string").alias("day"), *[F.when(F.col(c) > 1, F.col(c).cast("string")).otherwise("-1").alias(c) for c in ("open", "high", "low", "close")])
    return records.clean_bars(rows, {"code": "stock_id", "day": "date"}).select("stock_id", "date", "close")


@query("p_document_id", "SELECT event_id, left(sha256(user_id || '|' || event_type || '|' || props), 32) AS document_id FROM events")
def p_document_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", records.document_id(F.col("user_id"), F.col("event_type"), F.col("props")).alias("document_id"))


@query("p_url_date", "WITH u AS (SELECT page_id, 'http://h.example/a/' || CASE page_id % 3 WHEN 0 THEN '2024-01-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') WHEN 1 THEN '202402' || lpad((page_id % 31 + 1)::VARCHAR, 2, '0') ELSE 'x' END || '/p.html' AS url, page_id % 28 + 1 AS d1, page_id % 31 + 1 AS d2 FROM pages) SELECT page_id, CASE page_id % 3 WHEN 0 THEN make_date(2024, 1, d1) WHEN 1 THEN CASE WHEN d2 <= 29 THEN make_date(2024, 2, d2) END END AS day FROM u")
def p_url_date(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    part = F.when(k % 3 == 0, F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"))).when(k % 3 == 1, F.concat(F.lit("202402"), F.lpad((k % 31 + 1).cast("string"), 2, "0"))).otherwise("x")
    return table(spark, d, "pages").select("page_id", records.url_date(F.concat(F.lit("http://h.example/a/"), part, F.lit("/p.html"))).alias("day"))


@query("p_page_reason", r"WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1) AS path, regexp_extract(html, '<title>([^<]*)', 1) AS title FROM pages) SELECT page_id, CASE WHEN regexp_matches(path, '^/es/') THEN 'spanish' WHEN regexp_matches(path, '\.html$') THEN 'static' WHEN regexp_matches(trim(title), '^The ') THEN 'the' END AS reason FROM p")
def p_page_reason(spark: SparkSession, d: str) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)", 1)
    return table(spark, d, "pages").select("page_id", records.page_reason(title, F.col("url"), {"spanish": "^/es/", "static": r"\.html$"}, {"the": "^The "}).alias("reason"))


@query("p_event_class", "SELECT doc_id, CASE WHEN strpos(text, 'ción') > 0 OR strpos(text, 'ñ') > 0 THEN 'iberian' WHEN strpos(text, 'ê') > 0 THEN 'gallic' ELSE 'other' END AS class FROM documents")
def p_event_class(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", records.labelled_by_words(F.col("text"), [("iberian", ("ción", "ñ")), ("gallic", ("ê",))]).alias("class"))


@query("dd_exploded_targets", "WITH e AS (SELECT o_orderkey, unnest([o_custkey % 50, o_custkey % 7]) AS target, o_orderpriority FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY target, o_orderpriority ORDER BY o_orderkey) AS r FROM (SELECT DISTINCT * FROM e)) SELECT o_orderkey, target, o_orderpriority FROM k WHERE r = 1")
def dd_exploded_targets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.array(F.col("o_custkey") % 50, F.col("o_custkey") % 7).alias("ids"))
    return records.exploded_targets(rows, "ids", ["o_orderpriority"], "o_orderkey").select("o_orderkey", "target", "o_orderpriority")


@query("x_prompt_variants", "SELECT item_id, 'plain' AS variant, sha256(text) AS prompt FROM benchmark UNION ALL SELECT item_id, 'framed', sha256('Item:' || chr(10) || text || chr(10) || 'End') FROM benchmark UNION ALL SELECT item_id, 'gap', sha256('Item:' || chr(10) || 'End') FROM benchmark")
def x_prompt_variants(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "benchmark").select("item_id", "text")
    got = records.prompt_variants(rows, {"plain": [F.col("text")], "framed": [F.lit("Item:"), F.col("text"), F.lit("End")], "gap": [F.lit("Item:"), F.lit(""), F.lit("End")]})
    return got.select("item_id", "variant", F.sha2("prompt", 256).alias("prompt"))


@query("x_span_positions", "WITH t AS (SELECT item_id, unnest(range(0, 12)) AS i FROM benchmark) SELECT item_id, list(i ORDER BY i)::INT[]::VARCHAR AS positions FROM t WHERE i * 5 < 23 AND i * 5 + 4 > 9 GROUP BY item_id")
def x_span_positions(spark: SparkSession, d: str) -> DataFrame:
    offsets = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.struct((i * 5).alias("start"), (i * 5 + 4).alias("end")))
    got = records.spans_to_positions(offsets, F.lit(9), F.lit(23))
    return table(spark, d, "benchmark").select("item_id", F.concat(F.lit("["), F.array_join(got.cast("array<string>"), ", "), F.lit("]")).alias("positions"))


@query("x_decode_pages")
def x_decode_pages(spark: SparkSession, d: str) -> DataFrame:
    """Bytes back to text: the pages' own bytes must give the pages."""
    p = table(spark, d, "pages")
    return p.select("page_id", records.decoded(F.encode("html", "utf-8")).alias("h"), "html").select("page_id", (F.col("h") == F.col("html")).alias("same"))


@query("t_diverse")
def t_diverse(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("lang", "doc_id", F.array_distinct(F.regexp_extract_all(F.split("text", "\n")[0], F.lit(r"[^\s]+"), 0)).alias("w"), F.char_length("text").cast("double").alias("s"))
    return records.diverse(rows, "lang", "doc_id", "w", "s", 10)


@query("t_fixed_n", f"WITH {SIGNALS}, c AS (SELECT *, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY pred DESC, asset) AS up FROM signals) SELECT date, asset FROM c WHERE up <= 10 AND n >= 20")
def t_fixed_n(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("date")
    rows = signals(spark, d).withColumns({"n": F.count(F.lit(1)).over(w), "up": F.row_number().over(w.orderBy(F.desc("pred"), "asset"))})
    return rows.where("up <= 10 and n >= 20").select("date", "asset")


@query("w_train_terciles", f"WITH {SIGNALS}, t AS (SELECT quantile_cont(pred, 1.0::DOUBLE / 3) AS a, quantile_cont(pred, 2.0::DOUBLE / 3) AS b FROM signals WHERE day(date) <= 15) SELECT asset, date, CASE WHEN pred <= a THEN 0 WHEN pred <= b THEN 1 ELSE 2 END AS bucket FROM signals, t WHERE day(date) > 15")
def w_train_terciles(spark: SparkSession, d: str) -> DataFrame:
    """Edges from the training days only."""
    s = signals(spark, d)
    edges = s.where(F.dayofmonth("date") <= 15).agg(F.percentile("pred", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("e"))
    rows = s.where(F.dayofmonth("date") > 15).join(edges)
    return rows.select("asset", "date", F.when(F.col("pred") <= F.col("e")[0], 0).when(F.col("pred") <= F.col("e")[1], 1).otherwise(2).alias("bucket"))


@query("w_pct_rank_multi", "SELECT l_orderkey, l_linenumber, round((rank() OVER w + (count(*) OVER (PARTITION BY l_returnflag, l_linestatus, l_suppkey, l_quantity) - 1) / 2) / count(*) OVER (PARTITION BY l_returnflag, l_linestatus, l_suppkey), 6) + 0 AS pct FROM lineitem WINDOW w AS (PARTITION BY l_returnflag, l_linestatus, l_suppkey ORDER BY l_quantity)")
def w_pct_rank_multi(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(pct_rank("l_quantity", ["l_returnflag", "l_linestatus", "l_suppkey"])).alias("pct"))


@query("a_vector_mean", "WITH x AS (SELECT vec_id % 7 AS day, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) SELECT day, label, pos::INT AS pos, round(avg(x), 6) + 0 AS mean FROM x GROUP BY ALL")
def a_vector_mean(spark: SparkSession, d: str) -> DataFrame:
    m = learning.moments(table(spark, d, "embeddings").withColumn("day", F.col("vec_id") % 7), ["day", "label"], "embedding")
    return m.select("day", "label", "pos", r6(F.col("s") / F.col("n")).alias("mean"))


@query("a_adjusted_rand", "WITH c AS (SELECT label AS a, (embedding[1] > 0)::INT + 2 * (embedding[2] > 0)::INT AS b, count(*)::DOUBLE AS n FROM embeddings GROUP BY ALL), s AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS t FROM c), x AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT sum(n) AS n FROM c GROUP BY a)), y AS (SELECT sum(n * (n - 1) / 2) AS y FROM (SELECT sum(n) AS n FROM c GROUP BY b)) SELECT round((s - x * y / (t * (t - 1) / 2)) / ((x + y) / 2 - x * y / (t * (t - 1) / 2)), 6) + 0 AS ari FROM s, x, y")
def a_adjusted_rand(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    rows = table(spark, d, "embeddings").select(F.col("label").alias("a"), ((e[0] > 0).cast("int") + 2 * (e[1] > 0).cast("int")).alias("b"))
    return clusters.adjusted_rand(rows, "a", "b").select(r6("ari").alias("ari"))


@query("a_daily_agreement", f"WITH {SIGNALS}, q AS (SELECT date, asset, pred AS u, round(pred * pred - 50 * asset, 6) AS v FROM signals), r AS (SELECT date, rank() OVER (PARTITION BY date ORDER BY u) + (count(*) OVER (PARTITION BY date, u) - 1) / 2 AS ru, rank() OVER (PARTITION BY date ORDER BY v) + (count(*) OVER (PARTITION BY date, v) - 1) / 2 AS rv FROM q), c AS (SELECT date, covar_pop(ru, rv) / nullif(stddev_pop(ru) * stddev_pop(rv), 0) AS s FROM r GROUP BY date) SELECT round(avg(s), 6) + 0 AS mean_daily, count(s) AS days FROM c")
def a_daily_agreement(spark: SparkSession, d: str) -> DataFrame:
    rows = signals(spark, d).withColumn("v", r6(F.col("pred") * F.col("pred") - 50 * F.col("asset")))
    rows = rows.withColumns({"ru": average_rank("pred", "date"), "rv": average_rank("v", "date")})
    return rows.groupBy("date").agg(xsection.correlation("ru", "rv").alias("s")).agg(r6(F.avg("s")).alias("mean_daily"), F.count("s").alias("days"))


@query("a_yearly_contribution", f"WITH {SIGNALS}, c AS (SELECT date_trunc('week', date)::DATE AS period, ((pred > 40) = (actual > 0))::INT AS a, ((pred > 45) = (actual > 0))::INT AS b FROM signals), y AS (SELECT period, avg(b) - avg(a) AS gain FROM c GROUP BY period) SELECT count(*) AS periods, count(*) FILTER (gain > 0) AS positive, round(avg(gain), 6) + 0 AS mean_gain FROM y")
def a_yearly_contribution(spark: SparkSession, d: str) -> DataFrame:
    right = lambda edge: ((F.col("pred") > edge) == (F.col("actual") > 0)).cast("double")
    each = signals(spark, d).groupBy(F.date_trunc("week", "date")).agg((F.avg(right(45)) - F.avg(right(40))).alias("gain"))
    return each.agg(F.count(F.lit(1)).alias("periods"), F.count_if(F.col("gain") > 0).alias("positive"), r6(F.avg("gain")).alias("mean_gain"))


@query("m_consensus", "WITH p AS (SELECT vec_id, [1 / (1 + exp(-20 * embedding[1]::DOUBLE)), 1 / (1 + exp(-20 * embedding[2]::DOUBLE)), 1 / (1 + exp(-20 * embedding[3]::DOUBLE))] AS p FROM embeddings) SELECT vec_id, CASE WHEN list_avg(p) >= 0.6 AND len(list_filter(p, lambda x: x >= 0.5)) >= 2 THEN 1 WHEN list_avg(p) <= 0.4 AND len(list_filter(p, lambda x: x < 0.5)) >= 2 THEN -1 ELSE 0 END AS vote FROM p")
def m_consensus(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", F.array(*[1 / (1 + F.exp(-20 * F.col("embedding")[i].cast("double"))) for i in range(3)]).alias("p"))
    return rows.select("vec_id", consensus(F.col("p"), 0.6, 2).alias("vote"))


def consensus(p, threshold: float, votes: int):
    """1 or -1 where the mean is past the threshold and enough single probabilities agree, else 0."""
    mean = F.aggregate(p, F.lit(0.0), lambda s, x: s + x) / F.size(p)
    up, down = F.size(F.filter(p, lambda x: x >= 0.5)), F.size(F.filter(p, lambda x: x < 0.5))
    return F.when((mean >= threshold) & (up >= votes), 1).when((mean <= 1 - threshold) & (down >= votes), -1).otherwise(0)


@query("m_standardised_l2", "WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), m AS (SELECT pos, avg(x) AS mu, greatest(stddev_pop(x), 0.000001) AS sd FROM x GROUP BY pos) SELECT vec_id, round(sqrt(sum(pow((x - mu) / sd, 2))), 6) + 0 AS distance FROM x JOIN m USING (pos) GROUP BY vec_id")
def m_standardised_l2(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    m = learning.moments(e.withColumn("k", F.lit(0)), ["k"], "embedding")
    sd = F.sqrt(F.greatest(F.col("ss") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2), F.lit(0.0)))
    stats_ = m.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", (F.col("s") / F.col("n")).alias("mu"), F.greatest(sd, F.lit(1e-6)).alias("sd")))), lambda z: F.struct(z["mu"].alias("mu"), z["sd"].alias("sd"))).alias("m"))
    far = F.sqrt(F.aggregate(F.zip_with("embedding", "m", lambda x, z: F.pow((x.cast("double") - z["mu"]) / z["sd"], 2)), F.lit(0.0), lambda s, x: s + x))
    return e.join(stats_).select("vec_id", r6(far).alias("distance"))


@query("k_paired_comparison")
def k_paired_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy of two models: a bootstrap over dates from each date's counts, and the exact McNemar test."""
    from tidemark.operators import stats

    s = signals(spark, d)
    hit = lambda edge: ((F.col("pred") > edge) == (F.col("actual") > 0)).cast("double")
    days = s.groupBy("date").agg(F.sum(hit(45) - hit(40)).alias("gain"), F.count(F.lit(1)).alias("n"), F.sum(hit(40) * (1 - hit(45))).alias("a"), F.sum(hit(45) * (1 - hit(40))).alias("b")).orderBy("date").toPandas()
    delta, low, high = stats.cluster_bootstrap(days["gain"].to_numpy(), days["n"].to_numpy())
    a, b = int(days["a"].sum()), int(days["b"].sum())
    return spark.createDataFrame([(delta, low, high, a, b, stats.mcnemar(a, b))], "delta double, low double, high double, only_a int, only_b int, p_value double")


@query("l_choose_k")
def l_choose_k(spark: SparkSession, d: str) -> DataFrame:
    rows = _labelled(spark, d).cache()
    best, tried = clusters.choose_k(rows.where("year < 6"), rows.where("year >= 6"), (2, 3), seeds=(1, 2))
    return spark.createDataFrame([(r["k"], r["silhouette"], r["ari"], r["k"] == best) for r in tried], "k int, silhouette double, ari double, chosen boolean")


@query("a_inconsistent_labels", "SELECT o_custkey, count(*) AS n, round(max(o_totalprice) - min(o_totalprice), 6) + 0 AS spread FROM orders GROUP BY o_custkey HAVING max(o_totalprice) - min(o_totalprice) > 1e-12")
def a_inconsistent_labels(spark: SparkSession, d: str) -> DataFrame:
    return metrics.inconsistent(table(spark, d, "orders"), ["o_custkey"], "o_totalprice").select("o_custkey", "n", r6("spread").alias("spread"))
