"""Queries: sources, sinks, streams and provenance, run end to end on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import provenance, staging
from tidemark.plans.base import CALENDAR, PANEL, panel, query, r6, table
from tidemark.sources import readers, sinks
from tidemark.streaming import flows


@query("st_tumbling", "SELECT ts::DATE AS day, event_type, last(value ORDER BY ts, event_id) AS last_value, round(avg(value), 6) + 0 AS mean_value, count(*) AS n FROM events GROUP BY ALL")
def st_tumbling(spark: SparkSession, d: str) -> DataFrame:
    got = flows.drain(flows.tumbling(flows.read_events(spark, d)), "complete")
    return got.select(F.to_date("start").alias("day"), "event_type", "last_value", r6("mean_value").alias("mean_value"), "n")


@query("st_sliding", "WITH w AS (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR * i FOR i IN range(4)]) AS start, value FROM events) SELECT start::TIMESTAMP AS start, count(*) AS n, round(sum(value), 4) + 0 AS total FROM w GROUP BY ALL")
def st_sliding(spark: SparkSession, d: str) -> DataFrame:
    got = flows.drain(flows.sliding(flows.read_events(spark, d)), "complete")
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query("st_session", "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 12 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts)::TIMESTAMP AS start, count(*) AS n FROM s GROUP BY user_id, k")
def st_session(spark: SparkSession, d: str) -> DataFrame:
    got = flows.drain(flows.sessions(flows.read_events(spark, d)), "complete")
    return got.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("st_dedup_watermark", "SELECT DISTINCT user_id, props FROM events")
def st_dedup_watermark(spark: SparkSession, d: str) -> DataFrame:
    return flows.drain(flows.first_seen(flows.read_events(spark, d), "user_id", "props")).select("user_id", "props")


@query("st_moments", "WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) SELECT label, pos::INT AS pos, count(*) AS n, round(sum(x), 6) + 0 AS s, round(sum(x * x), 6) + 0 AS ss FROM x GROUP BY ALL")
def st_moments(spark: SparkSession, d: str) -> DataFrame:
    got = flows.drain(flows.class_moments(flows.read_events(spark, d, "embeddings"), "label", "embedding"), "complete")
    return got.select("label", "pos", "n", r6("s").alias("s"), r6("ss").alias("ss"))


@query("st_novelty", "WITH n AS (SELECT vec_id AS row, label AS asset, vec_id // 40 AS rank, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.row, round(list_cosine_similarity(a.v, b.v), 6) AS s FROM n a JOIN n b ON a.asset = b.asset AND b.rank BETWEEN a.rank - 5 AND a.rank AND b.row < a.row) SELECT n.row, max(s) + 0 AS max_prior FROM n LEFT JOIN p USING (row) GROUP BY n.row")
def st_novelty(spark: SparkSession, d: str) -> DataFrame:
    e = flows.read_events(spark, d, "embeddings")
    rows = e.select(F.col("vec_id").alias("row"), F.col("label").alias("asset"), F.floor(F.col("vec_id") / 40).alias("rank"), F.col("embedding").cast("array<double>").alias("v"))
    return flows.drain(flows.novelty(rows)).select("row", r6("max_prior").alias("max_prior"))


@query("st_holdings", f"WITH {PANEL}, {CALENDAR}, w AS (SELECT p.asset, p.date, (asset % 3 - 1) * 0.01::DOUBLE AS weight FROM panel p), g AS (SELECT asset, date, weight, row_number() OVER (PARTITION BY asset ORDER BY date) - 1 AS k FROM w) SELECT a.asset, a.date, round(sum(b.weight * CASE WHEN b.k = 0 THEN pow(0.5, a.k) ELSE 0.5 * pow(0.5, a.k - b.k) END), 6) + 0 AS target FROM g a JOIN g b ON a.asset = b.asset AND b.k <= a.k GROUP BY a.asset, a.date")
def st_holdings(spark: SparkSession, d: str) -> DataFrame:
    path = staging.folder(spark)
    panel(spark, d).select("asset", "date", ((F.col("asset") % 3 - 1) * 0.01).alias("weight")).write.parquet(path)
    stream = spark.readStream.schema("asset bigint, date date, weight double").parquet(path)
    return flows.drain(flows.holdings(stream, 0.5)).select("asset", "date", r6("target").alias("target"))


@query("st_append_numbered", "SELECT event_id, row_number() OVER (ORDER BY event_id) AS row_index FROM events")
def st_append_numbered(spark: SparkSession, d: str) -> DataFrame:
    path, marks = staging.folder(spark), staging.folder(spark)
    flows.append_numbered(flows.read_events(spark, d).select("event_id"), path, marks, "event_id").awaitTermination()
    return spark.read.parquet(path).select("event_id", "row_index")


@query("st_crawl", "WITH RECURSIVE e AS (SELECT s_suppkey AS a, (s_suppkey * 2 + 1) % (SELECT count(*) FROM supplier) AS b FROM supplier UNION SELECT s_suppkey, (s_suppkey * 3 + 2) % (SELECT count(*) FROM supplier) FROM supplier), r AS (SELECT 0::BIGINT AS url, 0 AS depth UNION SELECT e.b, depth + 1 FROM r JOIN e ON e.a = r.url WHERE depth < 4) SELECT url::VARCHAR AS url, min(depth)::INT AS depth FROM r GROUP BY url")
def st_crawl(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    n = s.agg(F.count(F.lit(1)).alias("n"))
    k = F.col("s_suppkey")
    pairs = s.join(n).select(k.cast("string").alias("source"), F.explode(F.array(((k * 2 + 1) % F.col("n")).cast("string"), ((k * 3 + 2) % F.col("n")).cast("string"))).alias("target")).distinct()
    return flows.crawl(pairs, spark.createDataFrame([("0",)], "url string"), 4).select("url", "depth")


@query("s_jsonl_split", "SELECT event_id, user_id, event_type FROM events WHERE event_id % 10 <> 0")
def s_jsonl_split(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines written with bad ones between them; the good come back."""
    path = staging.folder(spark)
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    e.select(F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{broken "), F.col("event_id").cast("string"))).otherwise(F.to_json(F.struct("*"))).alias("value")).write.text(path)
    good, _ = readers.read_jsonl_split(spark, path, "event_id bigint, user_id bigint, event_type string")
    return good.drop("source_path")


@query("s_csv_universe", "SELECT lpad((s_suppkey * 31 % 1000000)::VARCHAR, 6, '0') AS stock_id, s_name AS stock_name FROM supplier")
def s_csv_universe(spark: SparkSession, d: str) -> DataFrame:
    path = staging.folder(spark)
    table(spark, d, "supplier").select((F.col("s_suppkey") * 31 % 1000000).alias("﻿stock_id"), F.col("s_name").alias("stock_name")).write.csv(path, header=True)
    return readers.read_universe(spark, path)


@query("s_wide_scan", f"WITH {PANEL}, b AS (SELECT DISTINCT date FROM panel) SELECT date, 't' || asset AS ticker, close AS value FROM panel WHERE asset IN (1, 2, 3)")
def s_wide_scan(spark: SparkSession, d: str) -> DataFrame:
    """A matrix with one column a ticker, of which three are read."""
    path = staging.folder(spark)
    panel(spark, d).groupBy("date").pivot("asset", list(range(6))).agg(F.first("close")).toDF("date", *[f"t{i}" for i in range(6)]).write.parquet(path)
    return readers.read_wide(spark, path, "date", ["t1", "t2", "t3"])


@query("s_pooled_shards", "SELECT vec_id + 1 AS row_index, round(list_sum(embedding::DOUBLE[]), 5) + 0 AS total FROM embeddings")
def s_pooled_shards(spark: SparkSession, d: str) -> DataFrame:
    path = staging.folder(spark)
    rows = table(spark, d, "embeddings").select((F.col("vec_id") + 1).alias("row_index"), F.lit("m").alias("model"), F.lit("v").alias("variant"), F.lit("mean").alias("feature"), F.col("embedding").alias("vec"))
    sinks.write_table(sinks.modulo_shards(rows, 4), path, ["model", "variant"])
    got = readers.load_vectors(spark, path, "m", "v", "mean")
    return got.select("row_index", F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"))


@query("s_dual_sink", "SELECT CASE WHEN value < 1 THEN 'small' WHEN value > 100 THEN 'large' ELSE 'accepted' END AS reason, count(*) AS n FROM events GROUP BY ALL")
def s_dual_sink(spark: SparkSession, d: str) -> DataFrame:
    reason = F.when(F.col("value") < 1, "small").when(F.col("value") > 100, "large")
    a, r = staging.folder(spark), staging.folder(spark)
    counts = sinks.write_split(table(spark, d, "events"), reason, a, r)
    return spark.createDataFrame(list(counts.items()), "reason string, n long")


@query("s_numbered_rows", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS row_index FROM orders")
def s_numbered_rows(spark: SparkSession, d: str) -> DataFrame:
    return sinks.numbered(table(spark, d, "orders"), "o_orderdate", "o_orderkey").select("o_orderkey", "row_index")


@query("s_contiguous_shards", "WITH n AS (SELECT count(*) AS n FROM orders), r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders) SELECT shard, count(*) AS n_rows FROM (SELECT CASE WHEN k < (n % 7) * (n // 7 + 1) THEN k // (n // 7 + 1) ELSE n % 7 + (k - (n % 7) * (n // 7 + 1)) // (n // 7) END::INT AS shard FROM r, n) GROUP BY shard")
def s_contiguous_shards(spark: SparkSession, d: str) -> DataFrame:
    rows = sinks.numbered(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")
    return sinks.contiguous_shards(rows, 7, rows.count()).groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"))


@query("pv_completeness", "WITH g AS (SELECT DISTINCT o_orderpriority, s.st AS o_orderstatus FROM orders, (SELECT unnest(['F', 'O', 'P', 'X']) AS st) s) SELECT g.o_orderpriority, g.o_orderstatus, count(o.o_orderkey) AS n_done, count(o.o_orderkey) = 0 AS missing FROM g LEFT JOIN orders o USING (o_orderpriority, o_orderstatus) GROUP BY ALL")
def pv_completeness(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    expected = o.select("o_orderpriority").distinct().withColumn("o_orderstatus", F.explode(F.array(*[F.lit(x) for x in "FOPX"])))
    return provenance.completeness(expected, o, "o_orderpriority", "o_orderstatus")


@query("pv_publish", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def pv_publish(spark: SparkSession, d: str) -> DataFrame:
    """Rows are published with a manifest and read only if it fits the specification."""
    path, spec = staging.folder(spark), {"table": "nation", "version": 1}
    provenance.publish(table(spark, d, "nation"), path, spec)
    if not provenance.complete(spark, path, spec) or provenance.complete(spark, path, spec | {"version": 2}):
        raise RuntimeError("the manifest does not fit")
    return spark.read.parquet(f"{path}/rows")
