"""Queries: aggregations, scores, tests and portfolios."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import metrics, portfolio, stats, xsection
from tidemark.operators.calendar import trading_calendar
from tidemark.plans.base import CALENDAR, PANEL, SIGNALS, panel, query, r6, signals, table
from tidemark.staging import settle

# ---- aggregations --------------------------------------------------------------------------------------------


@query("a_stock_day", "SELECT user_id AS asset, ts::DATE AS date, round(avg(value), 6) + 0 AS prediction, count(*) AS n_documents, user_id % 3 + 0.5::DOUBLE AS target FROM events GROUP BY ALL")
def a_stock_day(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("asset"), F.to_date("ts").alias("date"), "value", (F.col("user_id") % 3 + F.lit(0.5)).cast("double").alias("y"))
    return metrics.stock_day(e, ["asset", "date"], "value", "y").select("asset", "date", r6("prediction").alias("prediction"), "n_documents", "target")


@query("a_inconsistent_keys", "SELECT user_id, ts::DATE AS date, round(max(value) - min(value), 6) + 0 AS spread, count(*) AS n FROM events GROUP BY ALL HAVING max(value) - min(value) > 10")
def a_inconsistent_keys(spark: SparkSession, d: str) -> DataFrame:
    got = metrics.inconsistent(table(spark, d, "events").withColumn("date", F.to_date("ts")), ["user_id", "date"], "value", 10.0)
    return got.select("user_id", "date", r6("spread").alias("spread"), "n")


@query("a_intraday_last_mean", "SELECT user_id, ts::DATE AS date, last(value ORDER BY ts, event_id) AS last_value, round(avg(value), 6) + 0 AS mean_value FROM events GROUP BY ALL")
def a_intraday_last_mean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("date")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("last_value"), r6(F.avg("value")).alias("mean_value"))


@query("a_winsor_moments", f"WITH {SIGNALS} SELECT date, count(*) AS market_n, round(avg(actual), 6) + 0 AS market_mean, round(stddev_samp(actual), 6) + 0 AS market_std, round(quantile_cont(actual, 0.01), 6) + 0 AS lo, round(quantile_cont(actual, 0.99), 6) + 0 AS hi FROM signals GROUP BY date HAVING count(*) >= 5")
def a_winsor_moments(spark: SparkSession, d: str) -> DataFrame:
    got = xsection.market_moments(signals(spark, d), "date", "actual", 0.01, 0.99, 5).where("market_mean is not null")
    return got.select("date", "market_n", *[r6(c).alias(c) for c in ("market_mean", "market_std", "lo", "hi")])


@query("a_market_return", f"WITH {SIGNALS} SELECT date, round(avg(actual), 6) + 0 AS market, count(*) AS n FROM signals GROUP BY date")
def a_market_return(spark: SparkSession, d: str) -> DataFrame:
    return signals(spark, d).groupBy("date").agg(r6(F.avg("actual")).alias("market"), F.count(F.lit(1)).alias("n"))


@query("a_pivot_year_type", "SELECT year(o_orderdate)::INT AS y, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '2-HIGH') AS high, count(*) FILTER (o_orderpriority = '5-LOW') AS low FROM orders GROUP BY ALL")
def a_pivot_year_type(spark: SparkSession, d: str) -> DataFrame:
    kinds = {"1-URGENT": "urgent", "2-HIGH": "high", "5-LOW": "low"}
    wide = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y")).pivot("o_orderpriority", list(kinds)).count()
    return wide.select("y", *[F.coalesce(f"`{k}`", F.lit(0)).cast("long").alias(v) for k, v in kinds.items()])


@query("a_unpivot", "SELECT l_orderkey, l_linenumber, 'discount' AS field, l_discount AS x FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'tax', l_tax FROM lineitem")
def a_unpivot(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return rows.unpivot(["l_orderkey", "l_linenumber"], ["discount", "tax"], "field", "x")


@query("a_argmax", "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS o_orderkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY o_custkey")
def a_argmax(spark: SparkSession, d: str) -> DataFrame:
    return metrics.argmax_row(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", "o_orderkey")


@query("a_weighted_mean", "SELECT l_returnflag, l_linestatus, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) + 0 AS discount, sum(l_quantity)::DOUBLE AS quantity FROM lineitem GROUP BY ALL")
def a_weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(r6(metrics.weighted_mean("l_discount", "l_quantity")).alias("discount"), F.sum("l_quantity").alias("quantity"))


@query("a_topk_counts", "SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL ORDER BY n DESC, p_type, p_brand LIMIT 20")
def a_topk_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_type", "p_brand").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p_type", "p_brand").limit(20)


@query("a_coverage", "SELECT year(l_shipdate)::INT AS y, count(*) AS n_rows, count(*) FILTER (l_returnflag = 'R') AS returned, round(count(*) FILTER (l_returnflag = 'R') / count(*), 6) + 0 AS share FROM lineitem GROUP BY ALL")
def a_coverage(spark: SparkSession, d: str) -> DataFrame:
    back = F.count_if(F.col("l_returnflag") == "R")
    return table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("y")).agg(F.count(F.lit(1)).alias("n_rows"), back.alias("returned"), r6(back / F.count(F.lit(1))).alias("share"))


@query("a_rollup", "SELECT l_returnflag, year(l_shipdate)::INT AS y, count(*) AS n, round(sum(l_extendedprice), 2) + 0 AS price FROM lineitem GROUP BY ROLLUP (l_returnflag, year(l_shipdate)::INT)")
def a_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").withColumn("y", F.year("l_shipdate")).rollup("l_returnflag", "y").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("a_distribution", "SELECT event_type, round(avg(value), 6) + 0 AS mean, round(median(value), 6) + 0 AS middle, round(stddev_pop(value), 6) + 0 AS sd, round(quantile_cont(value, 0.05), 6) + 0 AS q05, round(quantile_cont(value, 0.95), 6) + 0 AS q95, max(value) AS most FROM events GROUP BY event_type")
def a_distribution(spark: SparkSession, d: str) -> DataFrame:
    q = F.percentile("value", F.array(F.lit(0.05), F.lit(0.95)))
    rows = table(spark, d, "events").groupBy("event_type").agg(r6(F.avg("value")).alias("mean"), r6(F.median("value")).alias("middle"), r6(F.stddev_pop("value")).alias("sd"), q.alias("q"), F.max("value").alias("most"))
    return rows.select("event_type", "mean", "middle", "sd", r6(F.col("q")[0]).alias("q05"), r6(F.col("q")[1]).alias("q95"), "most")


@query("a_index_membership", "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ';' ORDER BY o_orderpriority) AS memberships FROM orders GROUP BY o_custkey")
def a_index_membership(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ";").alias("memberships"))


@query("a_leave_one_out", "WITH g AS (SELECT c_mktsegment, avg(c_acctbal) AS m, count(*) AS n FROM customer GROUP BY 1) SELECT c_mktsegment, round(m, 6) + 0 AS mean, n, round((sum(m * n) OVER () - m * n) / (sum(n) OVER () - n), 6) + 0 AS others FROM g")
def a_leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    return metrics.leave_one_group_out(table(spark, d, "customer"), "c_mktsegment", "c_acctbal").select("c_mktsegment", r6("mean").alias("mean"), "n", r6("others").alias("others"))


@query("a_stability", f"WITH {SIGNALS}, r AS (SELECT asset % 4 AS grp, date, avg(actual) AS x FROM signals GROUP BY ALL) SELECT grp, count(*) AS n_runs, round(avg(x), 6) + 0 AS x_mean, round(coalesce(stddev_samp(x), 0), 6) + 0 AS x_std, round(min(x), 6) + 0 AS x_min, round(max(x), 6) + 0 AS x_max FROM r GROUP BY grp")
def a_stability(spark: SparkSession, d: str) -> DataFrame:
    runs = signals(spark, d).groupBy((F.col("asset") % 4).alias("grp"), "date").agg(F.avg("actual").alias("x"))
    return metrics.stability(runs, ["grp"], ["x"]).select("grp", "n_runs", *[r6(c).alias(c) for c in ("x_mean", "x_std", "x_min", "x_max")])


@query("a_gate_audit", "WITH w AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), s AS (SELECT vec_id, pos, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS p FROM w) SELECT round(avg(h), 6) + 0 AS entropy, round(avg(h) / ln(64), 6) + 0 AS normalised, count(*) AS n_rows FROM (SELECT vec_id, -sum(p * ln(p)) AS h FROM s GROUP BY vec_id)")
def a_gate_audit(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.functions.vectors import softmax

    rows = table(spark, d, "embeddings").select(stats.entropy(softmax(F.col("embedding").cast("array<double>"))).alias("h"))
    return rows.agg(r6(F.avg("h")).alias("entropy"), r6(F.avg("h") / F.log(F.lit(64.0))).alias("normalised"), F.count(F.lit(1)).alias("n_rows"))


_PROB = f"{SIGNALS}, probs AS (SELECT date, asset, (actual > 0)::INT::DOUBLE AS y, round(pred / (pred + 40), 6) AS p, actual, pred FROM signals)"


def _probs(spark: SparkSession, d: str) -> DataFrame:
    s = signals(spark, d)
    return s.withColumns({"y": (F.col("actual") > 0).cast("double"), "p": r6(F.col("pred") / (F.col("pred") + 40))})


@query("a_classification_metrics", f"""WITH {_PROB}, c AS (SELECT *, (p > 0.5)::INT AS h, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS r FROM probs),
 g AS (SELECT count(*)::DOUBLE AS n, sum(y * h) AS tp, sum((1 - y) * h) AS fp, sum(y * (1 - h)) AS fn, sum((1 - y) * (1 - h)) AS tn, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS ll, avg((p - y) * (p - y)) AS brier, sum(r * y) AS ranks FROM c)
 SELECT n, round(ll, 6) + 0 AS log_loss, round(brier, 6) + 0 AS brier, round((tp + fn) / n, 6) + 0 AS positive_rate, round((tp + tn) / n, 6) + 0 AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) + 0 AS balanced_accuracy, round(tp / (tp + fp), 6) + 0 AS precision,
 round(tp / (tp + fn), 6) + 0 AS recall, round(tn / (tn + fp), 6) + 0 AS specificity, round(2 * tp / (2 * tp + fp + fn), 6) + 0 AS f1, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) + 0 AS mcc,
 round((ranks - (tp + fn) * (tp + fn + 1) / 2) / ((tp + fn) * (tn + fp)), 6) + 0 AS auc, round(greatest((tp + fn) / n, 1 - (tp + fn) / n), 6) + 0 AS majority_accuracy, round((tp + fp) / n, 6) + 0 AS predicted_positive_rate, round((tp + tn) / n - greatest((tp + fn) / n, 1 - (tp + fn) / n), 6) + 0 AS lift FROM g""")
def a_classification_metrics(spark: SparkSession, d: str) -> DataFrame:
    got = metrics.binary_scores(_probs(spark, d), "y", "p")
    return got.select("n", *[r6(c).alias(c) for c in got.columns if c != "n"])


@query("a_auc_exact", "WITH s AS (SELECT l.quality AS y, length(d.text)::DOUBLE AS s FROM documents d JOIN labels l USING (doc_id)), r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS r FROM s) SELECT count(*) AS n, round((sum(r * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) + 0 AS auc FROM r")
def a_auc_exact(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.windows import average_rank

    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.col("quality").alias("y"), F.char_length("text").alias("s"), F.lit(1).alias("k"))
    rows = rows.withColumn("r", average_rank("s", "k"))
    p, n = F.sum("y"), F.count(F.lit(1))
    return rows.agg(n.alias("n"), r6((F.sum(F.col("r") * F.col("y")) - p * (p + 1) / 2) / (p * (n - p))).alias("auc"))


@query("a_auc_by_day", f"""WITH {_PROB}, c AS (SELECT date, y, rank() OVER (PARTITION BY date ORDER BY p) + (count(*) OVER (PARTITION BY date, p) - 1) / 2 AS r FROM probs), g AS (SELECT date, sum(y) AS p, count(*) - sum(y) AS n, sum(r * y) AS ranks FROM c GROUP BY date)
 SELECT date, CASE WHEN p > 0 AND n > 0 THEN round((ranks - p * (p + 1) / 2) / (p * n), 6) + 0 END AS auc FROM g""")
def a_auc_by_day(spark: SparkSession, d: str) -> DataFrame:
    return metrics.binary_scores(_probs(spark, d), "y", "p", "date").select("date", r6("auc").alias("auc"))


@query("a_regression_metrics", f"WITH {SIGNALS}, e AS (SELECT actual AS a, pred / 40 - 1 AS p FROM signals) SELECT count(*) AS n, round(avg((p - a) * (p - a)), 6) + 0 AS mse, round(sqrt(avg((p - a) * (p - a))), 6) + 0 AS rmse, round(avg(abs(p - a)), 6) + 0 AS mae, round(1 - sum((p - a) * (p - a)) / (var_pop(a) * count(*)), 6) + 0 AS r2, round(covar_pop(a, p) / (stddev_pop(a) * stddev_pop(p)), 6) + 0 AS pearson, round(avg((sign(a) = sign(p))::INT), 6) + 0 AS sign_accuracy FROM e")
def a_regression_metrics(spark: SparkSession, d: str) -> DataFrame:
    got = metrics.regression_scores(signals(spark, d).withColumn("p", F.col("pred") / 40 - 1), "actual", "p")
    return got.select("n", *[r6(c).alias(c) for c in got.columns if c != "n"])


@query("a_losses", f"WITH {_PROB}, l AS (SELECT date, -(y * ln(p) + (1 - y) * ln(1 - p)) AS log_loss, (p - y) * (p - y) AS brier, ((p > 0.5)::INT <> y)::INT AS zero_one, abs(pred / 40 - 1 - actual) AS e FROM probs) SELECT date, round(avg(log_loss), 6) + 0 AS log_loss, round(avg(brier), 6) + 0 AS brier, round(avg(zero_one), 6) + 0 AS zero_one, round(avg(e * e), 6) + 0 AS squared, round(avg(e), 6) + 0 AS absolute, round(avg(CASE WHEN e <= 0.5 THEN e * e / 2 ELSE 0.5 * (e - 0.25) END), 6) + 0 AS huber FROM l GROUP BY date")
def a_losses(spark: SparkSession, d: str) -> DataFrame:
    cells = metrics.binary_losses(F.col("y"), F.col("p")) | metrics.regression_losses(F.col("actual"), F.col("pred") / 40 - 1, 0.5)
    return _probs(spark, d).groupBy("date").agg(*[r6(F.avg(v)).alias(k) for k, v in cells.items()])


@query("a_qlike", f"WITH {PANEL}, v AS (SELECT high * high / 100 + 0.01 AS a, close * close / 100 + 0.01 AS p FROM panel) SELECT round(avg(a / p - ln(a / p) - 1), 6) + 0 AS qlike, count(*) AS n FROM v")
def a_qlike(spark: SparkSession, d: str) -> DataFrame:
    a, p = F.col("high") * F.col("high") / 100 + 0.01, F.col("close") * F.col("close") / 100 + 0.01
    return panel(spark, d).agg(r6(F.avg(metrics.qlike(a, p))).alias("qlike"), F.count(F.lit(1)).alias("n"))


# ---- tests ---------------------------------------------------------------------------------------------------

_MODELS = f"{SIGNALS}, m AS (SELECT 'a' AS model, date, abs(pred / 40 - 1 - actual) AS loss FROM signals UNION ALL SELECT 'b', date, abs(0.5 - actual) FROM signals UNION ALL SELECT 'c', date, abs(pred / 80 - actual) FROM signals), l AS (SELECT date, model, avg(loss) AS loss FROM m GROUP BY ALL)"


def _model_losses(spark: SparkSession, d: str) -> DataFrame:
    s = signals(spark, d)
    cells = {"a": F.col("pred") / 40 - 1, "b": F.lit(0.5), "c": F.col("pred") / 80}
    long = s.select("date", F.explode(F.create_map(*[x for k, v in cells.items() for x in (F.lit(k), F.abs(v - F.col("actual")))])).alias("model", "loss"))
    return long.groupBy("date", "model").agg(F.avg("loss").alias("loss"))


@query("k_daily_loss", f"WITH {_MODELS} SELECT date, round(max(loss) FILTER (model = 'a'), 6) + 0 AS a, round(max(loss) FILTER (model = 'b'), 6) + 0 AS b, round(max(loss) FILTER (model = 'c'), 6) + 0 AS c FROM l GROUP BY date")
def k_daily_loss(spark: SparkSession, d: str) -> DataFrame:
    wide = _model_losses(spark, d).groupBy("date").pivot("model", ["a", "b", "c"]).agg(F.max("loss")).dropna()
    return wide.select("date", *[r6(c).alias(c) for c in "abc"])


@query("k_dm_stat", f"""WITH {_MODELS}, p AS (SELECT x.model AS a, y.model AS b, x.date, x.loss - y.loss AS v FROM l x JOIN l y ON x.date = y.date AND x.model < y.model), c AS (SELECT *, v - avg(v) OVER (PARTITION BY a, b) AS c FROM p),
 t AS (SELECT a, b, v, c * c + 2 * (2 / 3) * coalesce(c * lag(c, 1) OVER w, 0) + 2 * (1 / 3) * coalesce(c * lag(c, 2) OVER w, 0) AS t FROM c WINDOW w AS (PARTITION BY a, b ORDER BY date)), g AS (SELECT a, b, count(*) AS n, avg(v) AS mean, greatest(avg(t), 0) AS lrv FROM t GROUP BY ALL)
 SELECT a, b, n, round(mean, 6) + 0 AS mean, round(lrv, 6) + 0 AS lrv, round(mean / sqrt(lrv / n) * sqrt((n + 1 - 2) / n), 5) + 0 AS statistic FROM g""")
def k_dm_stat(spark: SparkSession, d: str) -> DataFrame:
    got = stats.dm_statistics(_model_losses(spark, d), "date", "model", "loss", lag=2)
    return got.select("a", "b", "n", r6("mean").alias("mean"), r6("lrv").alias("lrv"), F.round("statistic", 5).alias("statistic"))


@query("k_dm_adjusted")
def k_dm_adjusted(spark: SparkSession, d: str) -> DataFrame:
    """p-values need Student's t, which DuckDB lacks; tests hold them against known values."""
    return stats.pairwise_dm(_model_losses(spark, d), "date", "model", "loss", lag=2)


@query("k_holm_bh", "WITH p AS (SELECT s_nationkey AS family, s_suppkey AS id, (s_suppkey * 37 % 1000 + 1) / 20000 AS p FROM supplier), r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p) AS k, count(*) OVER (PARTITION BY family) AS n FROM p) SELECT id, round(least(1, max((n - k + 1) * p) OVER (PARTITION BY family ORDER BY k)), 6) + 0 AS holm, round(least(1, min(n / k * p) OVER (PARTITION BY family ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) + 0 AS bh FROM r")
def k_holm_bh(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").select(F.col("s_nationkey").alias("family"), F.col("s_suppkey").alias("id"), ((F.col("s_suppkey") * 37 % 1000 + 1) / 20000).alias("p"))
    return stats.adjust(rows, "p", "family").select("id", r6("holm").alias("holm"), r6("bh").alias("bh"))


@query("k_mcs")
def k_mcs(spark: SparkSession, d: str) -> DataFrame:
    losses = settle(_model_losses(spark, d))
    rows = [s | {"method": m} for m in ("range", "max", "best") for s in stats.confidence_set(losses, "date", "model", "loss", reps=500, method=m)]
    return spark.createDataFrame(pd.DataFrame(rows))


@query("k_ic_difference")
def k_ic_difference(spark: SparkSession, d: str) -> DataFrame:
    """Daily rank correlations of two signals, paired by day: their mean difference with a moving-block interval."""
    s = signals(spark, d)
    both = s.select("date", "actual", F.explode(F.create_map(F.lit("a"), F.col("pred"), F.lit("b"), F.pmod(F.col("asset") * 7919, F.lit(101)).cast("double"))).alias("model", "x"))
    daily = xsection.daily_ic(both, "date", "actual", "x", by=["model"])
    return spark.createDataFrame([stats.paired_difference(daily, "date", "model", "ic", "a", "b")], "delta double, low double, high double")


@query("k_bootstrap_ic")
def k_bootstrap_ic(spark: SparkSession, d: str) -> DataFrame:
    ic = xsection.daily_ic(signals(spark, d), "date", "actual", "pred").orderBy("date").toPandas()["ic"].to_numpy()
    rows = [(name, *stats.bootstrap_mean(ic, circular=c)) for name, c in (("circular", True), ("moving", False))]
    return spark.createDataFrame(rows, "scheme string, mean double, low double, high double")


@query("k_cluster_bootstrap")
def k_cluster_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    got = _probs(spark, d).groupBy("date").agg(F.sum(((F.col("p") > 0.5).cast("double") == F.col("y")).cast("double")).alias("s"), F.count(F.lit(1)).alias("n")).orderBy("date").toPandas()
    return spark.createDataFrame([stats.cluster_bootstrap(got["s"].to_numpy(), got["n"].to_numpy())], "accuracy double, low double, high double")


@query("k_paired_signs", f"WITH {_MODELS}, w AS (SELECT date, max(loss) FILTER (model = 'a') AS a, max(loss) FILTER (model = 'b') AS b FROM l GROUP BY date) SELECT count(*) FILTER (a < b) AS a_better, count(*) FILTER (b < a) AS b_better, count(*) FILTER (a = b) AS ties FROM w")
def k_paired_signs(spark: SparkSession, d: str) -> DataFrame:
    wide = _model_losses(spark, d).groupBy("date").pivot("model", ["a", "b"]).agg(F.max("loss"))
    return wide.agg(F.count_if(F.expr("a < b")).alias("a_better"), F.count_if(F.expr("b < a")).alias("b_better"), F.count_if(F.expr("a = b")).alias("ties"))


@query("k_factor_agreement", f"""WITH {SIGNALS}, f AS (SELECT 'p' AS f, date, asset, pred AS x FROM signals UNION ALL SELECT 'q', date, asset, round(pred * pred - 50 * asset, 6) FROM signals UNION ALL SELECT 'r', date, asset, round(100 - pred, 6) FROM signals), j AS (SELECT x.f AS a, y.f AS b, x.date, x.x AS u, y.x AS v FROM f x JOIN f y ON x.date = y.date AND x.asset = y.asset AND x.f < y.f),
 r AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY u) + (count(*) OVER (PARTITION BY a, b, u) - 1) / 2 AS ru, rank() OVER (PARTITION BY a, b ORDER BY v) + (count(*) OVER (PARTITION BY a, b, v) - 1) / 2 AS rv FROM j) SELECT a, b, count(*) AS n, round(covar_pop(ru, rv) / (stddev_pop(ru) * stddev_pop(rv)), 6) + 0 AS spearman FROM r GROUP BY ALL""")
def k_factor_agreement(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.windows import average_rank

    s = signals(spark, d)
    long = s.select("date", "asset", F.explode(F.create_map(F.lit("p"), F.col("pred"), F.lit("q"), r6(F.col("pred") * F.col("pred") - 50 * F.col("asset")), F.lit("r"), r6(100 - F.col("pred")))).alias("f", "x"))
    left, right = long.select("date", "asset", F.col("f").alias("a"), F.col("x").alias("u")), long.select("date", "asset", F.col("f").alias("b"), F.col("x").alias("v"))
    rows = left.join(right, ["date", "asset"]).where("a < b")
    rows = rows.withColumns({"ru": average_rank("u", ["a", "b"]), "rv": average_rank("v", ["a", "b"])})
    return rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), r6(xsection.correlation("ru", "rv")).alias("spearman"))


# ---- portfolios ------------------------------------------------------------------------------------------------

_BUCKET = f"{SIGNALS}, b AS (SELECT *, count(*) OVER (PARTITION BY date) AS n, greatest(0, ceil((row_number() OVER (PARTITION BY date ORDER BY pred, asset) - 1) * 5 / greatest(count(*) OVER (PARTITION BY date) - 1, 1))::INT - 1) AS bucket FROM signals)"


@query("b_quantile", f"WITH {_BUCKET} SELECT date, {', '.join(f'round(avg(actual) FILTER (bucket = {i}), 6) + 0 AS q{i + 1}' for i in range(5))}, round(avg(actual) FILTER (bucket = 4) - avg(actual) FILTER (bucket = 0), 6) + 0 AS long_short, count(*) AS n FROM b WHERE n >= 5 GROUP BY date")
def b_quantile(spark: SparkSession, d: str) -> DataFrame:
    got = portfolio.quantile_portfolio(signals(spark, d), "date", "asset", "pred", "actual")
    return got.select("date", *[r6(c).alias(c) for c in ("q1", "q2", "q3", "q4", "q5", "long_short")], "n")


@query("b_terciles", f"WITH {SIGNALS}, b AS (SELECT *, count(*) OVER (PARTITION BY date) AS n, greatest(0, ceil((row_number() OVER (PARTITION BY date ORDER BY pred, asset) - 1) * 3 / greatest(count(*) OVER (PARTITION BY date) - 1, 1))::INT - 1) AS bucket FROM signals) SELECT date, round(avg(actual) FILTER (bucket = 2) - avg(actual) FILTER (bucket = 0), 6) + 0 AS spread FROM b WHERE n >= 3 GROUP BY date")
def b_terciles(spark: SparkSession, d: str) -> DataFrame:
    return portfolio.quantile_portfolio(signals(spark, d), "date", "asset", "pred", "actual", 3).select("date", r6("long_short").alias("spread"))


_W = f"{_BUCKET}, w AS (SELECT date, asset, CASE WHEN bucket = 4 THEN 1.0::DOUBLE / count(*) OVER (PARTITION BY date, bucket) ELSE -1.0::DOUBLE / count(*) OVER (PARTITION BY date, bucket) END AS weight FROM b WHERE n >= 5 AND bucket IN (0, 4))"


@query("b_sleeves", f"WITH {_W} SELECT date, asset, round(weight, 6) + 0 AS weight FROM w")
def b_sleeves(spark: SparkSession, d: str) -> DataFrame:
    return portfolio.sleeve_weights(signals(spark, d), "date", "asset", "pred", portfolio.Strategy()).select("date", "asset", r6("weight").alias("weight"))


@query("b_value_sleeves", f"WITH {_BUCKET}, c AS (SELECT b.date, b.asset, bucket, volume FROM b JOIN panel USING (asset, date) WHERE n >= 5 AND bucket IN (0, 4)) SELECT date, asset, round(CASE WHEN bucket = 4 THEN 1 ELSE -1 END * volume / sum(volume) OVER (PARTITION BY date, bucket), 6) + 0 AS weight FROM c")
def b_value_sleeves(spark: SparkSession, d: str) -> DataFrame:
    rows = signals(spark, d).join(panel(spark, d).select("asset", "date", "volume"), ["asset", "date"])
    got = portfolio.sleeve_weights(rows, "date", "asset", "pred", portfolio.Strategy(value_weighted=True), "volume")
    return got.select("date", "asset", r6("weight").alias("weight"))


@query("b_ewct_targets", f"WITH {_W}, d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k FROM (SELECT DISTINCT date FROM w)), g AS (SELECT a.asset, d.date, d.k, s.k AS j, w.weight FROM (SELECT DISTINCT asset FROM w) a, d JOIN d s ON s.k <= d.k JOIN w ON w.asset = a.asset AND w.date = s.date), t AS (SELECT date, asset, sum(weight * CASE WHEN j = 0 THEN pow(0.7, k) ELSE 0.3 * pow(0.7, k - j) END) AS target FROM g GROUP BY ALL) SELECT date, asset, round(target + 1e-9, 6) + 0 AS target FROM t WHERE abs(target) > 0.00001")
def b_ewct_targets(spark: SparkSession, d: str) -> DataFrame:
    w = portfolio.sleeve_weights(signals(spark, d), "date", "asset", "pred", portfolio.Strategy())
    return portfolio.targets(w, "date", "asset", 0.3).where("abs(target) > 0.00001").select("date", "asset", r6(F.col("target") + 1e-9).alias("target"))


@query("b_long_only_cost", f"WITH {_BUCKET}, {CALENDAR}, w AS (SELECT date, asset, 1.0::DOUBLE / count(*) OVER (PARTITION BY date) AS weight, actual FROM b WHERE n >= 5 AND bucket = 4), c AS (SELECT w.*, rank FROM w JOIN cal USING (date)), x AS (SELECT n.date, n.weight, 0::DOUBLE AS old FROM c n LEFT JOIN c p ON p.asset = n.asset AND p.rank = n.rank - 1 WHERE p.asset IS NULL UNION ALL SELECT n.date, n.weight, p.weight FROM c n JOIN c p ON p.asset = n.asset AND p.rank = n.rank - 1 UNION ALL SELECT k.date, 0, p.weight FROM c p JOIN cal k ON k.rank = p.rank + 1 LEFT JOIN c n ON n.asset = p.asset AND n.rank = p.rank + 1 WHERE n.asset IS NULL), t AS (SELECT date, sum(greatest(weight - old, 0)) AS buys, sum(greatest(old - weight, 0)) AS sells FROM x GROUP BY date), r AS (SELECT date, sum(weight * actual) AS gross FROM w GROUP BY date) SELECT date, round(coalesce(gross, 0), 6) + 0 AS gross, round(buys, 6) + 0 AS buys, round(sells, 6) + 0 AS sells, round(coalesce(gross, 0) - buys * 0.0005 - sells * 0.001, 6) + 0 AS net FROM t LEFT JOIN r USING (date)")
def b_long_only_cost(spark: SparkSession, d: str) -> DataFrame:
    """Buys at 5 and sales at 10 basis points; the day after the last signal pays the liquidation."""
    s = signals(spark, d)
    w = portfolio.sleeve_weights(s, "date", "asset", "pred", portfolio.Strategy(sides="long"))
    trades = portfolio.turnover(w, trading_calendar(panel(spark, d)), "date", "asset")
    gross = w.join(s.select("date", "asset", "actual"), ["date", "asset"]).groupBy("date").agg(F.sum(F.col("weight") * F.col("actual")).alias("gross"))
    rows = trades.join(gross, "date", "left").withColumn("gross", F.coalesce("gross", F.lit(0.0)))
    return rows.select("date", *[r6(c).alias(c) for c in ("gross", "buys", "sells")], r6(F.col("gross") - F.col("buys") * 0.0005 - F.col("sells") * 0.001).alias("net"))


@query("b_metrics", f"WITH {_BUCKET}, d AS (SELECT date, (avg(actual) FILTER (bucket = 4) - avg(actual) FILTER (bucket = 0)) / 100 AS r FROM b WHERE n >= 5 GROUP BY date), c AS (SELECT date, r, product(1 + r) OVER (ORDER BY date) AS w FROM d), p AS (SELECT *, w / greatest(max(w) OVER (ORDER BY date), 1) - 1 AS dd FROM c) SELECT count(*) AS n_days, round(avg(r), 6) + 0 AS mean, round(avg(r) * 252, 6) + 0 AS annualized_return, round(stddev_samp(r), 6) + 0 AS volatility, round(avg(r) / stddev_samp(r) * sqrt(252), 6) + 0 AS sharpe, round(avg(r) / stddev_samp(r) * sqrt(count(*)), 6) + 0 AS mean_t_stat, round(arg_max(w, date) - 1, 6) + 0 AS cumulative_return, round(min(dd), 6) + 0 AS max_drawdown, round(avg(r) / sqrt(avg(pow(least(r, 0), 2))) * sqrt(252), 5) + 0 AS sortino, round(avg((r > 0)::INT), 6) + 0 AS positive_day_rate, round(max(r), 6) + 0 AS best_day, round(min(r), 6) + 0 AS worst_day FROM p")
def b_metrics(spark: SparkSession, d: str) -> DataFrame:
    daily = portfolio.quantile_portfolio(signals(spark, d), "date", "asset", "pred", "actual").select("date", (F.col("long_short") / 100).alias("r"))
    got = portfolio.performance(daily, "date", "r")
    cells = ("mean", "annualized_return", "volatility", "sharpe", "mean_t_stat", "cumulative_return", "max_drawdown", "positive_day_rate", "best_day", "worst_day")
    return got.select("n_days", *[r6(c).alias(c) for c in cells], F.round("sortino", 5).alias("sortino"))


@query("b_decomposition", f"WITH {_BUCKET}, d AS (SELECT date, avg(actual) FILTER (bucket = 4) AS selected, avg(actual) FILTER (bucket >= 2) AS pool, avg(actual) AS universe FROM b WHERE n >= 5 GROUP BY date) SELECT date, round(selected - universe, 6) + 0 AS excess, round(selected - pool, 6) + 0 AS selection, round(pool - universe, 6) + 0 AS pool_effect FROM d")
def b_decomposition(spark: SparkSession, d: str) -> DataFrame:
    rows = portfolio.bucketed(signals(spark, d), "date", "asset", "pred", 5)
    some = lambda c: F.avg(F.when(c, F.col("actual")))
    day = rows.groupBy("date").agg(some(F.col("bucket") == 4).alias("s"), some(F.col("bucket") >= 2).alias("p"), F.avg("actual").alias("u"))
    return day.select("date", r6(F.col("s") - F.col("u")).alias("excess"), r6(F.col("s") - F.col("p")).alias("selection"), r6(F.col("p") - F.col("u")).alias("pool_effect"))


@query("b_cost_sensitivity", f"WITH {_BUCKET}, d AS (SELECT date, avg(actual) FILTER (bucket = 4) AS r FROM b WHERE n >= 5 GROUP BY date), s AS (SELECT unnest([0, 5, 10, 20, 50]) AS bps) SELECT bps::INT AS bps, round(avg(r - bps / 10000 * 0.8), 6) + 0 AS net_mean FROM d, s GROUP BY bps")
def b_cost_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    daily = portfolio.quantile_portfolio(signals(spark, d), "date", "asset", "pred", "actual").select("date", F.col("high").alias("r"))
    each = daily.withColumn("bps", F.explode(F.array(*[F.lit(b) for b in (0, 5, 10, 20, 50)])))
    return each.groupBy("bps").agg(r6(F.avg(F.col("r") - F.col("bps") / 10000 * 0.8)).alias("net_mean"))


@query("b_holdings_breadth", f"WITH {_W} SELECT date, round(pow(sum(abs(weight)), 2) / sum(weight * weight), 6) + 0 AS effective_n, round(max(abs(weight)), 6) + 0 AS largest FROM w GROUP BY date")
def b_holdings_breadth(spark: SparkSession, d: str) -> DataFrame:
    w = portfolio.sleeve_weights(signals(spark, d), "date", "asset", "pred", portfolio.Strategy())
    return w.groupBy("date").agg(r6(F.pow(F.sum(F.abs("weight")), 2) / F.sum(F.col("weight") * F.col("weight"))).alias("effective_n"), r6(F.max(F.abs("weight"))).alias("largest"))


@query("b_rank_blend", f"WITH {SIGNALS}, p AS (SELECT *, (rank() OVER (PARTITION BY date ORDER BY pred) + (count(*) OVER (PARTITION BY date, pred) - 1) / 2) / count(*) OVER (PARTITION BY date) AS r1, (rank() OVER (PARTITION BY date ORDER BY asset) + 0) / count(*) OVER (PARTITION BY date) AS r2 FROM signals) SELECT date, asset, grid.w, round(grid.w * r1 + (1 - grid.w) * r2, 6) + 0 AS blend FROM p, (SELECT unnest([0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE]) AS w) grid")
def b_rank_blend(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.windows import pct_rank

    rows = signals(spark, d).withColumns({"r1": pct_rank("pred", "date"), "r2": pct_rank("asset", "date")})
    rows = rows.withColumn("w", F.explode(F.array(*[F.lit(w) for w in (0.25, 0.5, 0.75)])))
    return rows.select("date", "asset", "w", r6(F.col("w") * F.col("r1") + (1 - F.col("w")) * F.col("r2")).alias("blend"))


def _market(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.execution import execution_panel

    rows = panel(spark, d).select("asset", "date", "open", "close", "high", "low")
    got = execution_panel(rows, trading_calendar(rows), limit=F.lit(30.0), initial_days=0, tolerance=0.0)
    return got.select("asset", "date", (F.coalesce("c2c", F.lit(0.0)) / 100).alias("ret"), "can_buy", "can_sell")


@query("b_small_assets", f"WITH {PANEL}, e AS (SELECT date, quantile_cont(amount, 0.2) AS edge FROM panel WHERE amount > 0 GROUP BY date) SELECT asset, date, coalesce(amount < edge, false) AS small FROM panel LEFT JOIN e USING (date)")
def b_small_assets(spark: SparkSession, d: str) -> DataFrame:
    return portfolio.small_assets(panel(spark, d), "date", "amount").select("asset", "date", "small")


@query("b_ewct_constrained")
def b_ewct_constrained(spark: SparkSession, d: str) -> DataFrame:
    """Holdings carried through sessions with trading limits; tests hold it against a day-by-day simulation."""
    daily, _ = portfolio.backtest(signals(spark, d), _market(spark, d), portfolio.Strategy(gamma=0.3), portfolio.Costs(), strict=False)
    return daily


@query("b_simple_backtest", f"WITH {_W}, m AS (SELECT w.date, w.weight, s.actual / 100 AS ret, w.asset FROM w JOIN signals s USING (date, asset)), h AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date) AS k FROM m) SELECT date, round(sum(weight * ret), 6) + 0 AS gross_return, count(*) FILTER (weight > 0) AS n_long, count(*) FILTER (weight < 0) AS n_short FROM h GROUP BY date")
def b_simple_backtest(spark: SparkSession, d: str) -> DataFrame:
    """Full turnover each day: gross returns and sides have a closed form."""
    s = signals(spark, d)
    market = s.select("date", "asset", (F.col("actual") / 100).alias("ret"))
    daily, _ = portfolio.backtest(s, market, portfolio.Strategy(gamma=1.0, missing="zero"), portfolio.Costs(), strict=False)
    return daily.select("date", r6("gross_return").alias("gross_return"), "n_long", "n_short")


@query("b_gamma_selection")
def b_gamma_selection(spark: SparkSession, d: str) -> DataFrame:
    """The smoothing with the best net Sharpe, then mean, then least turnover."""
    out = None
    for gamma in (0.1, 0.3, 1.0):
        daily, _ = portfolio.backtest(signals(spark, d), _market(spark, d), portfolio.Strategy(gamma=gamma), strict=False)
        row = portfolio.performance(daily, "date", "net_return").select(F.lit(gamma).alias("gamma"), "sharpe", "mean").join(daily.agg(F.avg("turnover").alias("turnover")))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("sharpe"), F.desc("mean"), "turnover")))
