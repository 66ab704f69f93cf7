"""Queries on the daily panel: calendars, joins in time, windows, cross-sections, top-k and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import calendar as cal
from tidemark.operators import joins, records, windows, xsection
from tidemark.plans.base import CALENDAR, PANEL, SIGNALS, SPARSE, panel, query, r6, signals, table
from tidemark.schema import code6, flag, safe_div

# ---- scans, projections and validation -------------------------------------------------------------------


@query("s_profile", "SELECT count(*) AS n_rows, count(*) - count(DISTINCT (user_id, ts)) AS duplicates, count(DISTINCT user_id) AS users, sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END)::BIGINT AS missing, min(value) AS low, round(median(value), 6) AS middle, max(value) AS high, min(ts::DATE) AS first_day, max(ts::DATE) AS last_day FROM events")
def s_profile(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.agg(
        F.count(F.lit(1)).alias("n_rows"), (F.count(F.lit(1)) - F.count_distinct("user_id", "ts")).alias("duplicates"), F.count_distinct("user_id").alias("users"),
        F.sum(F.col("value").isNull().cast("long")).alias("missing"), F.min("value").alias("low"), r6(F.median("value")).alias("middle"), F.max("value").alias("high"),
        F.min(F.to_date("ts")).alias("first_day"), F.max(F.to_date("ts")).alias("last_day"),
    )


@query("s_schema_probe", "SELECT 'lineitem' AS source, count(*) AS n_rows, 11 AS n_columns FROM lineitem")
def s_schema_probe(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    return rows.agg(F.lit("lineitem").alias("source"), F.count(F.lit(1)).alias("n_rows"), F.lit(len(rows.columns)).alias("n_columns"))


@query("p_bool_parse", "SELECT event_id, CASE WHEN event_type = 'click' THEN true WHEN event_type = 'view' THEN false ELSE event_id % 2 = 0 END AS on_buy, CASE WHEN event_type = 'click' THEN true ELSE false END AS on_eligible FROM events")
def p_bool_parse(spark: SparkSession, d: str) -> DataFrame:
    word = F.when(F.col("event_type") == "click", " Yes ").when(F.col("event_type") == "view", "FALSE").when(F.col("event_id") % 2 == 0, "1.0").otherwise("0")
    text = F.when(F.col("event_type").isin("click", "view"), word).otherwise("n/a")
    return table(spark, d, "events").select("event_id", F.when(F.col("event_type").isin("click", "view"), flag(text, True)).otherwise(flag(word, True)).alias("on_buy"), flag(text, False).alias("on_eligible"))


@query("p_first_reason", "SELECT event_id, CASE WHEN value < 1 THEN 'too_small' WHEN value > 100 THEN 'too_large' WHEN event_type = 'error' THEN 'error_type' WHEN length(props) < 9 THEN 'short_props' END AS reason FROM events")
def p_first_reason(spark: SparkSession, d: str) -> DataFrame:
    rules = [(F.col("value") < 1, "too_small"), (F.col("value") > 100, "too_large"), (F.col("event_type") == "error", "error_type"), (F.length("props") < 9, "short_props")]
    return table(spark, d, "events").select("event_id", F.coalesce(*[F.when(c, n) for c, n in rules]).alias("reason"))


@query("p_reason_list", "SELECT event_id, array_to_string(list_filter([CASE WHEN value < 1 THEN 'too_small' END, CASE WHEN event_type = 'error' THEN 'error_type' END, CASE WHEN user_id % 7 = 0 THEN 'listed' END], lambda x: x IS NOT NULL), ';') AS reasons, CASE WHEN value < 1 OR event_type = 'error' OR user_id % 7 = 0 THEN 'reject' ELSE 'keep' END AS status FROM events")
def p_reason_list(spark: SparkSession, d: str) -> DataFrame:
    rules = [(F.col("value") < 1, "too_small"), (F.col("event_type") == "error", "error_type"), (F.col("user_id") % 7 == 0, "listed")]
    why = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules]))
    return table(spark, d, "events").select("event_id", F.array_join(why, ";").alias("reasons"), F.when(F.size(why) == 0, "keep").otherwise("reject").alias("status"))


@query("p_ticker_rule", "SELECT s_suppkey, lpad((s_suppkey * 7919 % 900000)::VARCHAR, 6, '0') AS code, lpad((s_suppkey * 7919 % 900000)::VARCHAR, 6, '0') || CASE WHEN lpad((s_suppkey * 7919 % 900000)::VARCHAR, 6, '0')[1] IN ('5', '6') THEN '.SH' ELSE '.SZ' END AS ticker, CASE WHEN regexp_matches(lpad((s_suppkey * 7919 % 900000)::VARCHAR, 6, '0'), '^(300|301|688)') THEN 0.2::DOUBLE WHEN regexp_matches(lpad((s_suppkey * 7919 % 900000)::VARCHAR, 6, '0'), '^(4|8|920)') THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END AS price_limit FROM supplier")
def p_ticker_rule(spark: SparkSession, d: str) -> DataFrame:
    code = code6(F.concat((F.col("s_suppkey") * 7919 % 900000).cast("string"), F.lit(".0")))
    rows = table(spark, d, "supplier").select("s_suppkey", code.alias("code"))
    return rows.select("s_suppkey", "code", ticker(F.col("code")).alias("ticker"), price_limit(F.col("code")).alias("price_limit"))


def ticker(code):
    return F.concat(code, F.when(code.rlike("^[56]"), ".SH").otherwise(".SZ"))


def price_limit(code):
    """Daily price limit by the board that a code's prefix names."""
    return F.when(code.rlike("^(300|301|688)"), 0.2).when(code.rlike("^(4|8|920)"), 0.3).otherwise(0.1)


@query("p_len_band", "SELECT doc_id, length(text) AS chars FROM documents WHERE length(text) BETWEEN 50 AND 5000")
def p_len_band(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.char_length("text").between(50, 5000)).select("doc_id", F.char_length("text").cast("long").alias("chars"))


@query("p_clean_prices", "WITH " + PANEL + " SELECT asset::VARCHAR AS stock_id, date, close FROM panel WHERE close > 0")
def p_clean_prices(spark: SparkSession, d: str) -> DataFrame:
    """The checked prices of the days with one; tests show that bad rows raise."""
    rows = panel(spark, d).where("close > 0").select(F.col("asset").cast("string").alias("stock_id"), F.date_format("date", "yyyy-MM-dd").alias("date"), F.col("close").cast("string").alias("close"))
    return records.checked_prices(rows).select("stock_id", "date", "close")


@query("p_label_sanitise", "SELECT event_id, CASE WHEN user_id % 10 = 0 THEN NULL ELSE round(ln(1 + greatest(value - 5, 0)), 6) + 0 END AS shock, CASE WHEN user_id % 10 = 0 THEN 0 ELSE 1 END AS valid FROM events")
def p_label_sanitise(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.schema import finite

    raw = F.when(F.col("user_id") % 10 == 0, F.lit(float("nan"))).otherwise(F.log1p(F.greatest(F.col("value") - 5, F.lit(0.0))))
    return table(spark, d, "events").select("event_id", r6(finite(raw)).alias("shock"), F.when(finite(raw).isNull(), 0).otherwise(1).alias("valid"))


@query("p_hash_sample", "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY md5('s' || event_id::VARCHAR), event_id) AS r FROM events) WHERE r <= 100")
def p_hash_sample(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").orderBy(F.md5(F.concat(F.lit("s"), F.col("event_id").cast("string"))), "event_id").limit(100).select("event_id")


# ---- joins -------------------------------------------------------------------------------------------------


@query("j_many_to_one", "WITH " + PANEL + " SELECT e.event_id, e.user_id, p.close, p.volume FROM events e LEFT JOIN panel p ON e.user_id = p.asset AND e.ts::DATE = p.date")
def j_many_to_one(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "events").select("event_id", "user_id", F.col("user_id").alias("asset"), F.to_date("ts").alias("date"))
    # the right side is grouped by its keys, so the check would only repeat that
    return joins.validated_join(left, panel(spark, d), ["asset", "date"], strict=False).select("event_id", "user_id", "close", "volume")


@query("j_outer_metrics", "WITH a AS (SELECT user_id, ts::DATE AS date, count(*) AS clicks FROM events WHERE event_type = 'click' GROUP BY ALL), b AS (SELECT user_id, ts::DATE AS date, count(*) AS buys FROM events WHERE event_type = 'purchase' GROUP BY ALL) SELECT user_id, date, clicks, buys FROM a FULL JOIN b USING (user_id, date)")
def j_outer_metrics(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("date", F.to_date("ts"))
    part = lambda kind, name: e.where(F.col("event_type") == kind).groupBy("user_id", "date").agg(F.count(F.lit(1)).alias(name))
    return joins.coalesced_outer(part("click", "clicks"), part("purchase", "buys"), ["user_id", "date"])


_BUYS = "p AS (SELECT user_id, ts, event_id AS buy_id, value AS paid FROM events WHERE event_type = 'purchase')"


def _asof(spark: SparkSession, d: str, forward: bool, strict: bool) -> DataFrame:
    e = table(spark, d, "events")
    left = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("buy_id"), F.col("value").alias("paid"))
    return joins.asof_join(left, right, "ts", "at", ["user_id"], ["buy_id", "paid"], forward, strict, tie="buy_id").select("event_id", "buy_id", "paid")


@query("j_asof_backward", f"WITH {_BUYS} SELECT c.event_id, p.buy_id, p.paid FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.ts >= p.ts")
def j_asof_backward(spark: SparkSession, d: str) -> DataFrame:
    return _asof(spark, d, False, False)


@query("j_asof_forward", f"WITH {_BUYS} SELECT c.event_id, p.buy_id, p.paid FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.ts <= p.ts")
def j_asof_forward(spark: SparkSession, d: str) -> DataFrame:
    return _asof(spark, d, True, False)


@query("j_asof_daily", "WITH l AS (SELECT user_id, ts::DATE AS day, max(event_id) AS last_id FROM events GROUP BY ALL), r AS (SELECT user_id, ts::DATE AS day, max_by(value, event_id) AS paid FROM events WHERE event_type = 'purchase' GROUP BY ALL) SELECT l.user_id, l.day, last_id, r.paid FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.day > r.day")
def j_asof_daily(spark: SparkSession, d: str) -> DataFrame:
    """Strictly earlier days: what a day knows when it opens."""
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    left = e.groupBy("user_id", "day").agg(F.max("event_id").alias("last_id"))
    right = e.where("event_type = 'purchase'").groupBy("user_id", F.col("day").alias("at")).agg(F.max_by("value", "event_id").alias("paid"))
    return joins.asof_join(left, right, "day", "at", ["user_id"], ["paid"], strict=True)


def _session_sql(op: str, pick: str) -> str:
    return f"WITH {SPARSE}, e AS (SELECT DISTINCT l_shipdate::DATE AS date FROM lineitem) SELECT e.date, (SELECT {pick}(c.date) FROM cal c WHERE c.date {op} e.date) AS session FROM e"


def _sessions(spark: SparkSession, d: str, **how: bool) -> DataFrame:
    calendar = cal.trading_calendar(table(spark, d, "orders"), "o_orderdate")
    return cal.session_map(table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date")), calendar, **how)


@query("j_next_session", _session_sql(">=", "min"))
def j_next_session(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d)


@query("j_strictly_after", _session_sql(">", "min"))
def j_strictly_after(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d, strict=True)


@query("j_last_session", _session_sql("<=", "max"))
def j_last_session(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d, backward=True)


@query("j_calendar_rank", f"WITH {CALENDAR}, d AS (SELECT DISTINCT o_orderdate::DATE AS date FROM orders UNION SELECT date FROM cal) SELECT d.date, coalesce(cal.rank, -1) AS rank FROM d LEFT JOIN cal USING (date)")
def j_calendar_rank(spark: SparkSession, d: str) -> DataFrame:
    calendar = cal.trading_calendar(table(spark, d, "events"), "ts")
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).union(calendar.select("date")).distinct()
    return cal.with_rank(days, calendar).select("date", F.coalesce("rank", F.lit(-1)).cast("long").alias("rank"))


@query("j_position_gather", f"WITH {PANEL}, {CALENDAR} SELECT p.asset, p.date, q.close AS previous_close FROM panel p JOIN cal c USING (date) LEFT JOIN cal b ON b.rank = c.rank - 1 LEFT JOIN panel q ON q.asset = p.asset AND q.date = b.date")
def j_position_gather(spark: SparkSession, d: str) -> DataFrame:
    rows = panel(spark, d).select("asset", "date", "close")
    calendar = cal.trading_calendar(rows)
    shifted = cal.shift_session(rows.select("asset", "date", F.col("close").alias("previous_close")), calendar, "date", 1, "next").where("next is not null")
    return rows.select("asset", "date").join(shifted.select("asset", F.col("next").alias("date"), "previous_close"), ["asset", "date"], "left")


@query("j_anti_two_key", "WITH n AS (SELECT * FROM events WHERE event_id % 2 = 1), k AS (SELECT * FROM events WHERE event_id % 2 = 0) SELECT n.event_id FROM n WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.user_id = n.user_id AND k.ts::DATE = n.ts::DATE) AND NOT EXISTS (SELECT 1 FROM k WHERE k.props = n.props AND k.event_type = n.event_type AND k.user_id = n.user_id)")
def j_anti_two_key(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return joins.anti_any(e.where("event_id % 2 = 1"), e.where("event_id % 2 = 0"), [("user_id", "day"), ("props", "event_type", "user_id")]).select("event_id")


@query("j_semi_universe", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def j_semi_universe(spark: SparkSession, d: str) -> DataFrame:
    universe = table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(universe, "o_custkey", "left_semi").select("o_orderkey")


@query("j_range_prior", f"WITH {CALENDAR}, e AS (SELECT event_id, user_id, rank, value FROM events JOIN cal ON ts::DATE = date) SELECT a.event_id, count(b.event_id) AS prior_events, round(max(b.value), 6) AS prior_high FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND b.event_id < a.event_id AND b.rank BETWEEN a.rank - 4 AND a.rank GROUP BY a.event_id")
def j_range_prior(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("date", F.to_date("ts"))
    e = cal.with_rank(e, cal.trading_calendar(e)).select("event_id", "user_id", "rank", "value")
    before = e.select("user_id", F.col("event_id").alias("prior_id"), F.col("rank").alias("prior_rank"), F.col("value").alias("prior_value"))
    pairs = joins.range_join(e, before, ["user_id"], "rank", "prior_rank", 4, F.col("prior_id") < F.col("event_id"))
    got = pairs.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), r6(F.max("prior_value")).alias("prior_high"))
    return e.select("event_id").join(got, "event_id", "left").select("event_id", F.coalesce("n", F.lit(0)).cast("long").alias("prior_events"), "prior_high")


@query("j_align_models", f"WITH {SIGNALS}, m AS (SELECT asset, date, pred AS a, CASE WHEN asset % 5 > 0 THEN round(pred * 2, 6) END AS b, CASE WHEN asset % 7 > 0 THEN round(pred + 1, 6) END AS c, actual FROM signals) SELECT asset, date, a AS m_a, b AS m_b, c AS m_c, actual FROM m WHERE b IS NOT NULL AND c IS NOT NULL")
def j_align_models(spark: SparkSession, d: str) -> DataFrame:
    s = signals(spark, d)
    frames = {"m_a": s, "m_b": s.where("asset % 5 > 0").withColumn("pred", r6(F.col("pred") * 2)), "m_c": s.where("asset % 7 > 0").withColumn("pred", r6(F.col("pred") + 1))}
    return joins.align_models(frames, ["asset", "date"], "pred", "actual")


@query("j_key_audit", "WITH l AS (SELECT DISTINCT o_custkey AS k FROM orders), r AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0), f AS (SELECT l.k AS a, r.k AS b FROM l FULL JOIN r ON l.k = r.k) SELECT CASE WHEN a IS NULL THEN 'right' WHEN b IS NULL THEN 'left' ELSE 'both' END AS side, count(*) AS n FROM f GROUP BY ALL")
def j_key_audit(spark: SparkSession, d: str) -> DataFrame:
    return joins.audit_keys(table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")), "k")


@query("j_dimension_map", "SELECT r_name, count(*) AS customers, round(sum(c_acctbal), 2) + 0 AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def j_dimension_map(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("j_nearest_prior_order", "WITH r AS (SELECT o_custkey, o_orderdate, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY ALL) SELECT r.o_custkey, r.o_orderdate, lag(price) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS previous FROM r")
def j_nearest_prior_order(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "orders").groupBy("o_custkey", "o_orderdate").agg(F.max_by("o_totalprice", "o_orderkey").alias("price"))
    right = r.select("o_custkey", F.col("o_orderdate").alias("at"), F.col("price").alias("previous"))
    return joins.asof_join(r, right, "o_orderdate", "at", ["o_custkey"], ["previous"], strict=True).select("o_custkey", "o_orderdate", "previous")


# ---- windows -----------------------------------------------------------------------------------------------


@query("w_fwd_return_h", f"WITH {PANEL} SELECT asset, date, round(lead(close, 1) OVER w / nullif(close, 0) - 1, 6) + 0 AS r1, round(lead(close, 5) OVER w / nullif(close, 0) - 1, 6) + 0 AS r5, round(lead(close, 20) OVER w / nullif(close, 0) - 1, 6) + 0 AS r20 FROM panel WINDOW w AS (PARTITION BY asset ORDER BY date)")
def w_fwd_return_h(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d).select("asset", "date", *[r6(windows.forward_return("close", "asset", "date", h)).alias(f"r{h}") for h in (1, 5, 20)])


@query("w_event3", f"WITH {PANEL} SELECT asset, date, round(lead(close, 1) OVER w / nullif(lag(close, 2) OVER w, 0) - 1, 6) + 0 AS r FROM panel WINDOW w AS (PARTITION BY asset ORDER BY date)")
def w_event3(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d).select("asset", "date", r6(windows.event_return("close", "asset", "date")).alias("r"))


@query("w_calendar_return", f"WITH {PANEL}, {CALENDAR} SELECT p.asset, p.date, round(q.close / nullif(p.close, 0) - 1, 6) + 0 AS r FROM panel p JOIN cal c USING (date) LEFT JOIN cal e ON e.rank = c.rank + 5 LEFT JOIN panel q ON q.asset = p.asset AND q.date = e.date")
def w_calendar_return(spark: SparkSession, d: str) -> DataFrame:
    """Both ends must exist on the global calendar: an asset's gap gives NULL."""
    rows = panel(spark, d).select("asset", "date", "close")
    there = cal.shift_session(rows, cal.trading_calendar(rows), "date", 5, "end")
    ends = rows.select("asset", F.col("date").alias("end"), F.col("close").alias("later"))
    return there.join(ends, ["asset", "end"], "left").select("asset", "date", r6(safe_div(F.col("later"), F.col("close")) - 1).alias("r"))


_RET = PANEL + ", ret AS (SELECT asset, date, close / nullif(lag(close) OVER (PARTITION BY asset ORDER BY date), 0) - 1 AS r, amount FROM panel)"


def _returns(spark: SparkSession, d: str) -> DataFrame:
    rows = panel(spark, d)
    return rows.select("asset", "date", (safe_div(F.col("close"), F.lag("close").over(windows.ordered("asset", "date"))) - 1).alias("r"), "amount")


@query("w_fwd_product", f"WITH {_RET} SELECT asset, date, CASE WHEN count(r) OVER w = 3 THEN round(product(1 + r) OVER w - 1, 6) + 0 END AS r3 FROM ret WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)")
def w_fwd_product(spark: SparkSession, d: str) -> DataFrame:
    return _returns(spark, d).select("asset", "date", r6(windows.forward_product("r", "asset", "date", 3)).alias("r3"))


@query("w_prior_std", f"WITH {_RET} SELECT asset, date, CASE WHEN count(r) OVER w = 5 THEN round(stddev_samp(r) OVER w, 6) + 0 END AS prior_std, CASE WHEN count(r) OVER w = 5 THEN round(avg(r) OVER w, 6) + 0 END AS prior_mean FROM ret WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)")
def w_prior_std(spark: SparkSession, d: str) -> DataFrame:
    return _returns(spark, d).select("asset", "date", *[r6(windows.window_stat("r", "asset", "date", 5, s)).alias(f"prior_{s}") for s in ("std", "mean")])


@query("w_prior_median", f"WITH {_RET} SELECT asset, date, CASE WHEN count(r) OVER w = 7 THEN round(median(r) OVER w, 6) + 0 END AS prior_median FROM ret WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)")
def w_prior_median(spark: SparkSession, d: str) -> DataFrame:
    return _returns(spark, d).select("asset", "date", r6(windows.window_stat("r", "asset", "date", 7, "median")).alias("prior_median"))


@query("w_forward_std", f"WITH {_RET} SELECT asset, date, CASE WHEN count(r) OVER w = 5 THEN round(stddev_samp(r) OVER w, 6) + 0 END AS forward_std FROM ret WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)")
def w_forward_std(spark: SparkSession, d: str) -> DataFrame:
    return _returns(spark, d).select("asset", "date", r6(windows.window_stat("r", "asset", "date", 5, "std", forward=True)).alias("forward_std"))


@query("w_lagged_median", "WITH o AS (SELECT o_custkey AS asset, o_orderdate::DATE AS date, sum(o_totalprice) AS x FROM orders GROUP BY ALL) SELECT asset, date, CASE WHEN count(x) OVER w >= 4 THEN round(x / median(x) OVER w - 1, 6) + 0 END AS deviation FROM o WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)")
def w_lagged_median(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("asset"), F.to_date("o_orderdate").alias("date")).agg(F.sum("o_totalprice").alias("x"))
    middle = windows.window_stat("x", "asset", "date", 252, "median", min_periods=4)
    return o.select("asset", "date", r6(safe_div(F.col("x"), middle) - 1).alias("deviation"))


@query("w_trailing_amount", f"WITH {PANEL} SELECT asset, date, CASE WHEN count(amount) OVER w = 5 THEN round(avg(amount) OVER w, 6) + 0 END AS mean_amount, lag(close) OVER (PARTITION BY asset ORDER BY date) AS previous, lead(close) OVER (PARTITION BY asset ORDER BY date) AS following FROM panel WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def w_trailing_amount(spark: SparkSession, d: str) -> DataFrame:
    w = windows.ordered("asset", "date")
    return panel(spark, d).select("asset", "date", r6(windows.trailing_mean("amount", "asset", "date", 5)).alias("mean_amount"), F.lag("close").over(w).alias("previous"), F.lead("close").over(w).alias("following"))


_DENSE = f"""{PANEL}, {CALENDAR}, spine AS (SELECT asset, date FROM (SELECT DISTINCT asset FROM panel), cal),
 dense AS (SELECT s.asset, s.date, p.open, p.close, p.high, p.low, p.close IS NOT NULL AS observed FROM spine s LEFT JOIN panel p USING (asset, date))"""


@query("w_ffill_dense", f"WITH {_DENSE} SELECT asset, date, observed, CASE WHEN date <= max(CASE WHEN observed THEN date END) OVER (PARTITION BY asset) THEN last_value(close IGNORE NULLS) OVER w END AS marked_close, (sum(observed::INT) OVER w - 1)::BIGINT AS listing_day FROM dense WINDOW w AS (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING)")
def w_ffill_dense(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.execution import listing_spell

    rows = panel(spark, d).select("asset", "date", "open", "close", "high", "low")
    return listing_spell(cal.densify(rows, cal.trading_calendar(rows), "asset"), "asset", "date").select("asset", "date", "observed", "marked_close", "listing_day")


_EXEC = f"""{_DENSE}, marked AS (SELECT *, date <= max(CASE WHEN observed THEN date END) OVER (PARTITION BY asset) AS listed,
 (sum(observed::INT) OVER w - 1)::BIGINT AS age, last_value(open IGNORE NULLS) OVER w AS fo, last_value(close IGNORE NULLS) OVER w AS fc, coalesce(lead(observed) OVER (PARTITION BY asset ORDER BY date), false) AS next_observed,
 lead(open) OVER (PARTITION BY asset ORDER BY date) AS next_open FROM dense WINDOW w AS (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING)),
 m2 AS (SELECT *, CASE WHEN listed THEN fo END AS mo, CASE WHEN listed THEN fc END AS mc FROM marked),
 m3 AS (SELECT *, mo / nullif(lag(mc) OVER (PARTITION BY asset ORDER BY date), 0) - 1 AS gap FROM m2)"""


@query("w_execution_panel", f"WITH {_EXEC} SELECT asset, date, observed, next_observed, age AS listing_day, age < 5 AND listed AND age >= 0 AS ipo_window, round(gap, 6) + 0 AS gap, coalesce(observed AND age >= 5 AND gap < 0.1::DOUBLE - 0.002::DOUBLE, false) AS can_buy, coalesce(observed AND age >= 5 AND gap > -0.1::DOUBLE + 0.002::DOUBLE, false) AS can_sell, observed AND age >= 5 AS eligible, CASE WHEN observed AND next_observed THEN round(next_open / nullif(open, 0) - 1, 6) + 0 END AS tradable_o2o, round(lead(mo) OVER w / nullif(mo, 0) - 1, 6) + 0 AS o2o, round(lead(mc) OVER w / nullif(mc, 0) - 1, 6) + 0 AS c2c, round(mc / nullif(mo, 0) - 1, 6) + 0 AS o2c FROM m3 WINDOW w AS (PARTITION BY asset ORDER BY date)")
def w_execution_panel(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.execution import execution_panel

    rows = panel(spark, d).select("asset", "date", "open", "close", "high", "low")
    got = execution_panel(rows, cal.trading_calendar(rows), limit=F.lit(0.1))
    return got.select("asset", "date", "observed", "next_observed", "listing_day", "ipo_window", r6("gap").alias("gap"), "can_buy", "can_sell", "eligible", *[r6(c).alias(c) for c in ("tradable_o2o", "o2o", "c2c", "o2c")])


@query("w_pct_rank", f"WITH {PANEL} SELECT asset, date, round((rank() OVER (PARTITION BY date ORDER BY volume) + (count(*) OVER (PARTITION BY date, volume) - 1) / 2) / count(*) OVER (PARTITION BY date), 6) + 0 AS pct FROM panel")
def w_pct_rank(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d).select("asset", "date", r6(windows.pct_rank("volume", "date")).alias("pct"))


@query("w_qbucket", f"WITH {PANEL} SELECT asset, date, greatest(0, ceil((row_number() OVER (PARTITION BY date ORDER BY signal, asset) - 1) * 5 / greatest(count(*) OVER (PARTITION BY date) - 1, 1))::INT - 1) AS bucket FROM panel")
def w_qbucket(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d).select("asset", "date", windows.quantile_bucket("signal", "asset", "date", 5).alias("bucket"))


@query("w_zscore", f"WITH {PANEL} SELECT asset, date, round((signal - avg(signal) OVER w) / nullif(stddev_samp(signal) OVER w, 0), 6) + 0 AS z, round(signal - avg(signal) OVER w, 6) + 0 AS centred FROM panel WINDOW w AS (PARTITION BY date)")
def w_zscore(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d).select("asset", "date", r6(windows.zscore("signal", "date")).alias("z"), r6(windows.demean("signal", "date")).alias("centred"))


@query("w_winsor_residual", f"WITH {SIGNALS}, m AS (SELECT date, count(*) AS n, avg(actual) AS mu, stddev_samp(actual) AS sd, quantile_cont(actual, 0.01) AS lo, quantile_cont(actual, 0.99) AS hi FROM signals GROUP BY date HAVING count(*) >= 5), w AS (SELECT s.*, m.*, least(greatest(actual, lo), hi) AS clipped FROM signals s JOIN m USING (date)) SELECT asset, date, n AS market_n, round(actual - mu, 6) + 0 AS residual, round((actual - mu) / sd, 6) + 0 AS cs_zscore, round(clipped - avg(clipped) OVER (PARTITION BY date), 6) + 0 AS winsor_residual FROM w")
def w_winsor_residual(spark: SparkSession, d: str) -> DataFrame:
    got = xsection.residual_targets(signals(spark, d), "date", "actual").where("market_mean is not null")
    return got.select("asset", "date", "market_n", *[r6(c).alias(c) for c in ("residual", "cs_zscore", "winsor_residual")])


@query("w_neighbor_mean", f"WITH {PANEL} SELECT asset, date, CASE WHEN count(*) OVER w > 1 THEN round((sum(close) OVER w - close) / (count(*) OVER w - 1), 6) + 0 ELSE 0 END AS others FROM panel WINDOW w AS (PARTITION BY date, asset % 25)")
def w_neighbor_mean(spark: SparkSession, d: str) -> DataFrame:
    rows = panel(spark, d).withColumn("grp", F.col("asset") % 25)
    return rows.select("asset", "date", r6(windows.neighbour_mean("close", ["date", "grp"])).alias("others"))


@query("w_drawdown", f"WITH {_RET}, d AS (SELECT date, avg(r) / 20 AS r FROM ret WHERE r IS NOT NULL GROUP BY date), c AS (SELECT date, product(1 + r) OVER (ORDER BY date) AS wealth FROM d) SELECT date, round(wealth, 6) + 0 AS wealth, round(wealth / greatest(max(wealth) OVER (ORDER BY date), 1) - 1, 6) + 0 AS drawdown, round(wealth / max(wealth) OVER (ORDER BY date) - 1, 6) + 0 AS drawdown_unfloored FROM c")
def w_drawdown(spark: SparkSession, d: str) -> DataFrame:
    daily = _returns(spark, d).where("r is not null").groupBy("date").agg((F.avg("r") / 20).alias("r")).withColumn("k", F.lit(0))
    rows = daily.withColumn("wealth", windows.wealth("r", "k", "date"))
    return rows.select("date", r6("wealth").alias("wealth"), r6(windows.drawdown("wealth", "k", "date")).alias("drawdown"), r6(windows.drawdown("wealth", "k", "date", floor=False)).alias("drawdown_unfloored"))


@query("w_calendarize", f"WITH {SPARSE}, e AS (SELECT ts::DATE AS date, round(sum(value), 6) AS v FROM events WHERE event_type = 'purchase' AND value > 200 GROUP BY ALL), c AS (SELECT DISTINCT ts::DATE AS date FROM events) SELECT c.date, coalesce(e.v, 0) AS v FROM c LEFT JOIN e USING (date)")
def w_calendarize(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("date", F.to_date("ts"))
    some = e.where("event_type = 'purchase' and value > 200").groupBy("date").agg(r6(F.sum("value")).alias("v"))
    return cal.trading_calendar(e).select("date").join(some, "date", "left").select("date", F.coalesce("v", F.lit(0.0)).alias("v"))


@query("w_tail_flag", f"WITH {SIGNALS}, q AS (SELECT quantile_cont(abs(actual), 0.95) AS edge FROM signals) SELECT asset, date, CASE WHEN abs(actual) >= edge THEN 1 ELSE 0 END AS tail FROM signals, q")
def w_tail_flag(spark: SparkSession, d: str) -> DataFrame:
    s = signals(spark, d)
    edge = s.agg(F.percentile(F.abs("actual"), 0.95).alias("edge"))
    return s.join(edge).select("asset", "date", F.when(F.abs("actual") >= F.col("edge"), 1).otherwise(0).alias("tail"))


@query("w_first_last", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def w_first_last(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("first", windows.first_row(["user_id", "event_type"], "ts", "event_id")).where("first").select("event_id")


# ---- rank correlation, top-k, sets ---------------------------------------------------------------------------

_IC = f"""{SIGNALS}, ranked AS (SELECT date, (rank() OVER (PARTITION BY date ORDER BY actual) + (count(*) OVER (PARTITION BY date, actual) - 1) / 2) AS a,
 (rank() OVER (PARTITION BY date ORDER BY pred) + (count(*) OVER (PARTITION BY date, pred) - 1) / 2) AS p FROM signals),
 daily AS (SELECT date, count(*) AS n, covar_pop(a, p) / nullif(stddev_pop(a) * stddev_pop(p), 0) AS ic FROM ranked GROUP BY date HAVING count(*) >= 5)"""


@query("a13_daily_rank_ic", f"WITH {_IC} SELECT round(avg(ic), 6) + 0 AS ic_mean, round(stddev_samp(ic), 6) + 0 AS ic_std, round(avg(ic) / stddev_samp(ic), 6) + 0 AS ic_ir, round(avg((ic > 0)::INT), 6) + 0 AS positive_rate, count(*) AS days FROM daily WHERE ic IS NOT NULL")
def a13_daily_rank_ic(spark: SparkSession, d: str) -> DataFrame:
    got = xsection.ic_summary(xsection.daily_ic(signals(spark, d), "date", "actual", "pred"))
    return got.select(*[r6(c).alias(c) for c in ("ic_mean", "ic_std", "ic_ir", "positive_rate")], "days")


@query("a_daily_ic_series", f"WITH {_IC} SELECT date, n, round(ic, 6) + 0 AS ic FROM daily WHERE ic IS NOT NULL")
def a_daily_ic_series(spark: SparkSession, d: str) -> DataFrame:
    return xsection.daily_ic(signals(spark, d), "date", "actual", "pred").select("date", "n", r6("ic").alias("ic"))


@query("a_daily_ic_by_factor", f"WITH {SIGNALS}, f AS (SELECT 'raw' AS factor, date, actual, pred FROM signals UNION ALL SELECT 'square', date, actual, pred * pred FROM signals UNION ALL SELECT 'negative', date, actual, -pred FROM signals), r AS (SELECT factor, date, (rank() OVER (PARTITION BY factor, date ORDER BY actual) + (count(*) OVER (PARTITION BY factor, date, actual) - 1) / 2) AS a, (rank() OVER (PARTITION BY factor, date ORDER BY pred) + (count(*) OVER (PARTITION BY factor, date, pred) - 1) / 2) AS p FROM f), c AS (SELECT factor, date, covar_pop(a, p) / nullif(stddev_pop(a) * stddev_pop(p), 0) AS ic FROM r GROUP BY ALL HAVING count(*) >= 5) SELECT factor, round(avg(ic), 6) + 0 AS ic_mean, count(*) AS days FROM c WHERE ic IS NOT NULL GROUP BY factor")
def a_daily_ic_by_factor(spark: SparkSession, d: str) -> DataFrame:
    """Many factors at once: one long frame, one pass."""
    s = signals(spark, d)
    long = s.select("date", "actual", F.explode(F.create_map(F.lit("raw"), F.col("pred"), F.lit("square"), F.col("pred") * F.col("pred"), F.lit("negative"), -F.col("pred"))).alias("factor", "pred"))
    daily = xsection.daily_ic(long, "date", "actual", "pred", by=("factor",))
    return daily.groupBy("factor").agg(r6(F.avg("ic")).alias("ic_mean"), F.count(F.lit(1)).alias("days"))


@query("a_monthly_ic", f"WITH {_IC} SELECT date_trunc('week', date)::DATE AS period, round(avg(ic), 6) + 0 AS ic, count(*) AS days FROM daily WHERE ic IS NOT NULL GROUP BY ALL")
def a_monthly_ic(spark: SparkSession, d: str) -> DataFrame:
    daily = xsection.daily_ic(signals(spark, d), "date", "actual", "pred")
    return daily.groupBy(F.to_date(F.date_trunc("week", "date")).alias("period")).agg(r6(F.avg("ic")).alias("ic"), F.count(F.lit(1)).alias("days"))


def _top_sql(k: str, extra: str = "") -> str:
    return f"""WITH {SIGNALS}, c AS (SELECT *, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY pred DESC, asset) AS up, row_number() OVER (PARTITION BY date ORDER BY pred, asset) AS down FROM signals),
 k AS (SELECT *, {k} AS k FROM c) SELECT date, side, count(*) AS n_assets, round(avg(actual), 6) + 0 AS mean_return FROM (SELECT date, 'long' AS side, actual FROM k WHERE up <= k {extra} UNION ALL SELECT date, 'short', actual FROM k WHERE down <= k {extra}) GROUP BY ALL"""


def _top(spark: SparkSession, d: str, rule: str) -> DataFrame:
    rows = xsection.top_rows(signals(spark, d), "date", "pred", "asset", rule)
    return rows.groupBy("date", F.col("__side").alias("side")).agg(F.count(F.lit(1)).alias("n_assets"), r6(F.avg("actual")).alias("mean_return"))


@query("t_top20_ceil", _top_sql("greatest(1, ceil(n * 0.2::DOUBLE))"))
def t_top20_ceil(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d, "ceil")


@query("t_top20_floor", _top_sql("floor(n * 0.2::DOUBLE)", "AND k > 0 AND n >= 2 * k"))
def t_top20_floor(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d, "floor")


@query("t_top20_half", _top_sql("least(greatest(1, floor(n * 0.2::DOUBLE)), n // 2)", "AND k > 0"))
def t_top20_half(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d, "half")


@query("t_quantile_edge", f"WITH {SIGNALS}, e AS (SELECT date, quantile_cont(pred, 0.8) AS edge FROM signals GROUP BY date HAVING count(*) >= 5) SELECT asset, date FROM signals JOIN e USING (date) WHERE pred >= edge")
def t_quantile_edge(spark: SparkSession, d: str) -> DataFrame:
    return xsection.above_quantile(signals(spark, d), "date", "pred", 0.2).select("asset", "date")


@query("t_overlap_jaccard", f"WITH {SIGNALS}, t AS (SELECT date, asset, row_number() OVER (PARTITION BY date ORDER BY pred DESC, asset) AS a, row_number() OVER (PARTITION BY date ORDER BY actual DESC, asset) AS b FROM signals) SELECT date, sum((a <= 10 AND b <= 10)::INT)::BIGINT AS overlap, round(sum((a <= 10 AND b <= 10)::INT) / sum((a <= 10 OR b <= 10)::INT), 6) + 0 AS jaccard FROM t GROUP BY date")
def t_overlap_jaccard(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("date")
    rows = signals(spark, d).withColumns({"a": F.row_number().over(w.orderBy(F.desc("pred"), "asset")) <= 10, "b": F.row_number().over(w.orderBy(F.desc("actual"), "asset")) <= 10})
    both, any_ = F.count_if(F.col("a") & F.col("b")), F.count_if(F.col("a") | F.col("b"))
    return rows.groupBy("date").agg(both.alias("overlap"), r6(both / any_).alias("jaccard"))


@query("t_leaderboard", "SELECT s_suppkey, s_nationkey, score FROM (SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 4 > 0 THEN s_acctbal END AS score, row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE WHEN s_suppkey % 4 > 0 THEN s_acctbal END DESC NULLS LAST, s_suppkey) AS r FROM supplier) WHERE r <= 3")
def t_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").withColumn("score", F.when(F.col("s_suppkey") % 4 > 0, F.col("s_acctbal")))
    best = F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc_nulls_last("score"), "s_suppkey"))
    return rows.withColumn("r", best).where("r <= 3").select("s_suppkey", "s_nationkey", "score")


@query("t_stable_hash_order", "SELECT page_id, row_number() OVER (ORDER BY sha256('seed-1' || chr(10) || url), page_id) AS position FROM pages")
def t_stable_hash_order(spark: SparkSession, d: str) -> DataFrame:
    """A uniform, repeatable frontier order."""
    key = F.sha2(F.concat(F.lit("seed-1\n"), F.col("url")), 256)
    return table(spark, d, "pages").select("page_id", F.row_number().over(Window.orderBy(key, "page_id")).cast("long").alias("position"))


@query("u_intersect", "SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW' INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def u_intersect(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.where("o_orderpriority = '1-URGENT'").select("o_custkey").intersect(o.where("o_orderpriority = '5-LOW'").select("o_custkey")).intersect(table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey"))


@query("u_except_audit", "SELECT c_custkey FROM customer EXCEPT ALL SELECT o_custkey AS c_custkey FROM orders WHERE o_totalprice > 250000")
def u_except_audit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey").exceptAll(table(spark, d, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey")))


@query("u_contiguity", "SELECT min(event_id) AS low, max(event_id) AS high, count(DISTINCT event_id) AS n_ids, min(event_id) = 0 AND max(event_id) = count(DISTINCT event_id) - 1 AS contiguous FROM events")
def u_contiguity(spark: SparkSession, d: str) -> DataFrame:
    n = F.count_distinct("event_id")
    return table(spark, d, "events").agg(F.min("event_id").alias("low"), F.max("event_id").alias("high"), n.alias("n_ids"), ((F.min("event_id") == 0) & (F.max("event_id") == n - 1)).alias("contiguous"))


@query("u_union_fill", "SELECT event_type AS kind, user_id, value, NULL::VARCHAR AS segment FROM events WHERE value > 50 UNION ALL SELECT 'customer', c_custkey, NULL, c_mktsegment FROM customer WHERE c_acctbal > 5000")
def u_union_fill(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "events").where("value > 50").select(F.col("event_type").alias("kind"), "user_id", "value")
    b = table(spark, d, "customer").where("c_acctbal > 5000").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(b, allowMissingColumns=True)
