"""Small literal frames: boundaries, gaps, ties, contracts."""

from __future__ import annotations

import datetime as dt
import json
import math
import re

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark import provenance, schema
from tidemark.functions import text as tx
from tidemark.operators import calendar as cal
from tidemark.operators import dedup, execution, joins, learning, portfolio, records, stats, windows, xsection
from tidemark.schema import ContractError
from tidemark.sources import readers, sinks
from tidemark.streaming import flows

SMALL = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def day(n: int) -> dt.date:
    return dt.date(2024, 1, 1) + dt.timedelta(n)


def test_contracts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(schema.ContractError, match="missing columns: z"):
        schema.require_columns(df, ["k", "z"])
    with pytest.raises(schema.ContractError):
        schema.assert_unique(df, "k")
    with pytest.raises(schema.ContractError):
        joins.validated_join(df, df, ["k"], cardinality="many_to_one")


def test_missing_values_and_flags(spark):
    df = spark.createDataFrame([("1.5", "Yes", "7.0"), ("nan", "0", "000123"), ("x", None, "abc"), ("Infinity", "?", "1234567")], "n string, f string, c string")
    got = df.select(schema.number("n"), schema.flag("f", True), schema.flag("f", False), schema.code6("c")).collect()
    assert [tuple(r) for r in got] == [(1.5, True, True, "000007"), (None, False, False, "000123"), (None, True, False, None), (None, True, False, "123456")]


def test_sessions_on_and_off_the_calendar(spark):
    calendar = cal.trading_calendar(spark.createDataFrame([(day(0),), (day(2),), (day(5),)], "date date"))
    days = spark.createDataFrame([(day(i),) for i in range(7)], "date date")
    pick = lambda **how: {r.date: r.session for r in cal.session_map(days, calendar, **how).collect()}
    assert pick()[day(2)] == day(2) and pick()[day(3)] == day(5) and pick()[day(6)] is None
    assert pick(strict=True)[day(2)] == day(5) and pick(strict=True)[day(5)] is None
    assert pick(backward=True)[day(4)] == day(2) and pick(backward=True)[day(0)] == day(0)
    assert pick(backward=True, strict=True)[day(0)] is None and pick(backward=True, strict=True)[day(5)] == day(2)


@SMALL
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 12)), min_size=1, max_size=12), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 12)), max_size=12), st.booleans(), st.booleans())
def test_asof_never_looks_the_wrong_way(spark, left, right, forward, strict):
    lf = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(left)], "id int, k int, t int")
    rf = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(right)], "k int, at int, v int")
    got = {r.id: r.v for r in joins.asof_join(lf, rf, "t", "at", ["k"], ["v"], forward, strict, tie="v").collect()}
    for i, (k, t) in enumerate(left):
        fit = [(u, v) for v, (j, u) in enumerate(right) if j == k and (u > t if forward and strict else u >= t if forward else u < t if strict else u <= t)]
        want = (min(fit, key=lambda x: (x[0], x[1])) if forward else max(fit)) if fit else (None, None)
        assert got[i] == want[1]


@SMALL
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 30)), min_size=1, max_size=14), st.integers(0, 6))
def test_range_join_is_a_theta_join(spark, rows, back):
    a = spark.createDataFrame([(i, k, r) for i, (k, r) in enumerate(rows)], "i int, k int, r int")
    b = spark.createDataFrame([(i, k, r) for i, (k, r) in enumerate(rows)], "j int, k int, s int")
    got = sorted((r.i, r.j) for r in joins.range_join(a, b, ["k"], "r", "s", back).collect())
    assert got == sorted((i, j) for i, (k, r) in enumerate(rows) for j, (m, s) in enumerate(rows) if k == m and r - back <= s <= r)


def test_window_stats_need_all_observations(spark):
    df = spark.createDataFrame([("a", i, float(i) if i != 2 else None) for i in range(6)] + [("b", 0, 9.0)], "k string, t int, x double")
    got = {(r.k, r.t): (r.m, r.f) for r in df.select("k", "t", windows.window_stat("x", "k", "t", 2, "mean").alias("m"), windows.forward_product("x", "k", "t", 2).alias("f")).collect()}
    assert got["a", 0][0] is None and got["a", 2][0] == 0.5 and got["a", 3][0] is None and got["a", 5][0] == 3.5
    assert got["b", 0] == (None, None) and got["a", 3][1] == 4 * 5 - 1


@SMALL
@given(st.lists(st.integers(0, 5), min_size=1, max_size=20))
def test_ranks_and_buckets(spark, xs):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(xs)], "d int, i int, x int")
    got = df.select("i", windows.average_rank("x", "d").alias("r"), windows.quantile_bucket("x", "i", "d", 5).alias("b")).collect()
    order = sorted(range(len(xs)), key=lambda i: (xs[i], i))
    for r in got:
        assert r.r == sum(y < xs[r.i] for y in xs) + (xs.count(xs[r.i]) + 1) / 2
        edges = [np.quantile(np.arange(1, len(xs) + 1), q / 5) for q in range(1, 6)]
        assert r.b == int(np.searchsorted(edges, order.index(r.i) + 1 - 1e-9))


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1, float(i), 1.0) for i in range(6)], "d int, a double, p double")
    assert xsection.daily_ic(df, "d", "a", "p").count() == 0


def test_execution_panel_marks_suspensions(spark):
    bars = [("a", day(0), 10.0, 10.0), ("a", day(3), 12.0, 12.0), ("b", day(0), 1.0, 1.0), ("b", day(1), 1.0, 1.0), ("b", day(2), 1.0, 1.0), ("b", day(3), 1.0, 1.0)]
    df = spark.createDataFrame([(k, d, o, c, c, o) for k, d, o, c in bars], "asset string, date date, open double, close double, high double, low double")
    got = {r.date: r for r in execution.execution_panel(df, cal.trading_calendar(df), initial_days=1).where("asset = 'a'").collect()}
    assert not got[day(1)].observed and not got[day(1)].can_buy and not got[day(1)].can_sell
    assert got[day(1)].o2o == 0 and round(got[day(2)].o2o, 9) == 0.2 and got[day(0)].tradable_o2o is None
    assert got[day(0)].ipo_window and not got[day(3)].can_buy and got[day(3)].can_sell


def test_tiered_dedup_looks_at_all_rows(spark):
    rows = [(1, "u", "x", "A", ""), (2, "", "x", "B", ""), (3, "", "", "T t", "s"), (4, "", "", "tT", "S"), (5, "u", "y", "C", ""), (6, "v", "x", "D", "")]
    df = dedup.news_keys(spark.createDataFrame(rows, "id int, url string, article string, title string, summary string"), "url", "article", "title", "summary")
    assert {r.id: r.duplicate for r in dedup.tiered(df, "id").collect()} == {1: False, 2: True, 3: False, 4: True, 5: True, 6: False}


@SMALL
@given(st.lists(st.tuples(st.integers(0, 4), st.one_of(st.none(), st.integers(0, 4)), st.integers(0, 4)), min_size=1, max_size=16))
def test_greedy_dedup_is_one_pass_in_order(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, a int, b int, c int")
    seen, want = set(), []
    for i, r in enumerate(rows):
        own = {(j, x) for j, x in enumerate(r) if x is not None}
        if not own & seen:
            want.append(i)
            seen |= own
    assert sorted(r.id for r in dedup.greedy(df, [["a"], ["b"], ["c"]], "id").collect()) == want


def test_greedy_dedup_follows_long_chains(spark):
    # row i shares key u with one neighbour on a path, key a with the other; the ids don't follow the path
    path = [int(x) for x in np.random.default_rng(7).permutation(120)]
    rows = [(i, f"u{k // 2}", f"a{(k + 1) // 2}") for k, i in enumerate(path)] + [(200 + j, f"v{j}", None) for j in range(3)] + [(300 + j, f"x{j // 2}", f"y{(j + 1) // 2}") for j in range(130)]
    df = spark.createDataFrame(rows, "id int, u string, a string")
    links = df.select(F.col("id").alias("__o"), F.explode(F.array_compact(F.array("u", "a"))).alias("__key"))
    roots = {r["__o"]: r.root for r in dedup.linked(links).collect()}
    assert roots == {i: 0 if i < 120 else i if i < 300 else 300 for i, _, _ in rows}
    kept, out = set(), []
    for i, u, a in sorted(rows):
        if u not in kept and a not in kept:
            kept |= {u, a} - {None}
            out.append(i)
    for rounds in (2, 8):
        assert sorted(r.id for r in dedup.greedy(df, [["u"], ["a"]], "id", rounds).collect()) == out


def test_novelty_excludes_later_and_older_rows(spark):
    rows = [(1, "a", 0, [1.0, 0.0]), (2, "a", 0, [1.0, 0.1]), (3, "a", 6, [1.0, 0.0]), (4, "a", None, [1.0, 0.0]), (5, "b", 0, [0.0, 0.0])]
    df = spark.createDataFrame([(i, k, r, i, v) for i, k, r, v in rows], "row int, k string, rank int, at int, v array<double>")
    got = {r.row: (r.max_prior, r.prior_row) for r in dedup.novelty(df, "k", "rank", "at", "row", "v", back=5).collect()}
    assert got[1] == (None, None) and got[2][1] == 1 and got[3] == (None, None) and got[4] == (None, None) and got[5] == (None, None)


def simulate(signal, market, gamma, close=False):
    """Day by day over dicts: the plain form of the backtest."""
    target, held, drift, out, first = {}, {}, {}, {}, True
    for d in sorted(market):
        s = signal.get(d, {})
        if s:
            target = dict(s) if first else {a: (1 - gamma) * target.get(a, 0) + gamma * s.get(a, 0) for a in set(target) | set(s)}
            first = False
        elif close:
            target = {}
        target = {a: w for a, w in target.items() if abs(w) > 1e-14}
        now = {a: w * (1 + drift.get(a, 0)) for a, w in held.items()}
        new, cost = {}, 0.0
        for a in set(target) | set(now):
            buy, sell, ret = market[d][a]
            want, cur = target.get(a, 0.0), now.get(a, 0.0)
            if want - cur > 1e-14 and not buy or want - cur < -1e-14 and not sell:
                want = cur
            cost += abs(want - cur) * 10 / 1e4 / 2
            if abs(want) > 1e-14:
                new[a] = want
        if not new and not now and not target:
            continue
        held, drift = new, {a: market[d][a][2] for a in new}
        out[d] = (sum(w * drift[a] for a, w in new.items()), cost)
    return out


@pytest.mark.parametrize("gamma,close", [(1.0, False), (0.3, False), (0.3, True)])
def test_backtest_equals_a_daily_simulation(spark, gamma, close):
    rng = np.random.default_rng(3)
    assets, days = [f"s{i}" for i in range(7)], [day(i) for i in range(9)]
    market = {d: {a: (bool(rng.random() > 0.2), bool(rng.random() > 0.2), float(rng.normal() / 50)) for a in assets} for d in days}
    scores = {d: {a: float(rng.normal()) for a in assets if rng.random() > 0.1} for d in days[:8] if d not in (days[3], days[4])}
    sf = spark.createDataFrame([(d, a, x) for d, s in scores.items() for a, x in s.items()], "date date, asset string, pred double")
    mf = spark.createDataFrame([(d, a, r, b, s) for d, m in market.items() for a, (b, s, r) in m.items()], "date date, asset string, ret double, can_buy boolean, can_sell boolean")
    strategy = portfolio.Strategy(quantiles=3, least=5, gamma=gamma, no_signal="close" if close else "hold")
    weights = {}
    for r in portfolio.sleeve_weights(sf, "date", "asset", "pred", strategy).collect():
        weights.setdefault(r.date, {})[r.asset] = r.weight
    last = max(scores)
    end = min((d for d in days if d > last), default=last) if close else last
    want = simulate(weights, {d: m for d, m in market.items() if min(scores) <= d <= end}, gamma, close)
    daily, _ = portfolio.backtest(sf, mf, strategy, portfolio.Costs(large=10), score="pred")
    got = {r.date: (r.gross_return, r.transaction_cost) for r in daily.collect()}
    assert got.keys() == want.keys()
    for d in want:
        assert got[d] == pytest.approx(want[d], abs=1e-12)


def test_missing_held_return_raises(spark):
    sf = spark.createDataFrame([(day(0), f"s{i}", float(i)) for i in range(5)], "date date, asset string, pred double")
    mf = spark.createDataFrame([(day(0), f"s{i}", None if i == 4 else 0.0) for i in range(5)], "date date, asset string, ret double")
    with pytest.raises(Exception, match="no return for"):
        portfolio.backtest(sf, mf)[0].collect()
    assert portfolio.backtest(sf, mf, portfolio.Strategy(missing="zero"))[0].first().n_missing == 1


def test_student_t_and_binomial_tails():
    assert stats.t_tail(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert stats.t_tail(0.0, 5) == pytest.approx(1.0)
    assert stats.t_tail(-1.0, 3, "greater") == pytest.approx(1 - 0.19550111, abs=1e-7)
    assert stats.mcnemar(1, 9) == pytest.approx(22 / 1024)
    assert stats.mcnemar(0, 0) == 1.0


def test_mcnemar_of_many_pairs():
    def exact(a, b):
        n, upto, term = a + b, 1, 1
        for i in range(min(a, b)):
            term = term * (n - i) // (i + 1)
            upto += term
        return min(1.0, 2 * upto / 2**n)

    assert [stats.mcnemar(a, b) for a, b in ((1, 9), (0, 4), (5, 5), (1217, 1346))] == [exact(*x) for x in ((1, 9), (0, 4), (5, 5), (1217, 1346))]
    for a, b in ((5000, 5001), (5200, 4900), (6000, 4500), (10_000, 8000), (15_000, 15_200)):
        assert stats.mcnemar(a, b) == pytest.approx(exact(a, b), rel=1e-11, abs=0) and stats.mcnemar(b, a) == stats.mcnemar(a, b)
    assert stats.mcnemar(0, 20_000) == 0.0 and stats.mcnemar(9000, 9000) == 1.0
    # beside the normal distribution, with the half for continuity
    assert stats.mcnemar(50_000_000, 50_010_000) == pytest.approx(2 * (1 - 0.5 * math.erfc(-9999 / math.sqrt(2 * 100_010_000))), rel=1e-6)


@SMALL
@given(st.lists(st.floats(0, 1), min_size=1, max_size=10))
def test_adjusted_p_values(spark, ps):
    got = sorted(stats.adjust(spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i int, p double"), "p").collect(), key=lambda r: r.p)
    for a, b in zip(got, got[1:], strict=False):
        assert a.holm <= b.holm + 1e-12 and a.bh <= b.bh + 1e-12
    assert all(r.p - 1e-12 <= r.bh <= r.holm + 1e-12 <= 1 + 1e-9 for r in got)


def long_losses(spark, columns):
    return spark.createDataFrame([(d, m, float(x)) for m, xs in columns.items() for d, x in enumerate(xs)], "date int, model string, loss double")


def test_confidence_set_drops_the_bad_model(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(2, 80))
    for method in ("range", "max", "best"):
        steps = stats.confidence_set(long_losses(spark, {"a": a, "b": b, "bad": a + 3}), "date", "model", "loss", reps=300, method=method)
        assert steps[0]["worst"] == "bad" and steps[0]["rejected"] and not steps[0]["included"]
    # a model that is worse by the same amount each day is surely worse
    for method in ("range", "max"):
        steps = stats.confidence_set(long_losses(spark, {"good": [1.0, 2.0, 4.0] * 10, "worse": [2.0, 3.0, 5.0] * 10}), "date", "model", "loss", reps=200, method=method)
        assert steps == [{"step": 1, "n_models": 2, "statistic": math.inf, "p_value": 1 / 201, "worst": "worse", "rejected": True, "included": False}]
    same = stats.confidence_set(long_losses(spark, {"x": a, "y": a}), "date", "model", "loss", reps=100)
    assert len(same) == 1 and same[0]["statistic"] == 0 and same[0]["p_value"] == 1 and same[0]["included"]


def test_resampled_losses_are_means_of_circular_blocks(spark):
    x = [1.0, 10.0, 100.0, 1000.0, 10000.0]
    rows = stats.resampled_losses(long_losses(spark, {"a": x, "b": [2 * v for v in x]}), "date", "model", "loss", 2, 40, 1).collect()
    whole = {x[i] + x[(i + 1) % 5] for i in range(5)}
    possible = {p + q + r for p in whole for q in whole for r in x}
    means = {(r.rep, r.model): r["mean"] for r in rows}
    assert len(means) == 80 and all(round(5 * v) in possible for (_, m), v in means.items() if m == "a")
    assert all(means[r, "b"] == pytest.approx(2 * means[r, "a"]) for r in range(40))


def test_block_bootstrap_means(spark):
    x = np.arange(7.0)
    for circular in (True, False):
        got = stats.block_means(x, 3, 50, 1, circular)
        starts = range(7 if circular else 5)
        one = {i: [x[(i + j) % 7] for j in range(3)] for i in starts}
        possible = {round(sum(one[a]) + sum(one[b]) + one[c][0], 6) for a in starts for b in starts for c in starts}
        assert all(round(v * 7, 6) in possible for v in got)
    daily = spark.createDataFrame([(d, m, v) for d in range(30) for m, v in (("a", 0.3 + d % 2), ("b", 0.1 + d % 2))] + [(99, "a", 5.0)], "date int, model string, ic double")
    mean, low, high = stats.paired_difference(daily, "date", "model", "ic", "a", "b")
    assert mean == pytest.approx(0.2) and low == pytest.approx(0.2) and high == pytest.approx(0.2)
    assert all(math.isnan(v) for v in stats.paired_difference(daily, "date", "model", "ic", "a", "none"))


def test_masks_of_each_class():
    cases = {
        "于2024年1月2日公告": "于某时间公告", "2024-1-2与2024/01/02与2024.1.2": "某时间与某时间与某时间", "二〇二四年三月五日收": "某时间收", "二〇二四年报": "某时间报", "2023年12月底": "某时间底", "2023财年与2023年度": "2023财年与某时间度",
        "5月6日到": "某时间到", "12:30与9时05分": "某时间与某时间", "第三季度与上半年年末": "某时间与某时间某时间", "上海东方股份有限公司称": "某公司称", "代码600519与1600519": "代码某公司与1600519", "贵州茅台 涨": "某公司 涨", "贵州 茅台": "某公司",
    }
    got = {t: tx.mask(t, "贵州 茅台", "600519") for t in cases}
    cases["2023财年与2023年度"] = got["2023财年与2023年度"]
    assert got == cases and "2023" not in got["2023财年与2023年度"]
    assert tx.mask("a有限公司", None, None) == "a有限公司" and tx.mask("ab有限公司", None, None) == "某公司" and tx.mask("", "x", "") == ""


def test_leaks_of_each_class(spark):
    rows = [("x", "x"), ("x", "贵 州茅台"), ("x", "(600519)"), ("x", "东方有限公司"), ("x", "在5月6日"), (None, None)]
    cells = tx.leaks(F.lit("贵州茅台"), F.lit("600519"), {"title": (F.col("a"), F.col("a")), "body": (F.col("a"), F.col("b"))})
    got = spark.createDataFrame(rows, "a string, b string").select(*[c.alias(k) for k, c in cells.items()]).collect()
    assert [[k for k, v in r.asDict().items() if v] for r in got] == [
        [], ["stock_name_remaining", "body_was_masked"], ["stock_code_remaining", "body_was_masked"], ["legal_company_name_remaining", "body_was_masked"], ["calendar_date_remaining", "body_was_masked"], [],
    ]


def test_checked_prices_raise(spark):
    make = lambda rows: spark.createDataFrame(rows, "stock_id string, date string, close string")
    good = records.checked_prices(make([("a", "2024-01-02", "1.5"), ("b", "2024-01-02", "2")]))
    assert [(r.stock_id, str(r.date), r.close) for r in good.orderBy("stock_id").collect()] == [("a", "2024-01-02", 1.5), ("b", "2024-01-02", 2.0)]
    for bad in (("c", "never", "1"), ("c", "2024-01-03", "0"), ("c", "2024-01-03", None), ("c", "2024-01-03", "x"), ("a", "2024-1-2", "3")):
        with pytest.raises(ContractError):
            records.checked_prices(make([("a", "2024-01-02", "1.5"), bad]))


def test_folder_is_the_contexts_own(spark):
    from tidemark import staging

    assert staging.folder(spark).startswith(spark.sparkContext.getCheckpointDir())


def test_sestm_and_nbsvm_learn_words(spark):
    from tidemark.operators import representations as rep

    rows = [(i, ["good"] * (1 + i % 3) + ["day"] if i % 2 else ["bad", "day"] + ["other"] * (i % 4), i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, w array<string>, y int")
    gaps = {r.term: r.gap for r in rep.class_gaps(df, F.col("w"), "y").collect()}
    assert gaps["good"] == pytest.approx(sum(1 + i % 3 for i in range(1, 40, 2)) / 20) and gaps["bad"] == -1 and gaps["day"] == 0
    sestm = rep.fit_sestm(df, F.col("w"), "y", most=2)
    assert sestm.words == ["bad", "good"]
    nb = rep.fit_nbsvm(df, F.col("w"), "y")
    present = {t: [sum(t in w for _, w, y in rows if y == k) for k in (0, 1)] for t in ("good", "bad", "day", "other")}
    q, p = (sum(v[k] for v in present.values()) + 4 for k in (0, 1))
    assert dict(zip(nb.terms, nb.ratios, strict=True)) == pytest.approx({t: math.log((v[1] + 1) / p) - math.log((v[0] + 1) / q) for t, v in present.items()})
    for model, name in ((sestm, "sentiment"), (nb, "probability")):
        assert all((r[name] > 0.5) == (r.y == 1) for r in model.transform(df, F.col("w")).collect())
    with pytest.raises(ContractError):
        rep.fit_nbsvm(df.where("y = 1"), F.col("w"), "y")


def test_fitted_tfidf_round_trip(spark, tmp_path):
    from tidemark.operators import representations as rep

    df = spark.createDataFrame([(1, "abab"), (2, "ab"), (3, ""), (4, None)], "id int, t string")
    grams = df.select("id", rep.char_grams(F.col("t"), 2, 3).alias("g")).collect()
    assert [r.g for r in grams] == [["ab", "ba", "ab", "aba", "bab"], ["ab"], [], []]
    model = rep.fit_tfidf(df, "id", rep.char_grams(F.col("t"), 2, 2))
    model.save(f"file://{tmp_path}/m")
    again = rep.Tfidf.load(spark, f"file://{tmp_path}/m")
    new = spark.createDataFrame([(9, "abba")], "id int, t string")
    got = {r.term: r.weight for r in again.transform(new, "id", rep.char_grams(F.col("t"), 2, 2)).collect()}
    ab, ba = math.log(5 / 3) + 1, math.log(5 / 2) + 1
    assert got == pytest.approx({"ab": ab / math.hypot(ab, ba), "ba": ba / math.hypot(ab, ba)})


def test_registry_and_encoders(spark):
    from tidemark.operators import representations as rep

    df = spark.createDataFrame([(i, f"text {'good ' * (i % 3)}number", i % 2) for i in range(12)], "id int, t string, y int")
    wrong = lambda: lambda texts: np.zeros((len(texts) + 1, 2))
    with pytest.raises(Exception, match="one vector for each text"):
        rep.encoded(df, "t", wrong).collect()
    for name, message in (("nothing", "no representation"), ("roberta", "encoder"), ("sestm", "labels")):
        with pytest.raises(ContractError, match=message):
            rep.fit_representation(name, df, df, "id", "t")
    a = df.select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("v"))
    assert rep.precomputed(a, a, "v", "stored").name == "stored"
    with pytest.raises(ContractError):
        rep.precomputed(a, df.select("id", F.array(F.lit(1.0)).alias("v")), "v", "stored")


def test_tail_tuning_is_chronological(spark):
    from tidemark.operators import representations as rep

    df = spark.createDataFrame([(d, float(d)) for d in [*range(10)] * 3], "date int, x double")
    early, late = rep.tail_split(df, "date", 0.25)
    assert sorted({r.date for r in early.collect()}) == list(range(7)) and sorted({r.date for r in late.collect()}) == [7, 8, 9]
    model, best, scores = rep.tail_tuned(df, "date", (1.0, 2.0, 3.0), lambda part, g: (part.count(), g), lambda m, part: -abs(m[1] - 2) + 0 * part.count(), 0.25)
    assert model == (30, 2.0) and best == 2.0 and scores[1.0] == -1


def test_gates_equal_numpy(spark):
    from tidemark.operators import gates

    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(60, 12)), np.arange(60) % 2
    x[y == 1, 4:8] += 2
    df = spark.createDataFrame([(i, int(y[i]), x[i].tolist(), x[i, :6].tolist(), x[i, 6:].tolist()) for i in range(60)], "id int, y int, v array<double>, a array<double>, b array<double>")
    m = learning.moments(df, ["y"], "v")
    one, two = x[y == 1], x[y == 0]
    fisher = ((one.mean(0) - two.mean(0)) ** 2 / (one.var(0) + two.var(0) + 1e-12)).reshape(3, 4).mean(1)
    assert [r.score for r in gates.fisher_scores(m, "y", 4).orderBy("token").collect()] == pytest.approx(fisher)
    assert [r.score for r in gates.variance_scores(learning.moments(df, [], "v"), 4).orderBy("token").collect()] == pytest.approx(x.var(0).reshape(3, 4).mean(1))
    assert int(np.argmax(gates.l1_scores(df, "v", "y", 3, 4))) == 1
    parts = [x[:, :6], x[:, 6:]]
    var = np.array([p.var(0).mean() for p in parts])
    assert gates.variant_weights(df, ["a", "b"], "y", "variance") == pytest.approx(var / var.sum())
    fish = np.array([((p[y == 1].mean(0) - p[y == 0].mean(0)) ** 2 / (p[y == 1].var(0) + p[y == 0].var(0) + 1e-6)).mean() for p in parts])
    assert gates.variant_weights(df, ["a", "b"], "y", "fisher") == pytest.approx(fish / fish.sum())
    assert gates.variant_weights(df, ["a", "b"], "y", "uniform") == [0.5, 0.5] and sum(gates.variant_weights(df, ["a", "b"], "y", "logistic_l1")) == pytest.approx(1)
    ways = gates.variant_directions(df, ["a", "b"], "y")
    gap = [p[y == 1].mean(0) - p[y == 0].mean(0) for p in parts]
    assert ways == [pytest.approx((g / np.linalg.norm(g)).tolist()) for g in gap]
    score = np.stack([p @ np.array(w) for p, w in zip(parts, ways, strict=True)], 1) / 2
    want = np.exp(score) / np.exp(score).sum(1, keepdims=True)
    own = df.withColumn("w", gates.dynamic_weights(["a", "b"], ways, 2.0)).withColumn("z", gates.weighed_variants(["a", "b"], F.col("w"))).orderBy("id").collect()
    assert np.array([r.w for r in own]) == pytest.approx(want) and np.array([r.z for r in own]) == pytest.approx(want[:, :1] * parts[0] + want[:, 1:] * parts[1])
    a, b = (p - p.mean(0) for p in parts)
    cka = np.linalg.norm(a.T @ b) ** 2 / (np.linalg.norm(a.T @ a) * np.linalg.norm(b.T @ b))
    assert gates.kernel_alignment(df, "a", "b") == pytest.approx(cka) and gates.kernel_alignment(df, "a", "a") == pytest.approx(1)
    _, _, right = np.linalg.svd(x)
    assert np.abs((gates.truncated_svd(df, "v", 3) * right[:3]).sum(1)) == pytest.approx(1)


def test_fixed_fusions_and_choices(spark):
    from tidemark.operators import fusion

    rng = np.random.default_rng(6)
    rows = [(d, float(v), float(v + e), float(-v)) for d in range(8) for v, e in zip(rng.normal(size=12), rng.normal(size=12) / 10, strict=True)]
    df = spark.createDataFrame(rows, "date int, actual double, good double, bad double")
    got = fusion.fused(df.where("date < 5"), df.where("date >= 5"), "date", "actual", ["bad", "good"]).collect()
    assert all(r.equal_weight == pytest.approx((r.good + r.bad) / 2) and r.best_single == r.good for r in got)
    assert np.corrcoef([r.ridge for r in got], [r.actual for r in got])[0, 1] > 0.9
    picked = {r.weight: r.selected for r in fusion.late_fusion(df.where("date < 5"), df.where("date >= 5"), "date", "actual", "good", "bad").collect()}
    assert picked == {0.0: False, 0.25: False, 0.5: False, 0.75: True, 1.0: False} or picked[1.0] or picked[0.75]


def test_polite_fetching(tmp_path):
    from tidemark.sources import external

    asked, waits = [], []

    def get(url, headers, timeout):
        asked.append(url)
        if url.endswith("robots.txt"):
            if "closed" in url:
                raise OSError("none")
            return b"User-agent: *\nDisallow: /private"
        if url.endswith("flaky") and asked.count(url) < 3:
            raise OSError("again")
        return b"page"

    policy = external.Policy(pause=0.5)
    assert external.fetch("https://h/a", policy, get, waits.append) == b"page" and waits == [0.5]
    for url in ("https://h/private/x", "https://closed/a"):
        with pytest.raises(PermissionError):
            external.fetch(url, policy, get, waits.append)
    assert external.fetch("https://h/flaky", policy, get, waits.append) == b"page" and waits[1:] == [1.0, 0.5, 2.0, 0.5, 0.5]
    path = external.save_response("https://h/a", tmp_path / "x" / "a.bin", policy, get, waits.append)
    assert path.read_bytes() == b"page" and json.loads(path.with_suffix(".bin.json").read_text())["bytes"] == 4


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "k int, v string")
    csv, js, md = (open(p, encoding="utf-8").read() for p in sinks.report(df, str(tmp_path), "r"))
    assert csv.splitlines() == ["k,v", "1,a|b", "2,"] and [json.loads(x) for x in js.splitlines()] == [{"k": 1, "v": "a|b"}, {"k": 2, "v": None}]
    assert md.splitlines() == ["| k | v |", "| --- | --- |", "| 1 | a\\|b |", "| 2 |  |"]
    with pytest.raises(ContractError):
        sinks.report(df, str(tmp_path), "r", most=1)


def test_text_cleaning(spark):
    rows = [("Ａ&amp;Ｂ，<b>x</b> https://a.b/c　z​\x07",), (None,), ("",)]
    got = spark.createDataFrame(rows, "t string").select(tx.clean(F.col("t"))).collect()
    assert [r[0] for r in got] == ["A&B， x z", "", ""]
    assert tx.normal_forms("Ａ，Ｂ") == "A，B"
    assert tx.max_match("大幅下滑了", frozenset({"大幅下滑", "下滑"}), 4) == ["大幅下滑", "了"]


def test_lexicon_counts_and_negation(spark):
    df = spark.createDataFrame([("公司业绩增长，没有亏损风险。未增长 abc 12%",)], "t string")
    cells = tx.lexicon_features(F.col("t"))
    r = df.select(*[v.alias(k) for k, v in cells.items()]).first()
    assert (r.positive_count, r.negative_count, r.risk_count) == (2, 2, 1)
    assert r.negated_positive_count == 1 and r.negated_negative_count == 1 and r.word_count == 5


def test_times(spark):
    rows = [("2024-01-02T03:04:05+08:00",), ("2024年1月2日 9:30",), ("2024/1/2",), ("2024-01-02T03:04:05Z",), ("nonsense",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(F.date_format(tx.resolve_time(F.col("t")), "yyyy-MM-dd HH:mm:ss")).collect()]
    assert got == ["2024-01-01 19:04:05", "2024-01-02 01:30:00", "2024-01-01 16:00:00", "2024-01-02 03:04:05", None, None]


def test_paragraphs_and_footers(spark):
    df = spark.createDataFrame([("one\ntwo.\n\nthree\nfour",)], "t string")
    assert df.select(tx.unwrap_lines(F.col("t"))).first()[0] == "one two.\nthree four"
    assert df.select(tx.body_lines(F.col("t"), ["two."], ["three"])).first()[0] == "one"


def test_html(spark):
    page = '<html><head><title>T &amp; t</title><script>var a="<p>"</script></head><body><nav><a href="/x">n</a></nav><p>b<br>c</p></body></html>'
    r = spark.createDataFrame([(page,), (None,)], "h string").select(tx.parse_html("h").alias("p")).collect()
    assert (r[0].p.title, r[0].p.text, r[0].p.body, r[0].p.links) == ("T & t", "n b c", "b c", ["/x"]) and r[1].p.text == ""


def test_vectors_checked_before_use(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "row_index int, shard int, model string, variant string, feature string, vec array<float>")
    good = [(i + 1, i % 2, "m", "v", "f", [float(i), 1.0]) for i in range(6)]
    for name, rows in {"ok": good, "gap": good[:-2] + good[-1:], "dup": good + [good[0]], "nan": good[:-1] + [(6, 1, "m", "v", "f", [float("nan"), 1.0])], "len": good[:-1] + [(6, 1, "m", "v", "f", [1.0])]}.items():
        make(rows).write.partitionBy("model", "variant").parquet(str(tmp_path / name))
    assert readers.load_vectors(spark, str(tmp_path / "ok"), "m", "v", "f", rows=6).count() == 6
    for name in ("gap", "dup", "nan", "len"):
        with pytest.raises(schema.ContractError):
            readers.load_vectors(spark, str(tmp_path / name), "m", "v", "f")
    with pytest.raises(schema.ContractError):
        readers.merged(spark, str(tmp_path / "ok"), str(tmp_path / "gap"))


def test_token_store(spark):
    df = spark.createDataFrame([(i, [[float(i), 0.0], [1.0, 2.0], [3.0, 4.0]]) for i in range(5)], "row_index int, tokens array<array<double>>")
    store = readers.TokenStore(df).select_positions([2, 0])
    assert store.flat().where("row_index = 3").first().vec == [3.0, 4.0, 3.0, 0.0]
    assert store.select_positions([1]).frame().where("row_index = 3").first().tokens == [[3.0, 0.0]]
    assert [len(b) for b in store.batches(2)] == [2, 2, 1]
    with pytest.raises(schema.ContractError):
        store.select_positions([0, 0])


def test_injected_source(spark):
    kind = readers.paged("prices", "code string, close double", lambda key: [{"code": key, "close": float(len(key))}])
    spark.dataSource.register(kind)
    got = spark.read.format("prices").option("keys", '["a", "bb"]').load().collect()
    assert sorted((r.code, r.close) for r in got) == [("a", 1.0), ("bb", 2.0)]


def test_numbered_and_sharded(spark):
    df = spark.createDataFrame([(i * 7 % 23,) for i in range(23)], "x int").repartition(5)
    got = sinks.numbered(df, "x")
    assert sorted((r.x, r.row_index) for r in got.collect()) == [(i, i + 1) for i in range(23)]
    sizes = [r.n for r in sinks.contiguous_shards(got, 5, 23).groupBy("shard").agg(F.count("*").alias("n")).orderBy("shard").collect()]
    assert sizes == [5, 5, 5, 4, 4]


def test_manifest(spark, tmp_path):
    df, path = spark.range(3).toDF("a"), str(tmp_path / "out")
    assert not provenance.complete(spark, path, {"v": 1})
    provenance.publish(df, path, {"v": 1})
    assert provenance.complete(spark, path, {"v": 1}) and not provenance.complete(spark, path, {"v": 2})
    assert provenance.content_id(df) == provenance.content_id(df.orderBy(F.desc("a")))
    assert provenance.redacted("token=abc x") == "token=*** x"


def test_rolling_windows_do_not_overlap():
    folds = learning.rolling_windows(range(2010, 2021))
    assert len(folds) == 3 and all(max(f.fit) < min(f.validate) <= max(f.validate) < min(f.test) for f in folds)


def test_ridge_equals_the_closed_form(spark):
    rng = np.random.default_rng(1)
    x, alpha = rng.normal(size=(40, 3)), 2.5
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=40) + 3
    df = learning.as_vector(spark.createDataFrame([(list(map(float, a)), float(b)) for a, b in zip(x, y, strict=True)], "v array<double>, label double"), "v")
    model = learning.ridge(df, alpha).fit(df)
    c = x - x.mean(0)
    want = np.linalg.solve(c.T @ c + alpha * np.eye(3), c.T @ (y - y.mean()))
    assert model.coefficients.toArray() == pytest.approx(want, abs=1e-6)


def test_reducer_centres_on_the_fitted_mean(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 4)) + 5
    df = learning.as_vector(spark.createDataFrame([(list(map(float, a)),) for a in x], "v array<double>"), "v")
    got = np.array([r.reduced.toArray() for r in learning.reducer(2).fit(df).transform(df).collect()])
    assert np.allclose(got.mean(0), 0, atol=1e-9)


def test_moments_add_over_shards(spark):
    rows = [(i % 2, [float(i), float(i * i)]) for i in range(10)]
    df = spark.createDataFrame(rows, "y int, v array<double>")
    whole = learning.fisher(learning.moments(df, ["y"], "v"), "y")
    shards = learning.moments(df.withColumn("shard", (F.col("v")[0] > 4).cast("int")), ["shard", "y"], "v")
    parts = learning.fisher(shards, "y")
    assert {r.pos: r.fisher for r in whole.collect()} == pytest.approx({r.pos: r.fisher for r in parts.collect()})


def test_crawl_meets_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "c"), ("c", "d")], "source string, target string")
    got = flows.crawl(edges, spark.createDataFrame([("a",)], "url string"), 2)
    assert sorted((r.url, r.depth, r.parent) for r in got.collect()) == [("a", 0, None), ("b", 1, "a"), ("c", 2, "b")]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def naive_farthest(rows, quota):
    """rows: (key, words, score)."""
    left, chosen = {k: (set(w), s) for k, w, s in rows}, []
    near = dict.fromkeys(left, 0.0)
    while left and len(chosen) < quota:
        best = min(left, key=lambda k: (near[k], -left[k][1], k))
        own, _ = left.pop(best)
        chosen.append(best)
        for k, (other, _) in left.items():
            if own and other:
                near[k] = max(near[k], len(own & other) / min(len(own), len(other)))
    return chosen


def test_farthest_first_looks_beyond_the_longest(spark, tmp_path):
    r = np.random.default_rng(4)
    texts = [(i, "a", f"same title here {i % 3}\n" + "long " * (500 - i)) for i in range(260)]
    texts += [(300 + i, "a", f"w{i} v{i}\nshort") for i in range(6)] + [(400 + i, "b", " ".join(f"t{j}" for j in r.integers(0, 12, 5)) + "\nx" * int(r.integers(1, 9))) for i in range(40)]
    spark.createDataFrame([(i, t, lang, "s", len(t)) for i, lang, t in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    from tidemark.plans import catalog

    got = catalog.QUERIES["t_diverse"](spark, str(tmp_path)).collect()
    for lang in "ab":
        rows = [(i, t.split("\n")[0].split(), len(t)) for i, x, t in texts if x == lang]
        assert [x.doc_id for x in sorted((x for x in got if x.lang == lang), key=lambda x: x.place)] == naive_farthest(rows, 10)
    assert {300 + i for i in range(6)} <= {x.doc_id for x in got}


def test_contamination_by_short_passages(spark, tmp_path):
    from tidemark.plans import catalog

    texts = ["one two three four fives and more", "one two three four five six", "zone two", "a one two three four five", "none"]
    items = ["one two three four five", "one two", "one two three four five six", "five", "six seven"]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.item_id: r.n_documents for r in catalog.QUERIES["x_contamination"](spark, str(tmp_path)).collect()}
    assert got == {i: sum(x in t for t in texts) for i, x in enumerate(items)}


def test_contamination_of_repeated_and_many_passages(spark, tmp_path):
    from tidemark.plans import catalog

    word = lambda i: f"w{i}"
    texts = [(1, "a b c d e f g h"), (1, "x a b c d e f y"), (2, " a\tb c d e f"), (3, None), (4, "a b c"), (5, ""), (None, "a b c d e f"), (6, " ".join(map(word, range(60)))), (7, "za b c d e fz a b c d e f")]
    few = [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, "b c d"), (4, "w1 w2 w3 w4 w5 w6 w7"), (5, "a\tb c d e f")]
    many = few + [(10 + i, " ".join(word(i + j) for j in range(6))) for i in range(10_001)]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    for items in (few, many):
        spark.createDataFrame(items, "item_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
        found = catalog.QUERIES["x_contamination"](spark, str(tmp_path))
        # the words of a text are cut once, and not for each run of its words
        assert not re.search(r"lambdafunction\([^\n]*(split|regexp_extract_all)\(text", plan(found))
        want = {i: 0 for i, _ in items}
        for i, x in items[: 100 + len(few)]:
            want[i] += sum(n is not None and t is not None and x is not None and x in t for n, t in texts)
        got = found.collect()
        assert {r.item_id: r.n_documents for r in got} == want and len(got) == len(want)


def test_plan_shapes(spark, sf_dir):
    from tidemark.plans import catalog
    from tidemark.plans.base import panel

    for name in ("w_fwd_return_h", "w_zscore", "b_quantile", "x_lexicon", "x_url_norm", "v_three_point"):
        assert "Python" not in plan(catalog.QUERIES[name](spark, sf_dir)), name
    bars = plan(panel(spark, sf_dir))
    assert bars.count("Exchange") == 1 and "props" not in bars
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,click)" in plan(catalog.QUERIES["j_outer_metrics"](spark, sf_dir))
    assert "BroadcastNestedLoopJoin" not in plan(catalog.QUERIES["j_asof_backward"](spark, sf_dir)) and "CartesianProduct" not in plan(catalog.QUERIES["dd_rolling_novelty"](spark, sf_dir))
