"""Portfolios: quantile sleeves, costs, exponentially weighted targets, the constrained backtest, performance."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.windows import drawdown, quantile_bucket, wealth
from tidemark.schema import assert_unique, flag, require_columns

TINY = 1e-14


@dataclass(frozen=True)
class Costs:
    """Basis points.  ``small`` applies to small assets; ``stamp`` to sales; ``borrow`` is a yearly rate on shorts."""

    large: float = 10.0
    small: float = 20.0
    stamp: float = 0.0
    borrow: float = 0.0

    def __post_init__(self) -> None:
        if min(self.large, self.small, self.stamp, self.borrow) < 0:
            raise ValueError("cost rates must not be negative")


@dataclass(frozen=True)
class Strategy:
    quantiles: int = 5
    value_weighted: bool = False
    gamma: float = 1.0
    sides: str = "both"  # both, long, short
    least: int = 5
    missing: str = "raise"  # raise, zero
    no_signal: str = "hold"  # hold, close
    gross: bool = False  # divide the return of both sleeves by two

    def __post_init__(self) -> None:
        if self.quantiles < 2 or self.least < self.quantiles:
            raise ValueError("at least two quantiles, and as many assets as quantiles, are needed")
        if not 0 < self.gamma <= 1:
            raise ValueError("gamma must lie in (0, 1]")
        if self.sides not in ("both", "long", "short") or self.missing not in ("raise", "zero") or self.no_signal not in ("hold", "close"):
            raise ValueError("unknown option")

    @property
    def sleeves(self) -> int:
        return 2 if self.sides == "both" else 1


def bucketed(df: DataFrame, date: str, asset: str, score: str, q: int, least: int | None = None) -> DataFrame:
    """Rows with ``bucket`` 0 .. q-1 on dates with enough assets."""
    rows = df.where(F.col(score).isNotNull()).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(date)))
    return rows.where(F.col("__n") >= max(q, least or q)).withColumn("bucket", quantile_bucket(score, asset, date, q))


def quantile_portfolio(df: DataFrame, date: str, asset: str, score: str, realized: str, q: int = 5) -> DataFrame:
    """(date, q1 .. qq, low, high, long_short, n)."""
    rows = bucketed(df.where(F.col(realized).isNotNull()), date, asset, score, q)
    cells = [F.avg(F.when(F.col("bucket") == i, F.col(realized))).alias(f"q{i + 1}") for i in range(q)]
    wide = rows.groupBy(date).agg(*cells, F.count(F.lit(1)).alias("n"))
    return wide.withColumns({"low": F.col("q1"), "high": F.col(f"q{q}"), "long_short": F.col(f"q{q}") - F.col("q1")})


def sleeve_weights(df: DataFrame, date: str, asset: str, score: str, strategy: Strategy, cap: str | None = None) -> DataFrame:
    """(date, asset, weight): 1 over the top quantile, -1 over the bottom, equal or by ``cap``."""
    rows = bucketed(df, date, asset, score, strategy.quantiles, strategy.least)
    side = F.when((F.col("bucket") == strategy.quantiles - 1) & F.lit(strategy.sides != "short"), 1).when((F.col("bucket") == 0) & F.lit(strategy.sides != "long"), -1)
    rows = rows.withColumn("__side", side).where("__side is not null")
    size = F.col(cap).cast("double") if strategy.value_weighted and cap else F.lit(1.0)
    share = size / F.sum(size).over(Window.partitionBy(date, "__side"))
    return rows.select(date, asset, (F.col("__side") * share).alias("weight"))


def small_assets(df: DataFrame, date: str, cap: str, quantile: float = 0.2) -> DataFrame:
    """``small``: under the date's cap quantile of positive caps."""
    edge = df.where(F.col(cap) > 0).groupBy(date).agg(F.percentile(cap, quantile).alias("__edge"))
    return df.join(edge, date, "left").withColumn("small", F.coalesce(F.col(cap) < F.col("__edge"), F.lit(False))).drop("__edge")


def targets(weights: DataFrame, date: str, asset: str, gamma: float) -> DataFrame:
    """(date, asset, target) on signal dates: (1 - gamma) of the last target and gamma of the signal; the first is the signal.

    One asset's recursion runs over its own rows of the grid of signal dates, and assets run in parallel.
    """
    days = weights.select(date).distinct().agg(F.array_sort(F.collect_set(date)).alias("__d"))
    spine = weights.select(asset).distinct().join(days).select(asset, F.explode("__d").alias(date))
    rows = spine.join(weights, [date, asset], "left").select(date, asset, F.coalesce("weight", F.lit(0.0)).alias("target"))

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(date)
        return group.assign(target=group["target"].ewm(alpha=gamma, adjust=False).mean())

    return rows.groupBy(asset).applyInPandas(fold, rows.schema).where(F.abs("target") > TINY)


def backtest(signals: DataFrame, market: DataFrame, strategy: Strategy | None = None, costs: Costs | None = None, date: str = "date", asset: str = "asset", score: str = "pred", ret: str = "ret", cap: str | None = None, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(daily, holdings) of a ranked strategy with drifting holdings, costs and trading limits.

    ``market`` is dense (date, asset, ret) and may have can_buy, can_sell, shortable, eligible and small.  A day's
    targets need the whole cross-section, but given them no asset's holding depends on another's: assets
    are folded in parallel, each over its own sessions, and the days are then summed.
    """
    strategy, costs = strategy or Strategy(), costs or Costs()
    require_columns(signals, [date, asset, score])
    require_columns(market, [date, asset, ret])
    if strict:
        assert_unique(signals, date, asset)
        assert_unique(market, date, asset)
    ends = signals.agg(F.min(date).alias("__lo"), F.max(date).alias("__hi"))
    if strategy.no_signal == "close":  # the closing trade is paid at the next session
        after = market.select(F.col(date).alias("__m")).join(ends).where("__m > __hi").agg(F.min("__m").alias("__next"))
        ends = ends.join(after).select("__lo", F.coalesce("__next", "__hi").alias("__hi"))
    market = market.join(ends).where((F.col(date) >= F.col("__lo")) & (F.col(date) <= F.col("__hi"))).drop("__lo", "__hi")
    fixed = {"can_buy": True, "can_sell": True, "shortable": True, "small": False}
    columns = {c: flag(c, not on if c in market.columns and c != "small" else on) if c in market.columns else F.lit(on) for c, on in fixed.items()}
    flags = market.select(date, asset, F.col(ret).cast("double").alias("ret"), *[v.alias(c) for c, v in columns.items()])
    chosen = signals
    if "eligible" in market.columns:
        chosen = signals.join(market.select(date, asset, flag("eligible", False).alias("__ok")), [date, asset], "left").where("__ok").drop("__ok")
    weights = sleeve_weights(chosen, date, asset, score, strategy, cap)
    live = weights.select(date).distinct().withColumn("signal_day", F.lit(True))
    days = market.select(date).union(signals.select(date)).distinct().join(live, date, "left").withColumn("signal_day", F.coalesce("signal_day", F.lit(False)))
    grid = days.agg(F.collect_list(F.struct(date, "signal_day")).alias("__d"))
    spine = weights.select(asset).distinct().join(grid).select(asset, F.explode("__d").alias("__d")).select(asset, "__d.*")
    first = live.agg(F.min(date).alias("__first"))
    rows = spine.join(first).join(weights, [date, asset], "left").join(flags, [date, asset], "left")
    rows = rows.select(date, asset, "signal_day", (F.col(date) == F.col("__first")).alias("first_day"), F.coalesce("weight", F.lit(0.0)).alias("signal"), "ret", *[F.coalesce(c, F.lit(on if c not in market.columns or c == "small" else False)).alias(c) for c, on in fixed.items()])
    fields = f"{date} {dict(rows.dtypes)[date]}, {asset} {dict(rows.dtypes)[asset]}, signal double, target double, pretrade double, requested double, weight double, held_return double, missing boolean, small boolean"

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        out, target, weight, drift = [], 0.0, 0.0, 0.0
        for r in group.sort_values(date).itertuples(index=False):
            if r.signal_day:
                target = r.signal if r.first_day else (1 - strategy.gamma) * target + strategy.gamma * r.signal
            elif strategy.no_signal == "close":
                target = 0.0
            target = target if abs(target) > TINY else 0.0
            now = weight * (1 + drift)
            goal = target
            if not r.shortable and goal < min(now, 0.0):
                goal = min(now, 0.0)
            if goal - now > TINY and not r.can_buy or goal - now < -TINY and not r.can_sell:
                goal = now
            if not target and not now and not goal:
                weight, drift = 0.0, 0.0
                continue
            weight = goal if abs(goal) > TINY else 0.0
            missing = bool(weight) and not (r.ret == r.ret and abs(r.ret) < float("inf"))
            if missing and strategy.missing == "raise":
                raise ValueError(f"no return for {getattr(r, asset)} held on {getattr(r, date)}")
            drift = 0.0 if missing or not weight else float(r.ret)
            out.append((getattr(r, date), getattr(r, asset), r.signal, target, now, target - now, goal, drift, missing, r.small))
        return pd.DataFrame(out, columns=[date, asset, "signal", "target", "pretrade", "requested", "weight", "held_return", "missing", "small"])

    holdings = rows.groupBy(asset).applyInPandas(fold, fields)
    return daily_results(holdings, strategy, costs, date), holdings


def daily_results(holdings: DataFrame, strategy: Strategy, costs: Costs, date: str) -> DataFrame:
    n = strategy.sleeves
    delta = F.col("weight") - F.col("pretrade")
    rate = F.when(F.col("small"), costs.small).otherwise(costs.large) / 10_000
    buy, sell = F.greatest(delta, F.lit(0.0)), F.greatest(-delta, F.lit(0.0))
    held = F.when(F.abs("weight") > TINY, F.col("weight")).otherwise(0.0)
    pnl, divisor = held * F.col("held_return"), (n if strategy.gross else 1)
    rows = holdings.groupBy(date).agg(
        (F.sum(F.when(held > 0, pnl).otherwise(0.0)) / divisor).alias("long_return"), (F.sum(F.when(held < 0, pnl).otherwise(0.0)) / divisor).alias("short_return"),
        (F.sum(buy * rate + sell * (rate + costs.stamp / 10_000)) / n).alias("transaction_cost"), (F.sum(F.greatest(-held, F.lit(0.0))) * costs.borrow / 10_000 / 252 / n).alias("borrow_cost"),
        (F.sum(buy) / n).alias("buy_turnover"), (F.sum(sell) / n).alias("sell_turnover"), (F.sum(F.abs("requested")) / 2 / n).alias("requested_turnover"),
        (F.sum(F.abs(F.col("requested") - delta)) / n).alias("blocked_notional"), F.sum(F.abs(held)).alias("gross_exposure"), F.sum(held).alias("net_exposure"),
        F.count_if(held > TINY).alias("n_long"), F.count_if(held < -TINY).alias("n_short"), F.count_if("missing").alias("n_missing"),
    )
    rows = rows.withColumns({"gross_return": F.col("long_return") + F.col("short_return"), "turnover": (F.col("buy_turnover") + F.col("sell_turnover")) / 2})
    return rows.withColumn("net_return", F.col("gross_return") - F.col("transaction_cost") - F.col("borrow_cost"))


def performance(daily: DataFrame, date: str, ret: str, days: int = 252, floor: bool = True) -> DataFrame:
    """One row of annualised statistics of a daily series (one row a date, so its windows need no partitions)."""
    rows = daily.where(F.col(ret).isNotNull()).select(F.lit(0).alias("__k"), date, F.col(ret).alias("__r"))
    rows = rows.withColumn("__w", wealth("__r", "__k", date)).withColumn("__d", drawdown("__w", "__k", date, floor))
    mean, sd, n = F.avg("__r"), F.stddev_samp("__r"), F.count(F.lit(1))
    final = F.max_by("__w", date)
    got = rows.agg(
        n.alias("n_days"), mean.alias("mean"), (mean * days).alias("annualized_return"), sd.alias("volatility"), (sd * days**0.5).alias("annualized_volatility"),
        (mean / F.when(sd > 0, sd) * days**0.5).alias("sharpe"), (mean / F.when(sd > 0, sd) * F.sqrt(n)).alias("mean_t_stat"),
        F.when(final > 0, F.pow(final, days / n) - 1).alias("geometric_return"), (final - 1).alias("cumulative_return"), F.min("__d").alias("max_drawdown"),
        F.sqrt(F.avg(F.pow(F.least(F.col("__r"), F.lit(0.0)), 2))).alias("__down"), F.avg((F.col("__r") > 0).cast("double")).alias("positive_day_rate"), F.max("__r").alias("best_day"), F.min("__r").alias("worst_day"),
    )
    calmar = F.when(F.col("max_drawdown") < 0, F.col("geometric_return") / F.abs("max_drawdown"))
    return got.withColumns({"sortino": F.col("mean") / F.when(F.col("__down") > 0, F.col("__down")) * days**0.5, "calmar": calmar}).drop("__down")


def turnover(weights: DataFrame, calendar: DataFrame, date: str, asset: str) -> DataFrame:
    """(date, buys, sells): sums of the changes from the calendar's session before, whose weights count 0 where absent."""
    from tidemark.operators.calendar import shift_session

    old = shift_session(weights, calendar, date, 1, "__next").where("__next is not null").select(F.col("__next").alias(date), asset, F.col("weight").alias("__old"))
    both = weights.join(old, [date, asset], "full_outer")
    change = F.coalesce("weight", F.lit(0.0)) - F.coalesce("__old", F.lit(0.0))
    return both.groupBy(date).agg(F.sum(F.greatest(change, F.lit(0.0))).alias("buys"), F.sum(F.greatest(-change, F.lit(0.0))).alias("sells"))
