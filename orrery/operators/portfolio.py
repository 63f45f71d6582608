"""Weights to daily returns: turnover, cost, drift, equity and statistics, as windows.

A position on day t is either today's target or what the last target has become.
With a rebalance on every day that is a ``lag`` over the calendar; between sparse
rebalances it is a running product.  No day waits for the one before it, but where
a volatility target makes weights depend on the returns before.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

YEAR = 252


def execute_daily(targets: DataFrame, returns: DataFrame, days: DataFrame, cost_bps: float = 3.0) -> DataFrame:
    """Per (strategy, trade_date): gross_ret, turnover, cost, net_ret, leverage (net), gross_leverage, n_long, n_short.

    targets: strategy, trade_date, symbol, weight; a day of ``days`` without any is all cash.
    returns: symbol, trade_date, ret, eligible; a missing return is 0, and a held name
    that is not eligible goes to cash before trading, at no cost.
    """
    ordered = days.select("trade_date").distinct()
    # One row a day, whatever the number of symbols and strategies.
    chain = ordered.withColumn("next_date", F.lead("trade_date").over(Window.orderBy("trade_date")))
    facts = returns.select("symbol", "trade_date", F.coalesce(F.nanvl("ret", F.lit(0.0)), F.lit(0.0)).alias("ret"), "eligible")
    held = targets.join(facts, ["symbol", "trade_date"], "left").withColumn("ret", F.coalesce("ret", F.lit(0.0)))
    by_day = Window.partitionBy("strategy", "trade_date")
    gross = F.sum(F.col("weight") * F.col("ret")).over(by_day)
    # What the position is worth on the next day, as a part of the new equity.
    grown = F.when(1 + gross > 0, F.col("weight") * (1 + F.col("ret")) / (1 + gross)).otherwise(0.0)
    drift = held.withColumn("grown", grown).join(chain, "trade_date").filter("next_date is not null")
    drift = drift.select("strategy", F.col("next_date").alias("trade_date"), "symbol", F.col("grown").alias("before"))
    allowed = facts.select("symbol", "trade_date", "eligible")
    drift = drift.join(allowed, ["symbol", "trade_date"], "left").withColumn("before", F.when(F.coalesce("eligible", F.lit(False)), F.col("before")).otherwise(0.0))
    moves = held.select("strategy", "trade_date", "symbol", "weight", "ret", F.lit(0.0).alias("before")).unionByName(
        drift.select("strategy", "trade_date", "symbol", F.lit(0.0).alias("weight"), F.lit(0.0).alias("ret"), "before")
    )
    each = moves.groupBy("strategy", "trade_date", "symbol").agg(F.sum("weight").alias("w"), F.sum("before").alias("b"), F.max(F.abs("ret")).alias("_r"), F.sum(F.col("weight") * F.col("ret")).alias("gain"))
    by = each.groupBy("strategy", "trade_date").agg(
        F.sum("gain").alias("gross_ret"), F.sum(F.abs(F.col("w") - F.col("b"))).alias("moved"), F.sum("w").alias("net_w"), F.sum("b").alias("net_b"),
        F.sum(F.abs("w")).alias("gross_leverage"), F.count_if(F.col("w") > 0).alias("n_long"), F.count_if(F.col("w") < 0).alias("n_short"),
    )
    grid = targets.select("strategy").distinct().crossJoin(ordered)  # strategies x days: a handful of rows a day
    full = grid.join(by, ["strategy", "trade_date"], "left").fillna(0)
    turnover = 0.5 * (F.col("moved") + F.abs(F.col("net_b") - F.col("net_w")))
    out = full.withColumn("turnover", turnover).withColumn("cost", F.col("turnover") * (cost_bps / 1e4))
    return out.select("strategy", "trade_date", "gross_ret", "turnover", "cost", (F.col("gross_ret") - F.col("cost")).alias("net_ret"), F.col("net_w").alias("leverage"), "gross_leverage", "n_long", "n_short")


def with_equity(daily: DataFrame) -> DataFrame:
    """Adds equity (running product, safe for returns below -1), its running peak and drawdown."""
    path = Window.partitionBy("strategy").orderBy("trade_date")
    out = daily.withColumn("equity", F.product(1 + F.col("net_ret")).over(path)).withColumn("peak", F.max("equity").over(path))
    return out.withColumn("drawdown", F.try_divide("equity", "peak") - 1)


def performance(daily: DataFrame, periods: int = YEAR) -> DataFrame:
    """Per strategy: total_return, ann_return, ann_vol, sharpe, max_drawdown, n_days; always all fields."""
    path = with_equity(daily)
    stats = path.groupBy("strategy").agg(
        (F.product(1 + F.col("net_ret")) - 1).alias("total_return"), F.avg("net_ret").alias("mean"), (F.stddev_samp("net_ret") * periods**0.5).alias("ann_vol"),
        F.min("drawdown").alias("max_drawdown"), F.count("*").alias("n_days"),
    )
    growth = F.when(F.col("total_return") > -1, F.pow(1 + F.col("total_return"), F.lit(float(periods)) / F.col("n_days")) - 1).otherwise(-1.0)
    return stats.select("strategy", "total_return", growth.alias("ann_return"), "ann_vol", F.try_divide(F.col("mean") * periods, F.when(F.col("ann_vol") > 0, F.col("ann_vol"))).alias("sharpe"), "max_drawdown", "n_days")


def drifted_weights(starts: DataFrame, returns: DataFrame) -> DataFrame:
    """Weights on every day from sparse rebalances.

    starts: strategy, rebalance_date, symbol, weight.  returns: symbol, trade_date, ret.
    With G the growth of a name since the rebalance, the weight before day t is
    w G / (1 - sum w + sum w G), as long as the portfolio stays above zero.
    """
    # Each day's rebalance is known before names meet days: a row a strategy and day.
    marks = starts.select("strategy", F.col("rebalance_date").alias("trade_date")).distinct().withColumn("_mark", F.col("trade_date"))
    days = starts.select("strategy").distinct().crossJoin(returns.select("trade_date").distinct())
    calendar = days.join(marks, ["strategy", "trade_date"], "full")
    last = F.last("_mark", ignorenulls=True).over(Window.partitionBy("strategy").orderBy("trade_date"))
    calendar = calendar.select("strategy", "trade_date", last.alias("rebalance_date")).filter("rebalance_date is not null")
    rows = starts.join(calendar, ["strategy", "rebalance_date"]).join(returns.select("symbol", "trade_date", "ret"), ["symbol", "trade_date"])
    path = Window.partitionBy("strategy", "rebalance_date", "symbol").orderBy("trade_date")
    before = F.coalesce(F.product(1 + F.coalesce("ret", F.lit(0.0))).over(path.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0))
    day = Window.partitionBy("strategy", "rebalance_date", "trade_date")
    value = F.col("weight") * F.col("growth")
    wealth = 1 - F.sum("weight").over(day) + F.sum(value).over(day)
    out = rows.withColumn("growth", before).withColumn("wealth", wealth)
    # Once at or below zero, positions are closed until the next rebalance.
    alive = F.min("wealth").over(path.rowsBetween(Window.unboundedPreceding, Window.currentRow)) > 0
    return out.withColumn("w_exec", F.when(alive, value / F.col("wealth")).otherwise(0.0)).select("strategy", "trade_date", "symbol", "w_exec")


def _segments(rebalances: DataFrame, days: DataFrame) -> DataFrame:
    """trade_date, segment (the last rebalance day until then; null before the first), next_date, rebalance.  One row a day."""
    marks = rebalances.select("trade_date").distinct().withColumn("_mark", F.col("trade_date"))
    path = Window.orderBy("trade_date")
    days = days.select("trade_date").distinct().join(marks, "trade_date", "left")
    return days.select(
        "trade_date", F.last("_mark", ignorenulls=True).over(path).alias("segment"), F.lead("trade_date").over(path).alias("next_date"), F.col("_mark").isNotNull().alias("rebalance")
    )


def _grown(targets: DataFrame, returns: DataFrame, calendar: DataFrame) -> DataFrame:
    """strategy, segment, trade_date, next_date, symbol, weight, and weight times growth: start of the day, end of the day."""
    facts = returns.select("symbol", "trade_date", F.coalesce(F.nanvl("ret", F.lit(0.0)), F.lit(0.0)).alias("ret"))
    starts = targets.filter("weight <> 0").select("strategy", F.col("trade_date").alias("segment"), "symbol", "weight")
    rows = starts.join(calendar.filter("segment is not null"), "segment").join(facts, ["symbol", "trade_date"], "left")
    path = Window.partitionBy("strategy", "segment", "symbol").orderBy("trade_date")
    end = F.col("weight") * F.product(1 + F.coalesce("ret", F.lit(0.0))).over(path)
    return rows.withColumn("end", end).withColumn("start", F.coalesce(F.lag("end").over(path), F.col("weight")))


def _books(grown: DataFrame, targets: DataFrame, calendar: DataFrame) -> DataFrame:
    """Every (strategy, trade_date): segment, rebalance, target (sum of weights), start and end (sums of weight times growth)."""
    sums = grown.groupBy("strategy", "trade_date").agg(F.sum("weight").alias("target"), F.sum("start").alias("start"), F.sum("end").alias("end"))
    grid = targets.select("strategy").distinct().crossJoin(calendar)  # strategies x days: a row a strategy and day
    return grid.join(sums, ["strategy", "trade_date"], "left").fillna(0.0, ["target", "start", "end"])


def _trades(grown: DataFrame, targets: DataFrame, returns: DataFrame, calendar: DataFrame) -> DataFrame:
    """strategy, trade_date (of a rebalance), symbol, want, had (weight times growth of the segment before; 0 if not eligible)."""
    allowed = returns.select("symbol", "trade_date", "eligible")
    last = calendar.filter("rebalance").select(F.col("trade_date").alias("next_date"))
    had = grown.join(last, "next_date").select("strategy", F.col("next_date").alias("trade_date"), "symbol", "end")
    had = had.join(allowed, ["symbol", "trade_date"], "left").select("strategy", "trade_date", "symbol", F.lit(0.0).alias("want"), F.when(F.coalesce("eligible", F.lit(False)), F.col("end")).otherwise(0.0).alias("had"))
    want = targets.select("strategy", "trade_date", "symbol", F.col("weight").alias("want"), F.lit(0.0).alias("had")).join(calendar.filter("rebalance").select("trade_date"), "trade_date")
    return had.unionByName(want).groupBy("strategy", "trade_date", "symbol").agg(F.sum("want").alias("want"), F.sum("had").alias("had"))


def execute(targets: DataFrame, rebalances: DataFrame, returns: DataFrame, days: DataFrame, cost_bps: float = 3.0) -> DataFrame:
    """Per (strategy, trade_date): rebalance, gross_ret, turnover, cost, net_ret, leverage; trades on ``rebalances`` (trade_date) only.

    Other arguments as in ``execute_daily``; targets of other days do not count, a
    rebalance without targets goes to cash.  Between rebalances weights drift.  With
    G the growth of a name since the rebalance, a book is worth 1 - sum w + sum w G of
    what it was then; at or below zero it is closed until the next rebalance.
    """
    calendar = _segments(rebalances, days)
    grown = _grown(targets, returns, calendar)
    path = Window.partitionBy("strategy", "segment").orderBy("trade_date")
    worth = _books(grown, targets, calendar).withColumns({"before": 1 - F.col("target") + F.col("start"), "after": 1 - F.col("target") + F.col("end")})
    open_now = F.coalesce(F.min("after").over(path.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0)) > 0
    worth = worth.withColumn("open", open_now)
    ends = worth.filter("next_date is not null").select("strategy", F.col("next_date").alias("trade_date"), F.when(F.col("open") & (F.col("after") > 0), 1 / F.col("after")).otherwise(0.0).alias("part"))
    moves = _trades(grown, targets, returns, calendar).join(ends, ["strategy", "trade_date"], "left").withColumn("had", F.col("had") * F.coalesce("part", F.lit(0.0)))
    moved = moves.groupBy("strategy", "trade_date").agg(F.sum(F.abs(F.col("want") - F.col("had"))).alias("moved"), F.sum(F.col("want") - F.col("had")).alias("cash"))
    out = worth.join(moved, ["strategy", "trade_date"], "left").fillna(0.0, ["moved", "cash"])
    out = out.withColumns({
        "gross_ret": F.when(F.col("open"), (F.col("end") - F.col("start")) / F.col("before")).otherwise(0.0),
        "turnover": 0.5 * (F.col("moved") + F.abs("cash")), "leverage": F.when(F.col("open"), F.col("start") / F.col("before")).otherwise(0.0),
    }).withColumn("cost", F.col("turnover") * (cost_bps / 1e4))
    return out.select("strategy", "trade_date", "rebalance", "gross_ret", "turnover", "cost", (F.col("gross_ret") - F.col("cost")).alias("net_ret"), "leverage")


_TARGETED = "strategy string, trade_date date, rebalance boolean, gross_ret double, turnover double, cost double, net_ret double, leverage double, vol_est_ann double, vol_scale double"


def execute_to_volatility(
    targets: DataFrame, rebalances: DataFrame, returns: DataFrame, days: DataFrame, target: float, cost_bps: float = 3.0, months: int = 12, max_leverage: float = 1.0
) -> DataFrame:
    """As ``execute``, with each rebalance's weights scaled to an annual volatility; adds vol_est_ann (null if none), vol_scale.

    The scale comes from past net returns, at least 20, which depend on the scales
    before: a strategy's days are worked through in order, one at a time.  Growth of
    names and sums of books are windows beforehand; a rebalance day carries its names'
    weights as two lists, as long as the book.  Only books of a positive net weight are scaled.
    """
    calendar = _segments(rebalances, days)
    grown = _grown(targets, returns, calendar)
    trades = _trades(grown, targets, returns, calendar).groupBy("strategy", "trade_date").agg(F.collect_list(F.struct("want", "had")).alias("names"))
    books = _books(grown, targets, calendar).join(trades, ["strategy", "trade_date"], "left")
    rows = books.select("strategy", "trade_date", "rebalance", "target", "start", "end", F.col("names.want").alias("want"), F.col("names.had").alias("had"))
    window, rate = max(20, 21 * months), cost_bps / 1e4

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        strategy = None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.strategy != strategy or strategy is None:
                    strategy, past, k, net_target, part, is_open = r.strategy, deque(maxlen=window), 1.0, 0.0, 0.0, True
                turnover, vol, scale = 0.0, None, 1.0
                if r.rebalance:
                    want, had = (np.array(x if x is not None else [], float) for x in (r.want, r.had))
                    if want.sum() > 0 and len(past) >= 20:
                        vol = float(np.std(past, ddof=1) * YEAR**0.5)
                        scale = min(target / vol if vol > 0 else 1.0, max_leverage)
                    elif want.sum() > 0:
                        scale = min(1.0, max_leverage)
                    had = had * part
                    k, net_target, is_open = scale, scale * want.sum(), True
                    turnover = 0.5 * (np.abs(k * want - had).sum() + abs(k * want.sum() - had.sum()))
                before, after = 1 - net_target + k * r.start, 1 - net_target + k * r.end
                gross, leverage = (k * (r.end - r.start) / before, k * r.start / before) if is_open else (0.0, 0.0)
                is_open = is_open and after > 0
                part = k / after if is_open else 0.0
                net = gross - turnover * rate
                past.append(net)
                out.append((r.strategy, r.trade_date, r.rebalance, gross, turnover, turnover * rate, net, leverage, vol, scale))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _TARGETED.split(", ")])

    return rows.repartition("strategy").sortWithinPartitions("strategy", "trade_date").mapInPandas(run, _TARGETED)


def trailing_volatility(daily: DataFrame, months: int = 3) -> DataFrame:
    """Annual volatility of the net returns of the days before; null with fewer than 20."""
    before = Window.partitionBy("strategy").orderBy("trade_date").rowsBetween(-max(20, 21 * months), -1)
    vol = F.when(F.count("net_ret").over(before) >= 20, F.stddev_samp("net_ret").over(before) * YEAR**0.5)
    return daily.select("strategy", "trade_date", "net_ret", vol.alias("vol_est_ann"))


def against_baseline(daily: DataFrame, baseline: DataFrame) -> DataFrame:
    """Strategy equity with a baseline's (trade_date, equity), carried forward, without days before it, from 1."""
    path = Window.partitionBy("strategy").orderBy("trade_date")
    joined = with_equity(daily).join(baseline.select("trade_date", F.col("equity").alias("_b")), "trade_date", "left")
    carried = joined.withColumn("_b", F.last("_b", ignorenulls=True).over(path)).filter("_b is not null")
    return carried.select("strategy", "trade_date", "equity", (F.col("_b") / F.first("_b").over(path)).alias("baseline_equity"))
