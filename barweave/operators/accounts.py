"""Trades, positions, costs, risk checks and backtests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ops import with_factors
from .folds import folded


def net_positions(trades: DataFrame) -> DataFrame:
    """``symbol, net, traded, n``: signed volume, traded value and number of trades."""
    return trades.groupBy("symbol").agg(F.sum(F.col("side") * F.col("volume")).alias("net"), F.sum(F.col("volume") * F.col("price")).alias("traded"), F.count(F.lit(1)).alias("n"))


def costs(trades: DataFrame, rate: float, least: float, stamp: float, slippage: float) -> DataFrame:
    """Commission (with a minimum), sell-side stamp duty, slippage, and their sum, for each trade."""
    value = F.col("volume") * F.col("price")
    out = trades.withColumn("commission", F.greatest(value * rate, F.lit(least)))
    out = out.withColumn("stamp", F.when(F.col("side") < 0, value * stamp).otherwise(0.0)).withColumn("slippage", F.col("volume") * slippage)
    return out.withColumn("cost", F.col("commission") + F.col("stamp") + F.col("slippage"))


class _Average:
    def __init__(self, symbol) -> None:
        self.symbol = symbol
        self.net = self.average = self.realised = 0.0

    def row(self, side, volume, price):
        if None in (side, volume, price):
            return ()
        change, net = side * volume, self.net
        if net * change >= 0:
            self.average = (self.average * abs(net) + price * volume) / (abs(net) + volume) if net or volume else 0.0
        else:
            closed = min(abs(net), volume)
            self.realised += closed * (price - self.average) * (1 if net > 0 else -1)
            if volume > abs(net):
                self.average = price
            elif volume == abs(net):
                self.average = 0.0
        self.net += change
        return ()

    def end(self):
        return [(self.symbol, self.net, self.average, self.realised)]


def average_cost(trades: DataFrame) -> DataFrame:
    """``symbol, net, average, realised``: the average price of the open position and the profit taken so far.

    The average after a trade depends on the one before, so a symbol's trades are folded in order of ``seq``. Trades
    without a side, volume or price count for nothing.
    """
    return folded(trades, "symbol", ["seq"], ["side", "volume", "price"], _Average, "symbol string, net double, average double, realised double")


class _Pairs:
    def __init__(self, symbol) -> None:
        self.symbol = symbol
        self.stack: list[list[float]] = []
        self.pairs = self.wins = 0
        self.profit = 0.0

    def row(self, side, volume, price):
        if None in (side, volume, price):
            return ()
        stack = self.stack
        while volume > 1e-12 and stack and stack[-1][0] * side < 0:
            top = stack[-1]
            closed = min(top[1], volume)
            profit = closed * (price - top[2]) * top[0]
            self.pairs, self.wins, self.profit = self.pairs + 1, self.wins + (profit > 0), self.profit + profit
            top[1] -= closed
            volume -= closed
            if top[1] <= 1e-12:
                stack.pop()
        if volume > 1e-12:
            stack.append([side, volume, price])
        return ()

    def end(self):
        return [(self.symbol, self.pairs, self.wins, self.profit)]


def paired_profit(trades: DataFrame) -> DataFrame:
    """``symbol, pairs, wins, profit``: opposite trades paired last in, first out, residuals staying open; trades without a side, volume or price are none."""
    return folded(trades, "symbol", ["seq"], ["side", "volume", "price"], _Pairs, "symbol string, pairs long, wins long, profit double")


def exposures(trades: DataFrame) -> DataFrame:
    """Gross, net, long and short value, share of the largest, and concentration, in one row."""
    value = trades.groupBy("symbol").agg(F.sum(F.col("side") * F.col("volume") * F.col("price")).alias("value"))
    size = F.sum(F.abs("value"))
    out = value.agg(size.alias("gross"), F.sum("value").alias("net"), F.sum(F.greatest(F.col("value"), F.lit(0.0))).alias("long_value"), F.sum(F.least(F.col("value"), F.lit(0.0))).alias("short_value"), F.max(F.abs("value")).alias("largest"), F.sum(F.col("value") * F.col("value")).alias("squares"))
    gross = F.when(F.col("gross") > 0, F.col("gross"))
    return out.select("gross", "net", "long_value", "short_value", (F.col("largest") / gross).alias("concentration"), (F.col("squares") / (gross * gross)).alias("hhi"))


def order_checks(orders: DataFrame, denied: DataFrame, most_notional: float, most_orders: int) -> DataFrame:
    """``verdict``: the first check that an order fails, in this order: deny list, notional, session, rate; else PASS."""
    marked = orders.join(denied.select("symbol").distinct().withColumn("denied", F.lit(True)), "symbol", "left")
    nth = F.count(F.lit(1)).over(W.partitionBy("symbol").orderBy("ts", "order_id").rowsBetween(W.unboundedPreceding, 0))
    verdict = F.when(F.coalesce("denied", F.lit(False)), "SYMBOL_DENIED").when(F.col("notional") > most_notional, "NOTIONAL_LIMIT").when(~F.col("in_session"), "CLOSED").when(nth > most_orders, "RATE_LIMIT").otherwise("PASS")
    return marked.withColumn("verdict", verdict).drop("denied")


ACTIVE = ("SUBMITTING", "NOT_TRADED", "PART_TRADED")


def frozen_volume(orders: DataFrame) -> DataFrame:
    """``symbol, frozen``: signed volume that active orders may still trade."""
    left = F.when(F.col("status").isin(*ACTIVE), F.col("side") * (F.col("volume") - F.coalesce("traded", F.lit(0.0)))).otherwise(0.0)
    return orders.groupBy("symbol").agg(F.sum(left).alias("frozen"))


def overdue(orders: DataFrame, now: str, seconds: int = 300) -> DataFrame:
    """Active orders that are at least ``seconds`` old at ``now``, with their ``age``; these are to be cancelled."""
    age = F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp"))
    return orders.where(F.col("status").isin(*ACTIVE)).withColumn("age", age).where(F.col("age") >= seconds)


def dual_average(panel: DataFrame, fast: int, slow: int) -> DataFrame:
    """``panel`` with ``target``: 1 while the fast mean is above the slow one, else -1; 0 in the first slow + 5 bars."""
    formulas = {"target": f"where(gated_mean(close,{fast},{fast})>gated_mean(close,{slow},{slow}),1,-1)", "ready": f"gated_mean(close,{slow + 5},{slow + 5})"}
    made = with_factors(panel, formulas, "single", fill=False)
    made = made.select("date", "symbol", F.when(F.col("ready").isNotNull(), F.col("target")).otherwise(0.0).alias("target"))
    return panel.join(made, ["date", "symbol"])


def replay_targets(panel: DataFrame, capital: float, cost: float) -> DataFrame:
    """``date, symbol, position, pnl, equity``: the target of a bar is filled at the next open.

    This is the whole backtest where targets do not depend on fills: positions are lagged targets and cash
    is a running sum, so windows do it.
    """
    w = W.partitionBy("symbol").orderBy("date")
    rows = panel.withColumn("position", F.coalesce(F.lag("target").over(w), F.lit(0.0))).withColumn("prev", F.lag("close").over(w))
    rows = rows.withColumn("held", F.coalesce(F.lag("position").over(w), F.lit(0.0)))
    pnl = F.coalesce(F.col("held") * (F.col("open") - F.col("prev")), F.lit(0.0)) + F.col("position") * (F.col("close") - F.col("open")) - F.abs(F.col("position") - F.col("held")) * F.col("open") * cost
    rows = rows.withColumn("pnl", pnl)
    return rows.select("date", "symbol", "position", "pnl", (F.lit(capital) + F.sum("pnl").over(w)).alias("equity"))


class _Replay:
    def __init__(self, symbol, capital: float, cost: float, limit: float) -> None:
        self.symbol, self.capital, self.cost, self.limit = symbol, capital, cost, limit
        self.position = self.cash = 0.0
        self.prev = self.pending = None

    def row(self, date, open_, close, target):
        if open_ is None or close is None:  # no trading: the order waits, the position keeps its last close
            return [(date, self.symbol, self.position, self.capital + self.cash + self.position * (self.prev or 0.0))]
        if self.pending is not None and self.pending != self.position:
            change, prev = self.pending - self.position, self.prev
            blocked = prev is not None and ((change > 0 and open_ >= prev * (1 + self.limit) - 1e-9) or (change < 0 and open_ <= prev * (1 - self.limit) + 1e-9))
            if not blocked:
                self.cash -= change * open_ + abs(change) * open_ * self.cost
                self.position = self.pending
        self.pending, self.prev = target, close
        return [(date, self.symbol, self.position, self.capital + self.cash + self.position * close)]

    def end(self):
        return ()


def replay_fold(panel: DataFrame, capital: float, cost: float, limit: float = 0.1) -> DataFrame:
    """As :func:`replay_targets`, but an order stays pending while the open is at its price limit, or missing, so bars are folded in order."""
    schema = "date date, symbol string, position double, equity double"
    return folded(panel, "symbol", ["date"], ["date", "open", "close", "target"], lambda symbol: _Replay(symbol, capital, cost, limit), schema)
