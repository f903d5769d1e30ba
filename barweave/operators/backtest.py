"""Backtests of accounts: several symbols on one cash balance, with lots, price limits, margin and costs.

An account's bars are folded in order (see :mod:`barweave.operators.folds`); accounts run beside each other.
Where targets do not depend on fills and every symbol has its own capital,
:func:`barweave.operators.accounts.replay_targets` does the same in windows.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .folds import folded


@dataclass(frozen=True)
class Rules:
    """What a market asks of orders, and what trading costs.

    ``lot``: buys are rounded down to whole lots (0: any volume). ``limit``: share by which a price may move in
    a day (0: freely); at the limit an order stays pending. ``same_day``: whether what was bought today may be
    sold today. ``rate, least, stamp, slip``: commission by value and at least, duty on sales, and slippage as
    a share of the open. ``margin``: share of the value that a position ties up; an order that needs more
    than is free is refused (0: none). ``warm_up``: dates at the start on which orders are refused. ``size``: what
    one unit of volume stands for (a contract's multiplier), in profits, costs and margins. ``per_lot``: commission for each unit of volume;
    ``today_rate``: commission by value on volume that was opened on the same date (None: as ``rate``); ``impact``: cost by value of
    moving the market. The limit is judged by the open against the last close, which is known when the order is filled;
    a bar's own close is not.
    """

    lot: float = 0.0
    limit: float = 0.0
    same_day: bool = True
    rate: float = 0.0
    least: float = 0.0
    stamp: float = 0.0
    slip: float = 0.0
    margin: float = 0.0
    warm_up: int = 0
    size: float = 1.0
    per_lot: float = 0.0
    today_rate: float | None = None
    impact: float = 0.0

    def cost(self, side: int, volume: float, price: float, closed_today: float) -> float:
        """Commission (at least the least), duty on sales, and impact."""
        value = price * self.size
        today = self.rate if self.today_rate is None else self.today_rate
        commission = value * (self.rate * (volume - closed_today) + today * closed_today) + self.per_lot * volume
        return max(commission, self.least) + value * volume * (self.impact + (self.stamp if side < 0 else 0.0))


@dataclass
class _Book:
    """One symbol's position, as running totals of what was opened and closed on its side since it was last flat.

    The unit of volume that was opened first is closed first. So a close takes the interval of opened volume that follows what
    is closed already, and the part of it beyond ``before`` (the total at the start of ``day``) was opened on that day.
    """

    side: int = 0
    opened: float = 0.0
    closed: float = 0.0
    worth: float = 0.0
    day: object = None
    before: float = 0.0

    @property
    def volume(self) -> float:
        return self.side * (self.opened - self.closed)

    @property
    def average(self) -> float:
        return self.worth / (self.opened - self.closed) if self.side else 0.0

    def fresh(self, day) -> float:
        """Of the open volume, what was opened on ``day``."""
        return self.opened - max(self.before, self.closed) if day == self.day else 0.0

    def close(self, volume: float, day) -> float:
        """Close some of the position at its average price; returns how much of it was opened on ``day``."""
        old = self.fresh(day)
        self.worth -= volume * self.average
        self.closed += volume
        if self.opened - self.closed < EPS:
            self.side, self.opened, self.closed, self.worth, self.day, self.before = 0, 0.0, 0.0, 0.0, None, 0.0
            return old
        return old - self.fresh(day)

    def open(self, side: int, volume: float, price: float, day) -> None:
        if day != self.day:
            self.day, self.before = day, self.opened
        self.side = side
        self.opened += volume
        self.worth += volume * price


TRADE = "struct<date:date,symbol:string,side:int,volume:double,price:double,cost:double,closed_today:double,forced:boolean>"
SCHEMA = f"account string, date date, cash double, margin double, equity double, refused int, pending int, trades array<{TRADE}>"
EPS = 1e-9


class _Account:
    """One account: rows come by date and symbol; a date is settled when the next one begins."""

    def __init__(self, key, rules: Rules, capital: float, by_symbol: Mapping[str, Rules]) -> None:
        self.key, self.general, self.by_symbol, self.cash = key, rules, by_symbol, capital
        self.held: dict[str, _Book] = {}
        self.close: dict[str, float] = {}
        self.pending: dict[str, list[list]] = {}
        self.date, self.n_dates, self.refused = None, 0, 0
        self.trades: list[dict] = []
        self.last: set[str] = set()

    def rules(self, symbol: str) -> Rules:
        return self.by_symbol.get(symbol, self.general)

    def row(self, date, symbol, open_, close, target, order, price):
        out = []
        if date != self.date:
            if self.date is not None:
                out.append(self._settled())
            self.date, self.n_dates, self.refused, self.trades = date, self.n_dates + 1, 0, []
            self.last = set()
        if open_ is None or close is None:
            return out  # the symbol does not trade: its orders wait, its position keeps its last close
        self._fill(symbol, open_)
        self.close[symbol] = close
        self.last.add(symbol)
        self._order(symbol, close, target, order, price)
        return out

    def end(self):
        """What is held is sold at the last close of the last date; orders that still wait are void."""
        if self.date is None:
            return []
        self.pending.clear()
        for symbol in sorted(self.last):
            p = self.held.get(symbol)
            if p and abs(p.volume) > EPS:
                self._trade(symbol, -p.volume, self.close[symbol], forced=True)
        return [self._settled()]

    def _settled(self):
        gains = sum((p.volume * self.close[s] - p.side * p.worth) * self.rules(s).size for s, p in self.held.items())
        waiting = sum(len(v) for v in self.pending.values())
        return (self.key, self.date, self.cash, self._margin(), self.cash + gains, self.refused, waiting, self.trades)

    def _margin(self) -> float:
        return sum(self.rules(s).margin * self.rules(s).size * p.worth for s, p in self.held.items())

    def _order(self, symbol: str, close: float, target: float | None, order: float | None, price: float | None) -> None:
        """Take the order of this close (a signed volume, or what leads to the target); it is filled at a later open.

        An order with a price is refused if the next date's limits, which are known from this close, rule the price out.
        """
        rules, p = self.rules(symbol), self.held.get(symbol) or _Book()
        if order is None:
            if target is None:
                return
            order = target - p.volume - sum(volume for volume, _ in self.pending.get(symbol, ()))
        if abs(order) < EPS:
            return
        if order > 0 and rules.lot:
            order = order // rules.lot * rules.lot
        beyond = price is not None and rules.limit and not close * (1 - rules.limit) - EPS <= price <= close * (1 + rules.limit) + EPS
        need = rules.margin * rules.size * abs(order) * (price or close) if p.volume * order >= 0 else 0.0
        short = rules.margin and need > 0 and need > self.cash - self._margin() + EPS
        if self.n_dates <= rules.warm_up or order == 0 or beyond or short:
            self.refused += 1
            return
        self.pending.setdefault(symbol, []).append((order, self.date))

    def _fill(self, symbol: str, open_: float) -> None:
        """Fill the symbol's waiting orders at this open; those that it does not let stay."""
        rules, prev, stays = self.rules(symbol), self.close.get(symbol), []
        moved = open_ / prev - 1 if prev and rules.limit else 0.0
        for volume, since in self.pending.pop(symbol, ()):
            side = 1 if volume > 0 else -1
            at_limit = bool(rules.limit) and side * moved >= rules.limit - 1e-6
            if since == self.date or at_limit or (side < 0 and not rules.same_day and -volume > self._sellable(symbol) + EPS):
                stays.append((volume, since))
            else:
                self._trade(symbol, volume, open_ * (1 + rules.slip * side))
        if stays:
            self.pending[symbol] = stays

    def _sellable(self, symbol: str) -> float:
        """What may be sold where the volume bought today may not."""
        p = self.held.get(symbol)
        return p.volume - p.fresh(self.date) if p and p.side > 0 else 0.0

    def _trade(self, symbol: str, change: float, price: float, forced: bool = False) -> None:
        rules, p = self.rules(symbol), self.held.setdefault(symbol, _Book())
        side, volume = (1, change) if change > 0 else (-1, -change)
        closes = min(volume, abs(p.volume)) if p.side == -side else 0.0
        closed_today = 0.0
        if closes:
            self.cash += (p.average - price) * side * closes * rules.size
            closed_today = p.close(closes, self.date)
        if volume - closes > EPS:
            p.open(side, volume - closes, price, self.date)
        cost = rules.cost(side, volume, price, closed_today)
        self.cash -= cost
        self.trades.append({"date": self.date, "symbol": symbol, "side": side, "volume": volume, "price": price, "cost": cost, "closed_today": closed_today, "forced": forced})


def accounts(bars: DataFrame, rules: Rules = Rules(), capital: float = 1_000_000.0, by_symbol: Mapping[str, Rules] | None = None) -> DataFrame:
    """``account, date, cash, margin, equity, refused, pending, trades``: one row for each account and date.

    ``bars`` has ``account, date, symbol, open, close`` and ``target`` (the position to hold) or ``volume`` (a
    signed order), decided at the close, and perhaps the order's ``price``. ``by_symbol`` has the rules of symbols that differ from
    ``rules`` (futures and shares in one account). An order is filled at the symbol's next open that lets it; cash moves
    by realised profit and costs, and equity adds what open positions have gained. On the last date positions
    are closed at their close. Bars without an open or close are days without trading. Orders of one symbol
    and date come in the order of their rows' volume, if a date has several.
    """
    has = lambda c: F.col(c).cast("double") if c in bars.columns else F.lit(None).cast("double")
    price = has("price").alias("price")
    columns = [F.col(c).cast("double").alias(c) for c in ("open", "close")] + [has(c).alias(c) for c in ("target", "volume")]
    rows = bars.select(F.col("account").cast("string").alias("account"), "date", "symbol", *columns, price)
    read = ["date", "symbol", "open", "close", "target", "volume", "price"]
    return folded(rows, "account", ["date", "symbol", "volume"], read, lambda key: _Account(key, rules, capital, by_symbol or {}), SCHEMA)


def trades(run: DataFrame) -> DataFrame:
    """``account, date, symbol, side, volume, price, cost, closed_today, forced``: the trades of a run of :func:`accounts`."""
    return run.select("account", F.explode("trades").alias("t")).select("account", "t.*")


def split_with_warm_up(bars: DataFrame, share: float, warm_up: int) -> tuple[DataFrame, DataFrame]:
    """The bars of the first ``share`` of dates, and those of the rest with ``warm_up`` dates before them, for indicators to settle.

    Dates are numbered over all symbols: one row a date, so the window has no partitions to speak of.
    """
    dates = bars.select("date").distinct()
    numbered = dates.select("date", F.row_number().over(W.orderBy("date")).alias("_i"), F.count(F.lit(1)).over(W.partitionBy()).alias("_n"))
    cut = F.floor(F.col("_n") * share).cast("int")
    marked = bars.join(numbered, "date")
    inside = marked.where(F.col("_i") <= cut).drop("_i", "_n")
    outside = marked.where(F.col("_i") > cut - warm_up).withColumn("warm", F.col("_i") <= cut).drop("_i", "_n")
    return inside, outside
