"""The order gate where a verdict hangs on the verdicts before it: limits count the orders that passed, and those only.

An account's orders are folded in time (see :mod:`barweave.operators.folds`). Its state is one position for each symbol, the day's
counts, and the times of orders that passed within the last while; an order costs a few microseconds. Where limits may count every
order, :func:`barweave.operators.desk.order_gate` does it in windows.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import folded

EPS = 1e-9


@dataclass(frozen=True)
class Limits:
    """None: no limit. ``allowed`` (empty: any) and ``denied`` name symbols or their leading letters. ``step``: volumes are its multiples.

    ``deviation``: share by which a price may differ from the reference. ``most_value``: of a position, at the reference (or
    else the order's price) times ``size``. ``most_margin``: share of equity that margins may take, with ``margin_rate`` for what an order adds.
    ``a_day``, ``volume_a_day``: orders and volume that pass on one day; ``a_while``: orders that pass within ``within`` seconds.
    """

    allowed: frozenset[str] = frozenset()
    denied: frozenset[str] = frozenset()
    allow_open: bool = True
    least_volume: float | None = None
    most_volume: float | None = None
    step: float | None = None
    deviation: float | None = None
    close_beyond: bool = False
    most_position: float | None = None
    most_value: float | None = None
    size: float = 1.0
    most_margin: float | None = None
    margin_rate: float = 0.1
    a_day: int | None = None
    volume_a_day: float | None = None
    a_while: int | None = None
    within: int = 60


def _names(symbol: str) -> set[str]:
    """A symbol, what stands before its exchange, and the letters of that."""
    plain = symbol.rsplit(".", 1)[0]
    return {symbol, plain, "".join(c for c in plain.upper() if c.isalpha())} - {""}


class _Gate:
    def __init__(self, account, limits: Limits) -> None:
        self.account, self.limits = account, limits
        self.held: dict[str, float] = {}
        self.passed: deque[int] = deque()
        self.day, self.n_day, self.volume_day = None, 0, 0.0

    def row(self, order_id, symbol, at, side, offset, volume, price, reference, held, equity, margin, halt, in_session, against):
        if None in (symbol, at, side, volume):
            return [(self.account, order_id, "INCOMPLETE", None)]
        day = at // 86_400_000_000
        if day != self.day:
            self.day, self.n_day, self.volume_day = day, 0, 0.0
        while self.passed and self.passed[0] <= at - self.limits.within * 1_000_000:
            self.passed.popleft()
        now = self.held.setdefault(symbol, held or 0.0)
        code = self._code(symbol, now, now + side * volume, side, offset, volume, price or 0.0, reference or 0.0, equity, margin or 0.0, halt, in_session, against)
        if code == "PASS":
            self.held[symbol] = now + side * volume
            self.passed.append(at)
            self.n_day += 1
            self.volume_day += volume
        return [(self.account, order_id, code, self.held[symbol])]

    def end(self):
        return ()

    def _code(self, symbol, now, after, side, offset, volume, price, reference, equity, margin, halt, in_session, against) -> str:
        """The first check that fails, in the order in which they are listed."""
        lim = self.limits
        closes, more = offset is not None and offset != "OPEN", abs(after) - abs(now)
        at = reference if reference > 0 else price
        above = lambda value, most: most is not None and value > most
        steps = volume / lim.step if lim.step else 0.0
        checks = (
            ("HALTED", halt == "HARD" or (halt == "SOFT" and not closes and more > EPS)),
            ("DENIED", bool(lim.denied and _names(symbol) & lim.denied)),
            ("NOT_ALLOWED", bool(lim.allowed and not _names(symbol) & lim.allowed)),
            ("CLOSED", in_session is False),
            ("OPEN_FORBIDDEN", not lim.allow_open and more > EPS),
            ("VOLUME", volume <= 0 or above(volume, lim.most_volume) or (lim.least_volume is not None and volume < lim.least_volume)),
            ("STEP", abs(steps - round(steps)) > 1e-6),
            ("PRICE", price < 0 or (price > 0 and reference > 0 and above(abs(price - reference) / reference, lim.deviation))),
            ("SELF_TRADE", bool(against)),
            ("CLOSE_VOLUME", closes and not lim.close_beyond and volume > abs(now) + EPS),
            ("POSITION", more > EPS and above(abs(after), None if lim.most_position is None else lim.most_position + EPS)),
            ("VALUE", more > EPS and at > 0 and above(abs(after) * at * lim.size, lim.most_value)),
            ("MARGIN", more > EPS and at > 0 and (equity or 0) > 0 and above((margin + more * at * lim.size * lim.margin_rate) / (equity or 1), lim.most_margin)),
            ("DAY_ORDERS", lim.a_day is not None and self.n_day >= lim.a_day),
            ("RATE", lim.a_while is not None and len(self.passed) >= lim.a_while),
            ("DAY_VOLUME", above(self.volume_day + volume, lim.volume_a_day)),
        )
        return next((code for code, fails in checks if fails), "PASS")


def gated(orders: DataFrame, limits: Limits) -> DataFrame:
    """``account, order_id, code, held``: the first check that each order fails, else PASS, and the symbol's position after it.

    ``orders`` has ``order_id, account, symbol, ts, side, volume``, and perhaps ``offset`` (OPEN, or what closes), ``price`` (0: at market),
    ``reference``, ``held`` (the position before the symbol's first order), ``equity``, ``margin`` (in use), ``halt`` (SOFT, HARD),
    ``in_session`` and ``against`` (a working order on the other side). Orders that pass count as filled. Times are read in UTC;
    orders of one time come by ``order_id``. Without a symbol, time, side or volume an order is INCOMPLETE and changes nothing.
    """
    kinds = {"offset": "string", "price": "double", "reference": "double", "held": "double", "equity": "double", "margin": "double", "halt": "string", "in_session": "boolean", "against": "boolean"}
    more = [(F.col(c) if c in orders.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()]
    at = F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    rows = orders.select(F.col("account").cast("string").alias("account"), F.col("order_id").cast("bigint").alias("order_id"), "symbol", at, F.col("side").cast("int").alias("side"), F.col("volume").cast("double").alias("volume"), *more)
    read = ["order_id", "symbol", "at", "side", "offset", "volume", "price", "reference", "held", "equity", "margin", "halt", "in_session", "against"]
    return folded(rows, "account", ["at", "order_id"], read, lambda account: _Gate(account, limits), "account string, order_id bigint, code string, held double")
