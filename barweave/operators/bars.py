"""Bars: resampling, continuous contracts, quality, warehouse upkeep, as-of joins, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ops import ratio
from .folds import folded


def is_trading_day(day: Column, holidays: list[str] = ()) -> Column:
    """A weekday that is no holiday."""
    open_ = F.weekday(day) < 5
    return open_ & ~day.isin(*[F.lit(h).cast("date") for h in holidays]) if holidays else open_


def calendar(first: DataFrame, holidays: list[str] = ()) -> DataFrame:
    """``day, is_open, next_open, prev_open, n_open`` for every day between the first row's ``lo`` and ``hi``.

    next_open and prev_open are the nearest trading days after and before; n_open counts trading days so
    far. A calendar is a dimension: one row for a day.
    """
    days = first.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias("day")).select(F.col("day").cast("date").alias("day"))
    days = days.withColumn("is_open", is_trading_day(F.col("day"), holidays))
    open_day = F.when(F.col("is_open"), F.col("day"))
    w = W.orderBy("day")
    return days.select(
        "day", "is_open", F.min(open_day).over(w.rowsBetween(1, W.unboundedFollowing)).alias("next_open"), F.max(open_day).over(w.rowsBetween(W.unboundedPreceding, -1)).alias("prev_open"),
        F.sum(F.col("is_open").cast("int")).over(w).alias("n_open"),
    )


def session_name(minute: Column) -> Column:
    """The session of a minute of the day (local time): half-open day sessions, and the night session."""
    return (
        F.when((minute >= 21 * 60) | (minute < 150), "NIGHT").when((minute >= 9 * 60) & (minute < 690), "MORNING").when((minute >= 810) & (minute < 900), "AFTERNOON").otherwise("CLOSED")
    )


def trading_day(ts: Column) -> Column:
    """The day a bar belongs to (UTC): from noon on, the next weekday."""
    day = F.to_date(ts)
    late = F.hour(ts) >= 12
    step = F.when(F.weekday(day) >= 4, 7 - F.weekday(day)).otherwise(1)
    early = F.when(F.weekday(day) >= 5, 7 - F.weekday(day)).otherwise(0)
    return F.date_add(day, F.when(late, step).otherwise(early).cast("int"))


def resample_daily(bars: DataFrame) -> DataFrame:
    """Daily bars by trading day from bars with ``ts``; of equal times, ``seq`` tells which is first, where there is one."""
    rows = bars.withColumn("date", trading_day(F.col("ts")))
    at = F.struct("ts", "seq") if "seq" in bars.columns else F.col("ts")
    return rows.groupBy("symbol", "date").agg(
        F.min_by("open", at).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", at).alias("close"),
        F.sum("volume").alias("volume"), F.max_by("oi", at).alias("oi"), F.sum("amount").alias("amount"),
    )


class _Anchored:
    def __init__(self, symbol, seconds: int) -> None:
        self.symbol, self.least = symbol, seconds * 1_000_000
        self.bar = self.anchor = None

    def row(self, micros, open_, high, low, close, volume, amount):
        out = ()
        if self.bar is None or micros - self.anchor >= self.least:
            out = self.end()
            self.anchor, self.bar = micros, [open_, high, low, close, volume, amount]
        else:
            bar = self.bar
            self.bar = [bar[0], _most(max, bar[1], high), _most(min, bar[2], low), close, _sum(bar[4], volume), _sum(bar[5], amount)]
        return out

    def end(self):
        return () if self.bar is None else [(self.symbol, self.anchor, *self.bar)]


def _most(pick, a, b):
    return b if a is None else a if b is None else pick(a, b)


def _sum(a, b):
    return b if a is None else a if b is None else a + b


def resample_anchored(bars: DataFrame, seconds: int) -> DataFrame:
    """Bars of at least ``seconds``: a bar starts at the first row whose time is that far from the last start.

    The start of each bar depends on the one before, so a symbol's rows are folded in order of ``ts, seq``.
    """
    columns = ["open", "high", "low", "close", "volume", "amount"]
    rows = bars.select("symbol", "seq", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), *(F.col(c).cast("double").alias(c) for c in columns))
    schema = "symbol string, micros long, " + ", ".join(f"{c} double" for c in columns)
    made = folded(rows, "symbol", ["micros", "seq"], ["micros", *columns], lambda symbol: _Anchored(symbol, seconds), schema)
    return made.select("symbol", F.timestamp_micros("micros").alias("ts"), *columns)


def continuous(contracts: DataFrame) -> DataFrame:
    """``date, symbol, contract, close, adjusted``: the main contract of each date, back-adjusted at every roll.

    The main contract has the largest open interest (ties: the later name). At a roll the gap between the
    new and the old contract's close on that date is added to everything before it.
    """
    by_date = W.partitionBy("symbol", "date").orderBy(F.desc("oi"), F.desc("contract"))
    main = contracts.withColumn("place", F.row_number().over(by_date)).where("place = 1").select("symbol", "date", "contract", "close")
    w = W.partitionBy("symbol").orderBy("date")
    main = main.withColumn("old", F.lag("contract").over(w))
    before = contracts.select("symbol", "date", F.col("contract").alias("old"), F.col("close").alias("old_close"))
    main = main.join(before, ["symbol", "date", "old"], "left")
    gap = F.when((F.col("old") != F.col("contract")) & F.col("old_close").isNotNull(), F.col("close") - F.col("old_close")).otherwise(0.0)
    later = F.coalesce(F.sum(gap).over(w.rowsBetween(1, W.unboundedFollowing)), F.lit(0.0))
    return main.select("date", "symbol", "contract", "close", (F.col("close") + later).alias("adjusted"))


def quality(bars: DataFrame, expected_days: float = 1.0, reference: str | None = None) -> DataFrame:
    """``symbol, n, gaps, outliers, rollovers, stale, score``: over-long gaps, jumps of 20-50 % and over 50 %, staleness."""
    w = W.partitionBy("symbol").orderBy("date")
    rows = bars.select("symbol", "date", F.datediff("date", F.lag("date").over(w)).alias("gap"), F.abs(ratio(F.col("close"), F.lag("close").over(w)) - 1).alias("jump"))
    last = F.lit(reference).cast("date") if reference else None
    out = rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("gap") > 3 * expected_days).alias("gaps"), F.count_if((F.col("jump") >= 0.2) & (F.col("jump") <= 0.5)).alias("outliers"),
        F.count_if(F.col("jump") > 0.5).alias("rollovers"), F.max("date").alias("latest"),
    )
    stale = (F.datediff(last, "latest") > 7 * expected_days).cast("int") if last is not None else F.lit(0)
    out = out.withColumn("stale", stale)
    share = lambda c: F.col(c) * 100.0 / F.col("n")
    score = 100 - F.least(F.lit(35.0), share("gaps") * 3) - F.least(F.lit(35.0), share("outliers") * 5) - F.least(F.lit(15.0), F.col("rollovers") * 3.0) - F.col("stale") * 20
    return out.select("symbol", "n", "gaps", "outliers", "rollovers", "stale", F.greatest(F.lit(0.0), score).alias("score"))


def keep_last(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row for each key, the one with the largest ``seq``: one aggregation, no sort."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), seq).alias("last")).select(*keys, "last.*")


def upserted(old: DataFrame, new: DataFrame, keys: list[str], seq: str | None = None) -> DataFrame:
    """``old`` with ``new`` laid over it by key; of several new rows with one key, the one with the largest ``seq`` wins.

    Without ``seq`` it is the one whose other columns are the largest, so that the outcome does not hang on partitions.
    """
    both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    others = [c for c in old.columns if c not in keys and c != seq]
    at = F.struct("_age", *([seq] if seq else []), *others)
    return both.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in old.columns if c not in keys)), at).alias("last")).select(*keys, "last.*").select(*old.columns)


def warehouse_statistics(bars: DataFrame, group: str = "exchange") -> DataFrame:
    """Rows, symbols, first and last date by group, and in total (a NULL group)."""
    return bars.rollup(group).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("symbol").alias("symbols"), F.min("date").alias("first"), F.max("date").alias("last"))


def freshness(bars: DataFrame, reference: str) -> DataFrame:
    """``symbol, last, days, class``: how far each symbol is behind the reference date."""
    out = bars.groupBy("symbol").agg(F.max("date").alias("last")).withColumn("days", F.datediff(F.lit(reference).cast("date"), "last"))
    return out.withColumn("class", F.when(F.col("days") <= 1, "fresh").when(F.col("days") <= 7, "recent").when(F.col("days") <= 30, "stale").otherwise("old"))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str, strict: bool = False, forward: bool = False) -> DataFrame:
    """Each row of ``left`` with the value that ``right`` had last at or before (``strict``: before) its time.

    ``forward``: the first at or after. Both sides are put in one order by time and the last value is
    carried along it, so each key is sorted once and nothing is paired.
    """
    order = 0 if not strict else 2
    side = left.select(key, at, F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.struct(*left.columns).alias("_row"))
    marks = right.select(key, at, F.lit(order if not forward else 2 - order).alias("_side"), F.col(value).alias("_v"), F.lit(None).cast(side.schema["_row"].dataType).alias("_row"))
    w = W.partitionBy(key).orderBy(at, "_side")
    seen = F.first("_v", True).over(w.rowsBetween(0, W.unboundedFollowing)) if forward else F.last("_v", True).over(w.rowsBetween(W.unboundedPreceding, 0))
    return side.unionByName(marks).withColumn("_seen", seen).where(F.col("_row").isNotNull()).select("_row.*", F.col("_seen").alias(value))


def spread(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bars of the difference of two legs on their common dates; volume is the smaller one."""
    on = a.alias("a").join(b.alias("b"), F.col("a.date") == F.col("b.date"))
    prices = [(F.col(f"a.{c}") - F.col(f"b.{c}")).alias(c) for c in ("open", "high", "low", "close")]
    return on.select("a.date", *prices, F.least("a.volume", "b.volume").alias("volume"))


def reconciled(local: DataFrame, remote: DataFrame, key: str, value: str, tolerance: float = 1e-9) -> DataFrame:
    """``key, local, remote, state``: where two books of positions differ."""
    both = local.select(key, F.col(value).alias("local")).join(remote.select(key, F.col(value).alias("remote")), key, "full_outer")
    same = F.abs(F.col("local") - F.col("remote")) <= F.greatest(F.lit(tolerance), tolerance * F.abs("remote"))
    state = F.when(F.col("local").isNull(), "MISSING_LOCAL").when(F.col("remote").isNull(), "MISSING_REMOTE").when(same, "OK").otherwise("MISMATCH")
    return both.withColumn("state", state)


def limit_days(bars: DataFrame, limit: float = 0.1) -> DataFrame:
    """``date, symbol, state``: days that closed at their price limit, and the limit prices of the day."""
    w = W.partitionBy("symbol").orderBy("date")
    prev = F.lag("close").over(w)
    change = ratio(F.col("close"), prev) - 1
    state = F.when(change >= limit - 1e-6, "up").when(change <= -limit + 1e-6, "down").otherwise("none")
    return bars.select("date", "symbol", state.alias("state"), (prev * (1 + limit)).alias("upper"), (prev * (1 - limit)).alias("lower"))


def limit_prices(bars: DataFrame, limit: float = 0.1, places: int = 2) -> DataFrame:
    """``date, symbol, lower, upper``: the prices that a day's orders may not go beyond, rounded to the exchange's places."""
    prev = F.lag("close").over(W.partitionBy("symbol").orderBy("date"))
    near = lambda price: F.rint(price * 10.0**places) / 10.0**places
    return bars.select("date", "symbol", near(prev * (1 - limit)).alias("lower"), near(prev * (1 + limit)).alias("upper"))
