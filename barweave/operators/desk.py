"""The trading desk's operators: cost models, roll costs, offsets, halts, the order gate, universes and sizing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ops import ratio, with_factors

#: What a cost model says: commission by value and by lot, their multiples for closing today's and yesterday's
#: positions, the least commission, stamp duty on sales, market impact, margin, and slippage, each by value.
MODEL = ("rate", "per_lot", "today", "yesterday", "least", "stamp", "impact", "margin", "slip")


def cost_models(rows: DataFrame, models: DataFrame, exchanges: DataFrame, common: dict[str, float]) -> DataFrame:
    """``rows`` (``symbol, exchange``) with ``model``: that of the symbol, else of its leading letters, else of its exchange, else ``common``.

    Symbols of digits only have no letters to go by. The two tables are dimensions; whether they are
    broadcast is for the planner, which knows their sizes.
    """
    letters = F.upper(F.regexp_extract("symbol", "^([A-Za-z]+)", 1))
    root = F.when(~F.col("symbol").rlike("^[0-9]+$"), F.when(letters != "", letters))
    packed = models.select("key", F.struct(*MODEL).alias("m"))
    out = rows.withColumn("_root", root)
    out = out.join(packed.select(F.col("key").alias("symbol"), F.col("m").alias("_own")), "symbol", "left")
    out = out.join(packed.select(F.col("key").alias("_root"), F.col("m").alias("_family")), "_root", "left")
    out = out.join(exchanges.select("exchange", F.struct(*MODEL).alias("_place")), "exchange", "left")
    usual = F.struct(*(F.lit(float(common.get(f, 0.0))).alias(f) for f in MODEL))
    return out.withColumn("model", F.coalesce("_own", "_family", "_place", usual)).drop("_root", "_own", "_family", "_place")


def trade_costs(rows: DataFrame) -> DataFrame:
    """Commission, stamp duty, impact and margin of trades (``volume, price, size, side, offset, closed_today, model``).

    The part of a trade that closes positions of the same day has its own rate; the least commission holds
    for the whole trade.
    """
    m, volume = F.col("model"), F.col("volume")
    today = F.greatest(F.lit(0.0), F.least(F.col("closed_today"), volume))
    other = F.when(F.col("offset") == "CLOSE_YESTERDAY", m["yesterday"]).otherwise(1.0)
    value = F.col("price") * F.col("size")
    fee = (value * m["rate"] + m["per_lot"]) * (today * m["today"] + (volume - today) * other)
    return rows.select(
        "*", F.greatest(fee, m["least"]).alias("commission"), F.when(F.col("side") < 0, value * volume * m["stamp"]).otherwise(0.0).alias("stamp"),
        (value * volume * m["impact"]).alias("impact"), (value * F.abs(volume) * m["margin"]).alias("margin"),
    )


def roll_costs(rows: DataFrame, notional: float, rolls: int = 4) -> DataFrame:
    """``bps, drag_bps, drag``: one unit opened and closed again at price one, a year of such rolls, and that in money."""
    m = F.col("model")
    once = m["rate"] + m["per_lot"]
    bps = (F.greatest(once, m["least"]) + F.greatest(once * m["yesterday"], m["least"]) + 2 * m["slip"]) * 1e4
    return rows.withColumn("bps", bps).withColumn("drag_bps", F.col("bps") * rolls).withColumn("drag", F.col("drag_bps") / 1e4 * notional)


def closing_offset(offset: Column, volume: Column, held: Column, yesterday: Column, distinguishes: Column) -> Column:
    """The offset to send: exchanges that tell today's from yesterday's positions get one of the two, others plain CLOSE."""
    fits = held.isNull() | (held - yesterday >= volume)
    return F.when(offset == "OPEN", offset).when(~distinguishes, "CLOSE").when(fits, "CLOSE_TODAY").otherwise("CLOSE_YESTERDAY")


def equity_halts(equity: DataFrame, key: str, loss: float, drawdown: float) -> DataFrame:
    """``day_return, drawdown, code, halted`` of equity by date: the limit that a date breaks, and whether one was broken so far."""
    w = W.partitionBy(key).orderBy("date")
    rows = equity.withColumn("day_return", ratio(F.col("equity"), F.lag("equity").over(w)) - 1)
    rows = rows.withColumn("drawdown", ratio(F.col("equity"), F.max("equity").over(w)) - 1)
    code = F.when(F.col("day_return") <= -loss, "DAILY_LOSS_LIMIT").when(F.col("drawdown") <= -drawdown, "DRAWDOWN_LIMIT")
    rows = rows.withColumn("code", code)
    return rows.withColumn("halted", F.count("code").over(w.rowsBetween(W.unboundedPreceding, 0)) > 0)


@dataclass(frozen=True)
class Limits:
    most_volume: float
    least_volume: float
    step: float
    deviation: float
    most_position: float
    margin_rate: float
    most_margin: float
    a_day: int
    a_minute: int


def order_gate(orders: DataFrame, denied: DataFrame, active: DataFrame, limits: Limits) -> DataFrame:
    """``code``: the first check that an order fails, else PASS.

    ``orders``: ``order_id, account, symbol, ts, side, offset, volume, price, reference, held, equity, halt,
    in_session``; ``active``: ``account, symbol, side`` of working orders. The checks in order: halt, deny
    list, session, volume, price, self-trade, close volume, position, margin, rate. Positions and rates
    count the account's orders before this one, whether they passed or not, so all of it is windows.
    """
    opens = F.col("offset") == "OPEN"
    book = W.partitionBy("account", "symbol").orderBy("ts", "order_id").rowsBetween(W.unboundedPreceding, 0)
    day = W.partitionBy("account", F.to_date("ts")).orderBy("ts", "order_id").rowsBetween(W.unboundedPreceding, 0)
    minute = W.partitionBy("account").orderBy(F.unix_seconds(F.col("ts").cast("timestamp"))).rangeBetween(-60, 0)
    rows = orders.withColumn("_after", F.sum(F.col("side") * F.col("volume")).over(book)).withColumn("_day", F.count(F.lit(1)).over(day)).withColumn("_minute", F.count(F.lit(1)).over(minute))
    rows = rows.join(denied.select("symbol").distinct().withColumn("_denied", F.lit(True)), "symbol", "left")
    against = active.select("account", "symbol", (-F.col("side")).alias("side")).distinct().withColumn("_self", F.lit(True))
    rows = rows.join(against, ["account", "symbol", "side"], "left")
    volume, steps = F.col("volume"), F.col("volume") / limits.step
    checks = (
        ("HALTED", (F.col("halt") == "HARD") | ((F.col("halt") == "SOFT") & opens)),
        ("SYMBOL_DENIED", F.col("_denied")),
        ("CLOSED", ~F.col("in_session")),
        ("VOLUME", (volume <= 0) | (volume > limits.most_volume) | (volume < limits.least_volume) | (F.abs(steps - F.floor(steps + 0.5)) > 1e-9)),
        ("PRICE", (F.col("price") < 0) | ((F.col("price") != 0) & (F.abs(ratio(F.col("price"), F.col("reference")) - 1) > limits.deviation))),
        ("SELF_TRADE", F.col("_self")),
        ("CLOSE_VOLUME", ~opens & (volume > F.col("held"))),
        ("POSITION", opens & (F.abs("_after") > limits.most_position)),
        ("MARGIN", opens & (F.abs("_after") * F.col("price") * limits.margin_rate > limits.most_margin * F.col("equity"))),
        ("RATE", (F.col("_day") > limits.a_day) | (F.col("_minute") > limits.a_minute)),
    )
    code = F.lit("PASS")
    for name, broken in reversed(checks):
        code = F.when(F.coalesce(broken, F.lit(False)), name).otherwise(code)
    return rows.withColumn("code", code).select(*orders.columns, "code")


def liquid(panel: DataFrame, least_bars: int, last: int, least_volume: float) -> DataFrame:
    """``symbol, n, volume``: symbols with enough bars, and enough mean volume over the last ones."""
    back = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("date")))
    rows = panel.where("close IS NOT NULL").withColumn("back", back)
    out = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("back") <= last, F.col("volume"))).alias("volume"))
    return out.where((F.col("n") >= least_bars) & (F.col("volume") >= least_volume))


def best(scores: DataFrame, k: int) -> DataFrame:
    """The ``k`` highest values of each date (ties by symbol), with equal weights that sum to one."""
    place = F.row_number().over(W.partitionBy("date").orderBy(F.desc_nulls_last("value"), "symbol"))
    rows = scores.where("value IS NOT NULL").withColumn("place", place).where(F.col("place") <= k)
    return rows.withColumn("weight", 1.0 / F.count(F.lit(1)).over(W.partitionBy("date")))


def volatility_target(panel: DataFrame, target: float = 0.2, window: int = 20, trend: int = 60, most: float = 1.0) -> DataFrame:
    """``date, symbol, position``: target over realised annual volatility, in the direction of the trend, within ``most``."""
    made = with_factors(panel, {"sd": f"gated_std(ret,{window},5)", "trend": f"momentum(close,{trend})"}, "single", fill=False)
    direction = F.signum("trend")
    size = F.when(F.col("sd") > 0, F.least(F.lit(most), target / (F.col("sd") * 252**0.5))).when(F.col("sd") == 0, most)
    return made.select("date", "symbol", F.coalesce(direction * size, F.lit(0.0)).alias("position"))
