"""What a strategy sees of other timeframes: indicators of the bars that are complete at its time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bars import as_of

PRICES = ("open", "high", "low", "close")


def indicators(bars: DataFrame, at: str, n: int, atr: int = 14, whole: bool = True) -> DataFrame:
    """``symbol, at`` and ``view``: the last bar's prices, and mean close, highest, lowest and average true range over the last bars.

    A mean needs ``n`` bars and a true range ``atr + 1``; so do highest and lowest, unless ``whole`` is off.
    """
    w = W.partitionBy("symbol").orderBy(at)
    recent, seen = w.rowsBetween(-(n - 1), 0), F.row_number().over(w)
    prev = F.lag("close").over(w)
    rows = bars.select("symbol", at, *PRICES, seen.alias("_n"), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)).alias("_range"))
    full = F.col("_n") >= n
    made = [
        F.when(full, F.avg("close").over(recent)).alias("sma"), F.when(full | F.lit(not whole), F.max("high").over(recent)).alias("highest"), F.when(full | F.lit(not whole), F.min("low").over(recent)).alias("lowest"),
        F.when(F.col("_n") > atr, F.avg("_range").over(w.rowsBetween(-(atr - 1), 0))).alias("atr"),
    ]
    flat = rows.select("symbol", F.col(at).alias("at"), *(F.col(c).alias(f"prev_{c}") for c in PRICES), *made)
    names = [c for c in flat.columns if c not in ("symbol", "at")]
    return flat.select("symbol", "at", F.struct(*names).alias("view"))


def multi_timeframe(rows: DataFrame, bars: DataFrame, n: int, atr: int = 14) -> DataFrame:
    """``rows`` (``symbol, ts``) with the view of ``bars`` (``close_time``) that were complete at or before its time."""
    view = indicators(bars, "close_time", n, atr).withColumnRenamed("at", "ts")
    return as_of(rows, view, "symbol", "ts", "view").select(*rows.columns, "view.*")


def daily_context(rows: DataFrame, daily: DataFrame, n: int, atr: int = 14) -> DataFrame:
    """``rows`` (``symbol, date``) with the view of the daily bars before its date."""
    view = indicators(daily, "date", n, atr, whole=False).withColumnRenamed("at", "date")
    return as_of(rows, view, "symbol", "date", "view", strict=True).select(*rows.columns, "view.*")
