"""Trading times by product: day sessions, night sessions, calendars with holidays, staleness in trading days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bars import is_trading_day

# Products by the end of their night session, products of the stock-index exchange, and exchanges without nights.
NIGHT_2300 = "RB HC SS BU FU SP RU NR BR I J JM PP L V EG EB PG M Y P A B C CS RR TA MA SR CF CY OI RM FG SA UR ZC SF SM PX SH PF PR".split()
NIGHT_0100 = "CU AL ZN PB NI SN AO BC AD".split()
NIGHT_0230 = "AU AG SC".split()
NO_NIGHT = "CFFEX SSE SZSE HKEX".split()
BONDS = "T TF TS TL".split()
#: Day sessions in minutes of the day, half-open.
COMMODITY = ((540, 615), (630, 690), (810, 900))
INDEX = ((570, 690), (780, 900))
BOND = ((570, 690), (780, 915))
STOCK = ((570, 690), (780, 900))
HONG_KONG = ((570, 720), (780, 960))
NIGHT_OPEN = 21 * 60


def product(symbol: Column) -> Column:
    """The letters that a symbol begins with, in upper case; '' without any."""
    return F.upper(F.regexp_extract(F.trim(symbol), "^([A-Za-z]*)", 1))


def night_close(symbol: Column, exchange: Column) -> Column:
    """Minute of the day at which the product's night session ends (before 21:00: on the next day); NULL without one."""
    letters = product(symbol)
    minute = F.when(letters.isin(*NIGHT_0230), 150).when(letters.isin(*NIGHT_0100), 60).when(letters.isin(*NIGHT_2300), 23 * 60)
    return F.when(~F.upper(exchange).isin(*NO_NIGHT), minute)


def in_day_session(minute: Column, symbol: Column, exchange: Column) -> Column:
    """Whether a minute of the day is in the product's day sessions."""
    inside = lambda times: F.array_contains(F.array(*((minute >= a) & (minute < b) for a, b in times)), True)
    place = F.upper(exchange)
    future = F.when(product(symbol).isin(*BONDS), inside(BOND)).otherwise(inside(INDEX))
    return F.when(place == "CFFEX", future).when(place.isin("SSE", "SZSE"), inside(STOCK)).when(place == "HKEX", inside(HONG_KONG)).otherwise(inside(COMMODITY))


def night_days(calendar: DataFrame) -> DataFrame:
    """``calendar`` (``day, is_open, next_open``) with ``has_night``: an open day whose next one is at most three days away."""
    return calendar.withColumn("has_night", F.col("is_open") & F.coalesce(F.datediff("next_open", "day") <= 3, F.lit(False)))


def session(ts: Column, symbol: Column, exchange: Column, is_open: Column, has_night: Column, night_before: Column) -> Column:
    """CLOSED, NIGHT, MORNING or AFTERNOON at a local time; the last three say whether its day trades, whether its evening and the one before do."""
    minute = F.hour(ts) * 60 + F.minute(ts)
    end = night_close(symbol, exchange)
    crosses = end <= NIGHT_OPEN
    evening = (minute >= NIGHT_OPEN) & (crosses | (minute < end)) & has_night
    early = crosses & (minute < end) & night_before
    night = F.coalesce(evening | early, F.lit(False))
    day = is_open & in_day_session(minute, symbol, exchange)
    return F.when(night, "NIGHT").when(day & (minute < 720), "MORNING").when(day, "AFTERNOON").otherwise("CLOSED")


def with_session(rows: DataFrame, calendar: DataFrame) -> DataFrame:
    """``rows`` (``ts, symbol, exchange``) with ``session``; days that the calendar lacks are closed.

    The calendar has a row a day, so it is a dimension of a few thousand rows.
    """
    days = night_days(calendar).withColumn("night_before", F.lag("has_night").over(W.orderBy("day")))
    out = rows.withColumn("_day", F.to_date("ts")).join(F.broadcast(days.select(F.col("day").alias("_day"), "is_open", "has_night", "night_before")), "_day", "left")
    flags = [F.coalesce(c, F.lit(False)) for c in ("is_open", "has_night", "night_before")]
    return out.withColumn("session", session(F.col("ts"), F.col("symbol"), F.col("exchange"), *flags)).select(*rows.columns, "session")


def local_time(ts: Column) -> Column:
    """UTC to the exchanges' time."""
    return F.from_utc_timestamp(ts, "Asia/Shanghai")


def trading_days_behind(latest: DataFrame, calendar: DataFrame, reference: str) -> DataFrame:
    """``latest`` (with ``last``) and ``behind``: the trading days after ``last`` up to the reference day, at least 0.

    ``calendar`` counts its open days in ``n_open``; a ``last`` that it lacks has no answer.
    """
    now = calendar.where(F.col("day") == F.lit(reference).cast("date")).select(F.col("n_open").alias("_now"))
    then = calendar.select(F.col("day").alias("last"), F.col("n_open").alias("_then"))
    out = latest.join(then, "last", "left").join(F.broadcast(now), how="left")  # one row
    return out.select(*latest.columns, F.greatest(F.col("_now") - F.col("_then"), F.lit(0)).cast("int").alias("behind"))


def holidays(lines: DataFrame) -> DataFrame:
    """``day``: the dates in lines of text (``value``), without what follows a ``#`` and without words that are no dates."""
    words = F.split(F.trim(F.regexp_replace("value", "#.*$", "")), r"\s+")
    day = F.when(F.col("word").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp("word", F.lit("yyyy-MM-dd")).cast("date"))
    return lines.select(F.explode(words).alias("word")).select(day.alias("day")).where("day IS NOT NULL").distinct()


def read_holidays(spark: SparkSession, path: str) -> DataFrame:
    return holidays(spark.read.text(path))


def open_days(days: DataFrame, closed: DataFrame) -> DataFrame:
    """``day, is_open`` for ``days``, with the holidays of a table."""
    marked = days.join(closed.select("day").distinct().withColumn("_closed", F.lit(True)), "day", "left")
    return marked.select("day", (is_trading_day(F.col("day")) & F.col("_closed").isNull()).alias("is_open"))


def periods_per_year(bars: DataFrame) -> DataFrame:
    """``symbol, periods``: 365 over the days between its first two bars, rounded, at least 1; 252 with fewer bars."""
    w = W.partitionBy("symbol").orderBy("date")
    first = bars.select("symbol", "date", F.row_number().over(w).alias("i")).where("i <= 2").groupBy("symbol").agg(F.min("date").alias("a"), F.max("date").alias("b"), F.count(F.lit(1)).alias("n"))
    days = F.greatest(F.lit(1), F.abs(F.datediff("b", "a")))
    return first.select("symbol", F.when(F.col("n") < 2, 252).otherwise(F.greatest(F.lit(1), F.bround(365.0 / days).cast("int"))).alias("periods"))
