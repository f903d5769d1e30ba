"""Readers and writers of bar files, a deterministic mock source, and seat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Header names of bar files, by the column they become.
ALIASES = {
    "ts": ("datetime", "date", "time", "timestamp", "trade_date", "日期", "时间"),
    "open": ("open", "o", "开盘", "开盘价"),
    "high": ("high", "h", "最高", "最高价"),
    "low": ("low", "l", "最低", "最低价"),
    "close": ("close", "c", "收盘", "收盘价"),
    "volume": ("volume", "vol", "v", "成交量"),
    "amount": ("amount", "turnover", "money", "成交额"),
    "oi": ("open_interest", "oi", "hold", "position", "持仓量"),
}


def aliased(df: DataFrame) -> DataFrame:
    """Columns under their canonical names, whatever their case; missing ones NULL, others dropped."""
    have = {c.strip().lower(): c for c in df.columns}
    out = []
    for name, options in ALIASES.items():
        found = next((have[o] for o in options if o in have), None)
        kind = "string" if name == "ts" else "double"
        out.append((F.col(f"`{found}`") if found else F.lit(None)).cast(kind).alias(name))
    return df.select(*out, *(c for c in df.columns if c in ("symbol", "contract", "_file")))


def timestamp(text: Column, hours: float = 0.0, intraday_only: bool = False) -> Column:
    """Parsed time less an offset (files in local time); bad ones NULL. ``intraday_only`` leaves midnights alone."""
    ts = F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyyMMdd")), F.try_to_timestamp(text, F.lit("yyyy/M/d")))
    moved = ts - F.expr(f"INTERVAL {int(hours * 3600)} SECONDS")
    return F.when(F.date_trunc("day", ts) == ts, ts).otherwise(moved) if intraday_only else moved


def read_bars(spark: SparkSession, path: str, hours: float = 0.0, intraday_only: bool = False) -> DataFrame:
    """Bars of CSV, TXT or Parquet files below ``path``; ``contract`` is the ``XX0000`` part of the file's name."""
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ending == "parquet":
        df = spark.read.option("recursiveFileLookup", "true").parquet(path)
    elif ending in ("csv", "txt") or "." not in path.rstrip("/").rsplit("/", 1)[-1]:
        df = spark.read.option("header", "true").option("recursiveFileLookup", "true").csv(path)
    else:
        raise ValueError(f"neither CSV, TXT nor Parquet: {path}")
    df = df.select("*", F.col("_metadata.file_name").alias("_file"))
    out = aliased(df).withColumn("contract", F.regexp_extract(F.upper("_file"), r"([A-Z]+\d{4})", 1)).drop("_file")
    return out.withColumn("ts", timestamp(F.col("ts"), hours, intraday_only)).where("ts IS NOT NULL AND close IS NOT NULL")


def expiry(contract: Column) -> Column:
    """Last day of the month that a contract's last four digits name."""
    digits = F.regexp_extract(contract, r"(\d{2})(\d{2})$", 0)
    year = F.substring(digits, 1, 2).cast("int")
    return F.when(digits != "", F.last_day(F.make_date(F.when(year >= 70, 1900 + year).otherwise(2000 + year), F.substring(digits, 3, 2).cast("int"), F.lit(1))))


def clipped(bars: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Bars from ``start`` to ``end``, both included."""
    if start:
        bars = bars.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    return bars.where(F.col("ts") <= F.lit(end).cast("timestamp")) if end else bars


def first_source(*readers) -> DataFrame:
    """The first source that has rows; readers are called in turn."""
    for reader in readers:
        df = reader()
        if df is not None and not df.isEmpty():
            return df
    raise LookupError("no source has data")


def mock_bars(spark: SparkSession, symbols: list[str], start: str, days: int, base: float = 100.0) -> DataFrame:
    """A seeded random walk for each symbol: the same rows in any order of work."""
    grid = spark.createDataFrame([(s,) for s in symbols], "symbol string").select("symbol", F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("i"))
    noise = lambda salt: F.pmod(F.xxhash64("symbol", "i", F.lit(salt)), F.lit(1_000_000)) / 1_000_000.0
    w = W.partitionBy("symbol").orderBy("i")
    close = F.round(F.lit(base) + F.sum(noise("step") - 0.5).over(w), 4)
    out = grid.withColumn("close", close).withColumn("date", F.date_add(F.lit(start).cast("date"), F.col("i")))
    return out.select("date", "symbol", (F.col("close") - 0.5).alias("open"), (F.col("close") + 1).alias("high"), (F.col("close") - 1).alias("low"), "close", F.round(1000 + 9000 * noise("volume"), 0).alias("volume"), F.lit(None).cast("double").alias("amount"), F.round(5000 * noise("oi"), 0).alias("oi"))


def write_bars(bars: DataFrame, path: str) -> None:
    """Bars as Parquet by interval and exchange; the partitions that ``bars`` holds are replaced."""
    bars.sortWithinPartitions("symbol", "ts").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("interval", "exchange").parquet(path)


def universe(rows: DataFrame) -> DataFrame:
    """``symbol, exchange``: six-digit codes with the exchange that their prefix names, without the third board, once each."""
    code = F.lpad(F.col("code").cast("string"), 6, "0")
    exchange = F.when(code.rlike("^(60|68|9)"), "SSE").when(code.rlike("^(00|30|20)"), "SZSE").when(code.rlike("^(4|8)"), "BSE")
    out = rows.select(code.alias("symbol"), exchange.alias("exchange")).where("exchange IS NOT NULL AND exchange <> 'BSE'")
    return out.dropDuplicates(["symbol"])


def seat_positions(long_rows: DataFrame, short_rows: DataFrame) -> DataFrame:
    """``date, seat, long_pos, short_pos, net``: long and short rankings of members put together, missing sides 0."""
    long_ = long_rows.groupBy("date", F.col("member").alias("seat")).agg(F.sum("position").alias("long_pos"))
    short_ = short_rows.groupBy("date", F.col("member").alias("seat")).agg(F.sum("position").alias("short_pos"))
    out = long_.join(short_, ["date", "seat"], "full_outer").na.fill(0, ["long_pos", "short_pos"])
    return out.withColumn("net", F.col("long_pos") - F.col("short_pos"))


def seat_factors(seats: DataFrame, total_oi: DataFrame) -> DataFrame:
    """``date`` and the factors F1 ... F8 of net seat positions, each a mean over seats."""
    w = W.partitionBy("seat").orderBy("date")
    day, recent = W.partitionBy("date"), w.rowsBetween(-19, 0)
    net, nz = F.col("net").cast("double"), lambda x: F.when(x != 0, x)
    rows = seats.join(total_oi, "date", "left").withColumn("net", net).withColumn("change", net - F.lag(net).over(w))
    sd = F.when(F.count("net").over(recent) >= 5, F.stddev_samp("net").over(recent))
    rank = (F.rank().over(day.orderBy("net")) + (F.count(F.lit(1)).over(W.partitionBy("date", "net")) - 1) / 2) / F.count("net").over(day)
    each = rows.select(
        "date", "net", "change", (net / nz(F.coalesce(F.col("total_oi"), F.sum(F.abs("net")).over(day)))).alias("ratio"), (F.abs("net") / nz(F.sum(F.abs("net")).over(day))).alias("share"),
        (F.col("change") / nz(F.lag(net).over(w))).alias("rate"), (F.col("change") - F.lag("change").over(w)).alias("accel"), ((net - F.avg("net").over(recent)) / nz(sd)).alias("z"), rank.alias("rank"),
    )
    names = {"F1_net_position": "net", "F2_net_change": "change", "F3_net_ratio": "ratio", "F4_concentration": "share", "F5_net_change_rate": "rate", "F6_net_accel": "accel", "F7_net_zscore": "z", "F8_seat_sentiment": "rank"}
    return each.groupBy("date").agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(n) for n, c in names.items()))
