"""Bar panels in long form: one row for a symbol and a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PANEL = ("date", "symbol", "open", "high", "low", "close", "volume", "amount", "oi")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(rows: DataFrame, symbol: Column, date: Column, price: Column, seq: Column, volume: Column, amount: Column, oi: Column) -> DataFrame:
    """Bars of trades: first, highest, lowest and last price by ``seq``; sums of volume and amount; distinct ``oi``."""
    rows = rows.select(symbol.alias("symbol"), date.alias("date"), price.alias("price"), seq.alias("seq"), volume.alias("v"), amount.alias("a"), oi.alias("o"))
    return rows.groupBy("date", "symbol").agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"),
        F.sum("v").alias("volume"), F.sum("a").alias("amount"), F.count_distinct("o").cast("double").alias("oi"),
    )


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel E: events by type and day."""
    return fold(table(spark, sf_dir, "events"), F.col("event_type"), F.to_date("ts"), F.col("value"), F.col("event_id"), F.lit(1.0), F.col("value"), F.col("user_id"))


def shipment_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel L: shipments by the supplier's nation and week; only the weeks that a nation has."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    rows = lines.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    seq = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return fold(rows, F.col("s_nationkey").cast("string"), F.to_date(F.date_trunc("week", "l_shipdate")), F.col("l_extendedprice") / F.col("l_quantity"), seq, F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_suppkey"))


def complete(bars: DataFrame) -> DataFrame:
    """A row for every symbol on every date of the panel, with NULLs where there is no bar.

    Row windows count dates, so a panel across symbols needs its gaps. The dates of the panel are one
    small array, laid out for each symbol.
    """
    calendar = bars.agg(F.collect_set("date")).scalar()
    grid = bars.select("symbol").distinct().select("symbol", F.explode(calendar).alias("date"))
    return grid.join(bars, ["symbol", "date"], "left").select(*PANEL)
