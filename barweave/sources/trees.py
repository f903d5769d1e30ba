"""Bar files in the directory trees of markets: futures contracts by product, daily files of shares and options.

Only names are looked at on the driver; what a symbol needs is one read of the files that its name leads to.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bars import continuous
from .files import read_bars


@dataclass(frozen=True)
class Market:
    """Where a market's files lie below the root, which exchanges it has, and what its files' names end in after the code."""

    exchanges: frozenset[str]
    folders: tuple[str, ...]
    suffixes: tuple[tuple[str, str], ...] = ()


# Layouts of the markets' folders.
MARKETS = {
    "shares": Market(frozenset({"SSE", "SZSE"}), ("data", "daily", "stock", "stocks"), (("SSE", "SH"), ("SZSE", "SZ"))),
    "hk": Market(frozenset({"HKEX"}), ("hk", "HK", "data", "daily", "stock", "stocks")),
    "options": Market(frozenset("CFFEX SSE SZSE DCE CZCE SHFE INE".split()), ("option", "options", "data", "daily")),
}
ENDINGS = ("parquet", "csv", "txt")


def _found(spark: SparkSession, pattern: str) -> list[str]:
    """The files that a pattern leads to, in the order of their names."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(str(f.getPath().toString()) for f in found or ())


def product_of(symbol: str) -> tuple[str, str | None]:
    """Product and contract of a futures symbol: RB2405 is a contract; RB9999, RB0 and RB are the product's main one."""
    name = symbol.upper().strip()
    contract = re.fullmatch(r"([A-Z]+)(\d{4})", name)
    if name.endswith("9999"):
        return name[:-4], None
    if name.endswith("0") and len(name) <= 4:
        return name[:-1], None
    return (contract[1], name) if contract else (name, None)


def read_futures(spark: SparkSession, root: str, exchange: str, symbol: str, hours: float = 8.0, adjusted: bool = True, folder: str = "5min") -> DataFrame:
    """``ts, symbol, contract, open, high, low, close, volume, amount, oi`` of a contract, or of a product's main one.

    Files are ``root/5min/EXCHANGE/PRODUCT/PRODUCTyymm.csv``, in local time. The main contract of a time has the largest open interest;
    with ``adjusted`` earlier prices are moved by the gap at every roll. A tree without the product has no rows.
    """
    product, contract = product_of(symbol)
    where = f"{root.rstrip('/')}/{folder}/{exchange.upper()}/{product}"
    found = _found(spark, f"{where}/{contract or product + '[0-9][0-9][0-9][0-9]'}.csv")
    bars = _read_all(spark, found, hours)
    if contract or not found:
        return bars.withColumn("symbol", F.lit(symbol)).select("ts", "symbol", "contract", *_PRICES, "volume", "amount", "oi")
    main = continuous(bars.select(F.lit(symbol).alias("symbol"), F.col("ts").alias("date"), "contract", "close", "oi"))
    shift = (F.col("adjusted") - F.col("main_close")) if adjusted else F.lit(0.0)
    chosen = main.select(F.col("date").alias("ts"), "symbol", "contract", F.col("close").alias("main_close"), "adjusted")
    return bars.join(chosen, ["ts", "contract"]).select("ts", "symbol", "contract", *((F.col(c) + shift).alias(c) for c in _PRICES), "volume", "amount", "oi")


_PRICES = ("open", "high", "low", "close")


def _read_all(spark: SparkSession, files: list[str], hours: float) -> DataFrame:
    """Bars of files with one kind of ending, whose columns may stand in any order: read together where the headers agree."""
    out = None
    for path in files:
        df = read_bars(spark, path, hours)
        out = df if out is None else out.unionByName(df)
    return out if out is not None else spark.createDataFrame([], "ts timestamp, open double, high double, low double, close double, volume double, amount double, oi double, contract string")


def daily_file(spark: SparkSession, root: str, market: str, exchange: str, code: str) -> str | None:
    """The file of a code: in the root or the market's folders, named by code, suffix and code, or code and suffix; else the first below the root
    whose name holds the code. None for an exchange that the market does not have.
    """
    layout = MARKETS[market]
    if exchange not in layout.exchanges:
        return None
    suffix = dict(layout.suffixes).get(exchange, "")
    names = [code, f"{suffix}{code}", f"{code}.{suffix}", f"{suffix.lower()}{code}", f"{code}.{suffix.lower()}"] if suffix else [code]
    top = root.rstrip("/")
    for place in ("", *(f"/{f}" for f in layout.folders)):
        for name in names:
            for ending in ENDINGS:
                found = _found(spark, f"{top}{place}/{name}.{ending}")
                if found:
                    return found[0]
    for depth in range(1, 5):
        found = [f for f in _found(spark, f"{top}/{'*/' * (depth - 1)}*{code}*") if f.rsplit(".", 1)[-1].lower() in ENDINGS and suffix in f.rsplit("/", 1)[-1]]
        if found:
            return found[0]
    return None


def read_daily(spark: SparkSession, root: str, market: str, exchange: str, code: str, hours: float = 8.0) -> DataFrame | None:
    """Bars of a code's daily file; midnights are dates and stay as they are. None without a file."""
    found = daily_file(spark, root, market, exchange, code)
    return read_bars(spark, found, hours, intraday_only=True).withColumn("symbol", F.lit(code)) if found else None
