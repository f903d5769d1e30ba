"""Streams of ticks and orders: windowed and anchored bars, de-duplication, order states."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The states of an order; later ones outrank earlier ones.
STATES = ("SUBMITTING", "NOT_TRADED", "PART_TRADED", "ALL_TRADED", "CANCELLED", "REJECTED")


def window_bars(ticks: DataFrame, size: str = "1 minute", late: str = "2 minutes") -> DataFrame:
    """Bars of aligned windows; a window is final once the watermark (``late`` behind the newest tick) has passed it."""
    seq = F.struct("ts", "seq")
    return (
        ticks.withWatermark("ts", late)
        .groupBy(F.window("ts", size).alias("w"), "symbol")
        .agg(F.min_by("price", seq).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", seq).alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n"))
        .select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume", "n")
    )


def anchored_bars(ticks: DataFrame, seconds: int, late: str = "2 minutes") -> DataFrame:
    """Bars that start at the first tick ``seconds`` or more after the last start, from a state for each symbol.

    A bar is given out when its successor starts, or when the watermark says that nothing more can come for it;
    its state goes with it. Ticks that come late but before the watermark are taken in the order of their
    time within a batch; one that is older than what the open bar has seen adds to its range and volume, and the
    close stays that of the newest tick.
    """
    names = ["symbol", "start", "open", "high", "low", "close", "volume"]
    out = "symbol string, start long, open double, high double, low double, close double, volume double"
    state = "start long, open double, high double, low double, close double, volume double, newest long"

    def run(key: tuple, parts: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        bar = list(held.get) if held.exists else None
        if held.hasTimedOut:
            held.remove()
            yield pd.DataFrame([[key[0], *bar[:6]]], columns=names)
            return
        rows = pd.concat(list(parts)).sort_values(["micros", "seq"])
        done = []
        for at, price, volume in zip(rows["micros"].tolist(), rows["price"].tolist(), rows["volume"].tolist(), strict=True):
            if bar is None or at - bar[0] >= seconds * 1_000_000:
                if bar is not None:
                    done.append([key[0], *bar[:6]])
                bar = [at, price, price, price, price, volume, at]
            else:
                bar = [bar[0], bar[1], max(bar[2], price), min(bar[3], price), price if at >= bar[6] else bar[4], bar[5] + volume, max(at, bar[6])]
        held.update(tuple(bar))
        held.setTimeoutTimestamp(max(bar[0] // 1000 + seconds * 1000, held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(done, columns=names)

    slim = ticks.withWatermark("ts", late).select("symbol", "ts", F.unix_micros("ts").alias("micros"), "seq", "price", "volume")
    made = slim.groupBy("symbol").applyInPandasWithState(run, out, state, "append", "EventTimeTimeout")
    return made.withColumn("start", F.timestamp_micros("start"))


def distinct_trades(trades: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each trade id once, as long as repeats come within the watermark."""
    return trades.withWatermark("ts", late).dropDuplicatesWithinWatermark(["trade_id"])


def order_states(updates: DataFrame) -> DataFrame:
    """``order_id, status, traded``: the highest state so far; updates out of order never take one back."""
    rank = F.array_position(F.array(*map(F.lit, STATES)), F.col("status"))
    best = F.max(F.struct(rank.alias("r"), F.col("status"))).alias("best")
    return updates.groupBy("order_id").agg(best, F.max("traded").alias("traded")).select("order_id", F.col("best.status").alias("status"), "traded")


def run_available(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there now into a table in memory; for aggregates and tests."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
