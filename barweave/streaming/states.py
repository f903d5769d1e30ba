"""States of streams that outlive a batch: orders with deadlines, and the last bars of each symbol.

Both run as stateful processors whose state lives in RocksDB, so it may be larger than memory, is written to the checkpoint with every
batch, and goes on from there after a restart. Sessions set ``spark.sql.streaming.stateStore.providerClass`` (:data:`PROVIDER`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .ticks import STATES

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: States after which nothing more comes for an order.
FINAL = frozenset({"ALL_TRADED", "CANCELLED", "REJECTED"})
ORDER = "order_id string, at long, status string, traded double"


class _Orders(StatefulProcessor):
    def __init__(self, timeout: int) -> None:
        self.timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.order = handle.getValueState("order", "rank int, traded double, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.order.get() if self.order.exists() else None
        rank, traded, newest = held if held else (-1, 0.0, 0)
        out = []
        for part in rows:
            for at, status, volume in zip(part["at"].tolist(), part["status"].tolist(), part["traded"].tolist(), strict=True):
                place = STATES.index(status) if status in STATES else -1
                more = volume if volume == volume and volume is not None else 0.0
                newest = max(newest, at)
                if place > rank or more > traded:
                    rank, traded = max(rank, place), max(traded, more)
                    out.append((key[0], newest, STATES[rank] if rank >= 0 else None, traded))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.order.update((rank, traded, newest))
        self.handle.registerTimer(max(newest // 1000 + self.timeout * 1000, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(out[-1:], columns=["order_id", "at", "status", "traded"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rank, traded, newest = self.order.get()
        self.order.clear()
        late = rank < 0 or STATES[rank] not in FINAL
        rows = [(key[0], newest + self.timeout * 1_000_000, "TIMEOUT", traded)] if late else []
        yield pd.DataFrame(rows, columns=["order_id", "at", "status", "traded"])

    def close(self) -> None:
        pass


def orders(updates: DataFrame, timeout: int, late: str = "10 minutes") -> DataFrame:
    """``order_id, at, status, traded``: an order's state after each batch that moved it, and ``TIMEOUT`` where none was final in time.

    ``updates`` has ``order_id, ts, status, traded``. Updates out of order never take a state or a volume back. An order's deadline is ``timeout``
    seconds after its newest update; when the watermark (``late`` behind the newest time seen) has passed it, the order is told
    to be late, if it has not ended, and its state is given up: what comes for it after that is a new order.
    """
    slim = updates.withWatermark("ts", late).select("order_id", "ts", F.unix_micros("ts").alias("at"), "status", F.col("traded").cast("double").alias("traded"))
    return slim.groupBy("order_id").transformWithStateInPandas(statefulProcessor=_Orders(timeout), outputStructType=ORDER, outputMode="Append", timeMode="EventTime")


class _Rolling(StatefulProcessor):
    def __init__(self, size: int) -> None:
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bars = handle.getListState("bars", "at long, close double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.bars.get()] if self.bars.exists() else []
        new = pd.concat(list(rows)).sort_values("at")
        out = []
        for at, close in zip(new["at"].tolist(), new["close"].tolist(), strict=True):
            held = sorted([*held, (at, close)])[-self.size :] if held and at < held[-1][0] else [*held, (at, close)][-self.size :]
            closes = pd.Series([c for _, c in held])
            out.append((key[0], at, len(held), closes.mean(), closes.std(ddof=0) if len(held) == self.size else None, closes.max(), closes.min()))
        self.bars.put(held)
        yield pd.DataFrame(out, columns=["symbol", "at", "n", "mean", "std", "high", "low"])

    def close(self) -> None:
        pass


def rolling(bars: DataFrame, size: int) -> DataFrame:
    """``symbol, at, n, mean, std, high, low`` of the last ``size`` closes at every bar of a stream ``symbol, ts, close``.

    The state of a symbol is its last ``size`` bars. ``std`` comes once there are so many. A bar that is older than the newest one takes its place
    among those that are held.
    """
    slim = bars.select("symbol", F.unix_micros("ts").alias("at"), F.col("close").cast("double").alias("close"))
    schema = "symbol string, at long, n int, mean double, std double, high double, low double"
    return slim.groupBy("symbol").transformWithStateInPandas(statefulProcessor=_Rolling(size), outputStructType=schema, outputMode="Append", timeMode="None")


def run_into(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Run a stream over what is there now into Parquet files below ``folder``, from where the checkpoint is."""
    stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
