"""Intermediate tables stored under a key made of what they depend on, so that a run that broke goes on where it was."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def content_key(df: DataFrame) -> str:
    """A key of a table's rows in any order: their number and the combined hashes, from one aggregation."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    row = df.select(F.xxhash64(*columns).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s")).first()
    return f"{row.n}-{row.x or 0:x}-{row.s or 0}"


class Stored:
    """Tables in ``folder`` (one that driver and executors share), one for each step and key."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.made = spark, folder.rstrip("/"), []

    def _done(self, where: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{where}/_SUCCESS")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def table(self, step: str, depends: object, make: Callable[[], DataFrame]) -> DataFrame:
        """The table of ``step`` for what it depends on (anything JSON can write): read if it is there whole, else made and written."""
        key = hashlib.sha256(json.dumps(depends, sort_keys=True, default=str).encode()).hexdigest()[:16]
        where = f"{self.folder}/{step}-{key}"
        if not self._done(where):
            make().write.mode("overwrite").parquet(where)
            self.made.append(step)
        return self.spark.read.parquet(where)
