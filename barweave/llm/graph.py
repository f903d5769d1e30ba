"""Connected components of an edge table by rounds of joins; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written

#: Moved roots that are broadcast at most, and the parts that a root's nodes are dealt into beyond that.
BROADCAST, SALTS = 50_000, 64


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of ``edges``: root is the smallest node that can be reached.

    Every round takes the smallest label among the neighbours and then follows the label's own label,
    so chains shorten by more than half a round. Neighbour lists are joined on the neighbour: each has one
    label, so a node with many neighbours is a skewed key of one side only, which Spark deals into parts. Only
    roots that have moved themselves are looked up, each once, and their nodes are dealt into parts,
    so a giant component does not meet in one task. A null end is no node; loops and repeated
    edges do no harm.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).dropna()
    both = written(pairs.unionByName(pairs.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "edges")
    labels = written(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("other"), "root"), "other").groupBy("node").agg(F.min("root").alias("near"))
        step = written(labels.join(seen, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root")), "step")
        ahead = labels.where("node != root").select(F.col("node").alias("root"), F.col("root").alias("next"))
        moved = written(step.select("root").distinct().join(ahead, "root"), "moved")
        if moved.count() <= BROADCAST:
            further = step.join(F.broadcast(moved), "root", "left")
        else:
            dealt = moved.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            further = step.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(dealt, ["root", "salt"], "left")
        new = written(further.select("node", "was", F.least("root", F.coalesce("next", "root")).alias("root")), "labels")
        changed = new.where("root != was").limit(1).count()
        for df in (labels, step, moved):
            drop_written(spark, df)
        labels = new
        if not changed:
            drop_written(spark, both)
            return labels.select("node", "root")
