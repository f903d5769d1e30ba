"""Parameters on a lattice: grids from defaults, their size, and whether the best point stands on a plateau.

Points are rows with one coordinate for each parameter (the place of its value in the grid). A neighbour is a point one step away in
one coordinate, so neighbourhoods are a join of the results with themselves, shifted: a stencil, for all points at once.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence
from math import prod

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ops import ratio, with_factors

# Parameters that scale a position and change no signal.
NO_SIGNAL = frozenset("size max_pos capital inverse fixed_size".split())

Grid = dict[str, list[float]]


def auto_grid(defaults: Mapping[str, object], dims: int = 4, values: int = 3) -> Grid:
    """Half, once and twice each whole-number default (1 at least), and a half, one and one and a half of each other.

    Flags, texts, zeros (which have no scale) and parameters that only scale a position are left out.
    """
    numbers = {k: v for k, v in defaults.items() if isinstance(v, (int, float)) and not isinstance(v, bool) and v and k not in NO_SIGNAL}
    out: Grid = {}
    for name, v in itertools.islice(numbers.items(), dims):
        around = [max(1, v // 2), v, 2 * v] if isinstance(v, int) else [0.5 * v, v, 1.5 * v]
        out[name] = list(dict.fromkeys(around))[:values]
    return out


def shrunk(grid: Mapping[str, Sequence[float]], most: int = 60) -> Grid:
    """The grid with ``most`` points at most: middle values of the longest parameters go first, ends stay; then whole parameters, from the last."""
    out = {k: list(v) for k, v in grid.items()}
    while out and prod(map(len, out.values())) > most:
        longest = max(out.values(), key=len)
        if len(out) == 1:
            del longest[most:]
        elif len(longest) > 2:
            longest.pop(len(longest) // 2)
        else:
            out.popitem()
    return out


def points(spark, grid: Mapping[str, Sequence[float]], most: int = 60) -> DataFrame:
    """Every point: the parameters' values, and ``at``, their places. More than ``most`` are refused."""
    if not grid or not all(grid.values()):
        raise ValueError("every parameter needs a value")
    if prod(map(len, grid.values())) > most:
        raise ValueError(f"more than {most} points; shrink the grid")
    places = itertools.product(*(range(len(v)) for v in grid.values()))
    rows = [(*(float(v[i]) for v, i in zip(grid.values(), at, strict=True)), list(at)) for at in places]
    return spark.createDataFrame(rows, ", ".join(f"`{k}` double" for k in grid) + ", at array<int>")


def neighbours(results: DataFrame, dims: int, value: str = "sharpe") -> DataFrame:
    """``at, other, near``: the results one step away from each point, for all points; those that were not run have none."""
    def step(dim: int, by: int) -> Column:
        return F.transform("at", lambda x, i: x + F.when(i == dim, by).otherwise(0))

    steps = [step(dim, by) for dim in range(dims) for by in (-1, 1)]
    asked = results.select("at", F.explode(F.array(*steps)).alias("other"))
    return asked.join(results.select(F.col("at").alias("other"), F.col(value).alias("near")), "other").select("at", "other", "near")


def plateau(results: DataFrame, dims: int, value: str = "sharpe", least: float = 0.6) -> DataFrame:
    """``results`` with ``neighbours, median, ratio, ok, best``: whether what is around a point is ``least`` of it, in the middle.

    A point of no gain stands on no plateau; one without any neighbour was not searched for and passes. ``best`` is the point with the
    largest value (the smallest coordinates among equal ones).
    """
    around = neighbours(results, dims, value).groupBy("at").agg(F.count("near").alias("neighbours"), F.percentile("near", 0.5).alias("median"))
    rows = results.join(around, "at", "left").withColumn("neighbours", F.coalesce("neighbours", F.lit(0)))
    gains = F.coalesce(F.col(value) > 0, F.lit(False))
    rows = rows.withColumn("ratio", F.when(gains, ratio(F.col("median"), F.col(value))))
    ok = gains & ((F.col("neighbours") == 0) | F.coalesce(F.col("ratio") >= least, F.lit(False)))
    first = F.row_number().over(W.orderBy(F.desc_nulls_last(value), "at"))  # a row for each point of the grid
    return rows.withColumn("ok", ok).withColumn("best", first == 1)


def averages_run(panel: DataFrame, grid: Mapping[str, Sequence[float]]) -> DataFrame:
    """``fast, slow, at, sharpe``: the dual-average strategy at every point with fast < slow, all of them from one batch of windows.

    The mean return over symbols of each date, with the target of a bar filled at the next open; annual Sharpe ratio over dates.
    """
    fast, slow = grid["fast"], grid["slow"]
    pairs = [(i, j, int(a), int(b)) for i, a in enumerate(fast) for j, b in enumerate(slow) if a < b]
    means = {f"m{n}": f"gated_mean(close,{n},{n})" for n in sorted({n for _, _, a, b in pairs for n in (a, b)})}
    rows = panel.select("date", "symbol", "open").join(with_factors(panel, means, "single", fill=False), ["date", "symbol"])
    side = lambda a, b: F.when(F.col(f"m{a}").isNull() | F.col(f"m{b}").isNull(), 0).when(F.col(f"m{a}") > F.col(f"m{b}"), 1).otherwise(-1)
    every = F.array(*(F.struct(F.array(F.lit(i), F.lit(j)).alias("at"), F.lit(float(a)).alias("fast"), F.lit(float(b)).alias("slow"), side(a, b).alias("target")) for i, j, a, b in pairs))
    rows = rows.select("date", "symbol", "open", F.inline(every))
    w = W.partitionBy("at", "symbol").orderBy("date")
    gain = F.lag("target").over(w) * (ratio(F.lead("open").over(w), F.col("open")) - 1)
    daily = rows.withColumn("gain", F.coalesce(gain, F.lit(0.0))).groupBy("at", "fast", "slow", "date").agg(F.avg("gain").alias("r"))
    return daily.groupBy("at", "fast", "slow").agg((ratio(F.avg("r"), F.stddev_samp("r")) * float(np.sqrt(252))).alias("sharpe"))
