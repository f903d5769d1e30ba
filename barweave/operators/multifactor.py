"""A model of several factors along each symbol's time: z-scores so far, weighted, less those that repeat a heavier one.

A symbol is its own model. Scores look back only; what is chosen by correlation may be held to the dates before one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.factors import technical
from ..functions.ops import with_factors
from .research import _corr


@dataclass(frozen=True)
class Spec:
    """A factor of the model: a formula along time, and its weight."""

    name: str
    formula: str
    weight: float = 1.0


def spec_of(kind: str, window: int, weight: float = 1.0) -> Spec:
    """A built-in kind over a window."""
    return Spec(f"{kind}_{window}", technical(kind, window), weight)


#: What the strategy trades if nothing else is said.
DEFAULT = (spec_of("momentum", 20, 1.0), spec_of("mean_reversion", 60, -0.5), spec_of("volatility", 20, -0.3))


def signals(bars: DataFrame, specs: tuple[Spec, ...]) -> DataFrame:
    """``date, symbol`` and each factor as z-score against the symbol's own values so far; 0 where there is none."""
    return with_factors(bars, {s.name: f"expanding_zscore({s.formula})" for s in specs}, "single", fill=True)


def kept(z: DataFrame, specs: tuple[Spec, ...], bound: float = 0.7, seen: Column | None = None) -> DataFrame:
    """``symbol, kept``: which factors (numbers in ``specs``) stay, heaviest first, as long as |correlation| with all kept ones is below ``bound``.

    All pairs of a symbol come from one aggregation; ``seen`` limits it to some rows (the dates that may be learned from). A factor without
    spread is correlated with none.
    """
    k = len(specs)
    pair = lambda i, j: F.abs(F.coalesce(_corr(specs[i].name, specs[j].name), F.lit(0.0)))
    flat = [F.lit(1.0) if i == j else pair(min(i, j), max(i, j)) for i in range(k) for j in range(k)]
    rows = z if seen is None else z.where(seen)
    matrix = rows.groupBy("symbol").agg(F.array(*flat).alias("m"))
    order = sorted(range(k), key=lambda i: -abs(specs[i].weight))

    def add(held: Column, i: Column) -> Column:
        near = F.exists(held, lambda j: F.get(F.col("m"), i * k + j) >= bound)
        return F.when(near, held).otherwise(F.concat(held, F.array(i)))

    chosen = F.aggregate(F.array(*map(F.lit, order)), F.array().cast("array<int>"), add)
    return matrix.select("symbol", F.array_sort(chosen).alias("kept"))


def scores(z: DataFrame, specs: tuple[Spec, ...], by: DataFrame | None = None) -> DataFrame:
    """``date, symbol, score``: the weighted sum of the kept factors (all of them without ``by``) over the sum of their |weights|."""
    if by is None:
        total = sum(abs(s.weight) for s in specs)
        value = sum((F.col(s.name) * s.weight for s in specs), F.lit(0.0))
        return z.select("date", "symbol", (value / total if total > 0 else value).alias("score"))
    rows = z.join(by, "symbol", "left")
    stays = [F.coalesce(F.array_contains("kept", i), F.lit(True)) for i in range(len(specs))]
    value = sum((F.when(s, F.col(x.name) * x.weight).otherwise(0.0) for s, x in zip(stays, specs, strict=True)), F.lit(0.0))
    total = sum((F.when(s, abs(x.weight)).otherwise(0.0) for s, x in zip(stays, specs, strict=True)), F.lit(0.0))
    return rows.select("date", "symbol", F.when(total > 0, value / F.when(total > 0, total)).otherwise(value).alias("score"))


def targets(scored: DataFrame, enter: float = 0.5, leave: float | None = None, most: float = 1.0, size: float = 1.0) -> DataFrame:
    """``date, symbol, score, target``: ``most * size`` long above ``enter``, as much short below ``-enter``, else nothing.

    With ``leave`` a position is held until the score comes back within it, or to the other side: the state of a symbol is the last
    decision that was made.
    """
    side = F.when(F.col("score") > enter, 1).when(F.col("score") < -enter, -1)
    if leave is None:
        held = F.coalesce(side, F.lit(0))
    else:
        before = W.partitionBy("symbol").orderBy("date")
        crossed = F.signum("score") * F.signum(F.lag("score").over(before)) < 0
        decided = side.when((F.abs("score") < leave) | crossed, 0)
        held = F.coalesce(F.last(F.col("decided"), True).over(before.rowsBetween(W.unboundedPreceding, 0)), F.lit(0))
        scored = scored.withColumn("decided", decided)
    return scored.select("date", "symbol", "score", (held * most * size).cast("double").alias("target"))
