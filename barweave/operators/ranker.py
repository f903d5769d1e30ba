"""Learning to rank within dates: a linear score whose pairs are weighted by what swapping them would do to NDCG.

Each round is one job: a task goes over whole dates, sums the gradient of its pairs, and Spark adds up one short row for each batch of dates.
Only pairs with one of the first ``k`` can change NDCG, so a date of n symbols has k times n pairs, not n times n.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .research import standardised


def date_gradient(x: np.ndarray, relevance: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
    """The gradient of one date: over pairs with different relevance, |change of NDCG| times the chance of the wrong order."""
    n = len(x)
    gain = 2.0**relevance - 1
    discount = np.zeros(n)
    discount[: min(k, n)] = 1 / np.log2(np.arange(min(k, n)) + 2)
    ideal = np.sort(gain)[::-1] @ discount
    if ideal <= 0:
        return np.zeros(x.shape[1])
    score = x @ w
    order = np.lexsort((np.arange(n), -score))
    x, gain, score, relevance = x[order], gain[order], score[order], relevance[order]
    top = min(k, n)
    side = np.sign(relevance[:top, None] - relevance)
    change = np.abs((gain[:top, None] - gain) * (discount[:top, None] - discount)) / ideal
    pull = side * change / (1 + np.exp(np.clip(side * (score[:top, None] - score), -30, 30)))
    pull[:, :top] /= 2  # pairs of two of the first k are met twice
    force = -pull.sum(axis=0)
    force[:top] += pull.sum(axis=1)
    return x.T @ force


def fitted(rows: DataFrame, features: Sequence[str], relevance: str, k: int = 5, rounds: int = 30, rate: float = 0.5, shrink: float = 1e-3) -> np.ndarray:
    """Weights of standardised features, from the rows of ``date, symbol``, the features and a whole-number ``relevance``.

    Missing features are the date's mean; rows without relevance do not count. Zeros without any rows.
    """
    z = standardised(rows.where(F.col(relevance).isNotNull()).select("date", "symbol", relevance, *features), list(features))
    one = F.struct("symbol", F.array(*(F.coalesce(F.col(f), F.lit(0.0)) for f in features)).alias("x"), F.col(relevance).cast("double").alias("y"))
    dates = z.groupBy("date").agg(F.array_sort(F.collect_list(one)).alias("rows")).select(F.col("rows.x").alias("x"), F.col("rows.y").alias("y")).cache()  # a row is one date's cross-section
    w, speed = np.zeros(len(features)), np.zeros(len(features))
    names = [f"g{i}" for i in range(len(features))]
    try:
        for _ in range(rounds):
            total = dates.mapInArrow(_summing(w, k, names), ", ".join(f"{n} double" for n in ("n", *names))).agg(*(F.sum(n) for n in ("n", *names))).first()
            if not total[0]:
                break
            grad = np.array(total[1:]) / total[0] - shrink * w
            speed = 0.9 * speed + rate * grad
            w = w + speed
    finally:
        dates.unpersist()
    return w


def _summing(w: np.ndarray, k: int, names: list[str]):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = np.zeros(len(w))
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out += date_gradient(np.array(x), np.array(y), w, k)
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (float(batch.num_rows), *out.tolist())], ["n", *names])

    return run


def scored(rows: DataFrame, features: Sequence[str], weights: np.ndarray, name: str = "score") -> DataFrame:
    """``rows`` with the score of each row within its date."""
    z = standardised(rows.select("date", "symbol", *features), list(features))
    value = sum((F.coalesce(F.col(f), F.lit(0.0)) * float(w) for f, w in zip(features, weights, strict=True)), F.lit(0.0))
    return rows.join(z.select("date", "symbol", value.alias(name)), ["date", "symbol"])


def least_squares(rows: DataFrame, features: Sequence[str], target: str) -> np.ndarray:
    """The regression surrogate: weights of the standardised features on ``target``, from one aggregation of products."""
    z = standardised(rows.where(F.col(target).isNotNull()).select("date", "symbol", target, *features), list(features))
    z = z.select(F.col(target).alias("y"), *(F.coalesce(F.col(f), F.lit(0.0)).alias(f) for f in features))
    pairs = [(a, b) for a in features for b in features]
    row = z.agg(*(F.sum(F.col(a) * F.col(b)) for a, b in pairs), *(F.sum(F.col(a) * (F.col("y") - 0.0)) for a in features)).first()
    if row[0] is None:
        return np.zeros(len(features))
    k = len(features)
    return np.linalg.pinv(np.array(row[: k * k]).reshape(k, k)) @ np.array(row[k * k :])
