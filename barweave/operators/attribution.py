"""Evaluation along time, risk attribution, volatility regimes, and a learned factor."""

from __future__ import annotations

from bisect import bisect_right, insort
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ops import ratio, steady, with_column
from .research import factor_returns


def rolling_ic(df: DataFrame, factor: str = "value", fwd: str = "fwd", window: int = 60, least: int = 10) -> DataFrame:
    """``date, symbol, ic``: rank correlation over the ``window`` rows of the symbol before this one, with ``least`` pairs."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("date")
        x, y = part["x"].to_numpy(float), part["y"].to_numpy(float)
        out = []
        for t in range(len(part)):
            a, b = x[max(0, t - window) : t], y[max(0, t - window) : t]
            ok = np.isfinite(a) & np.isfinite(b)
            ic = None
            if ok.sum() >= least:
                ra, rb = pd.Series(a[ok]).rank().to_numpy(), pd.Series(b[ok]).rank().to_numpy()
                ic = float(np.corrcoef(ra, rb)[0, 1]) if ra.std() > 0 and rb.std() > 0 else None
            out.append(ic)
        return pd.DataFrame({"date": part["date"], "symbol": part["symbol"], "ic": pd.Series(out, index=part.index, dtype=float)})

    rows = df.select("date", "symbol", steady(F.col(factor)).alias("x"), steady(F.col(fwd)).alias("y"))
    return rows.groupBy("symbol").applyInPandas(run, "date date, symbol string, ic double")


def expanding_long_short(df: DataFrame, factor: str = "value", fwd: str = "fwd", k: int = 5) -> DataFrame:
    """``date, symbol, bucket, ret``: each value's bucket among the symbol's values so far; the last is held long, the first short.

    No row looks ahead. Fewer than ``k + 1`` values give no bucket and no return. A symbol's values are kept
    sorted as they come, so a row costs a search.
    """
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("date")
        seen: list[float] = []
        buckets, returns = [], []
        for value, ahead in zip(part["x"].tolist(), part["r"].tolist(), strict=True):
            bucket = None
            if value is not None and value == value:
                insort(seen, value)
                n = len(seen)
                if n > k and ahead == ahead and ahead is not None:
                    bucket = max(0, ceil((bisect_right(seen, value) - 1) * k / (n - 1)) - 1)
            buckets.append(bucket)
            returns.append(0.0 if bucket is None or 0 < bucket < k - 1 else ahead if bucket else -ahead)
        return pd.DataFrame({"date": part["date"], "symbol": part["symbol"], "bucket": pd.array(buckets, "Int32"), "ret": returns})

    rows = df.select("date", "symbol", steady(F.col(factor)).alias("x"), F.col(fwd).alias("r"))
    return rows.groupBy("symbol").applyInPandas(run, "date date, symbol string, bucket int, ret double")


def volatility_regimes(panel: DataFrame, window: int = 20, parts: int = 3) -> DataFrame:
    """``date, symbol, ret, sd, regime``: the rolling deviation of returns, cut at the symbol's own quantiles."""
    rows = with_column(with_column(panel, "ret", "pct_change(close,1)", "single"), "sd", f"gated_std(pct_change(close,1),{window},{window})", "single").where("sd IS NOT NULL")
    cuts = F.percentile("sd", [i / parts for i in range(1, parts)]).over(W.partitionBy("symbol"))
    rows = rows.select("date", "symbol", "ret", "sd", steady(F.col("sd")).alias("_sd"), cuts.alias("_cuts"))
    regime = F.lit(0)
    for i in range(parts - 1):
        regime = regime + (F.col("_sd") >= steady(F.get("_cuts", F.lit(i)))).cast("int")
    return rows.select("date", "symbol", "ret", "sd", regime.alias("regime"))


def _long_run(x: Column, y: Column, w: W, lags: int) -> Column:
    """The terms whose mean is the long-run covariance of two centred series, with Bartlett weights."""
    out = x * y
    for j in range(1, lags + 1):
        out = out + (1 - j / (lags + 1)) * (F.coalesce(x * F.lag(y, j).over(w), F.lit(0.0)) + F.coalesce(y * F.lag(x, j).over(w), F.lit(0.0)))
    return out


def risk_attribution(df: DataFrame, weight: str, fwd: str, exposures: list[str], lags: int = 3) -> DataFrame:
    """``part, exposure, contribution, share``: what the market, each exposure and the rest add to a portfolio's volatility.

    The portfolio's return of a date is the sum of its exposures times that date's factor returns, and a
    rest. Each part's long-run covariance with the whole, over the whole's deviation, is its contribution;
    the contributions sum to that deviation exactly, and the shares to one.
    """
    w = F.coalesce(F.col(weight), F.lit(0.0))
    held = df.groupBy("date").agg(F.sum(w * F.coalesce(F.col(fwd), F.lit(0.0))).alias("total"), F.sum(w).alias("market"), *(F.sum(w * F.coalesce(F.col(e), F.lit(0.0))).alias(e) for e in exposures))
    names = ["market", *exposures]
    parts = held.select("date", "total", F.explode(F.array(*(F.struct(F.lit(n).alias("factor"), F.col(n).alias("exposure")) for n in names))).alias("p")).select("date", "total", "p.*")
    made = parts.join(factor_returns(df, fwd, exposures), ["date", "factor"], "left")
    made = made.select("date", "total", F.col("factor").alias("part"), "exposure", (F.col("exposure") * F.coalesce("ret", F.lit(0.0))).alias("c"))
    rest = made.groupBy("date").agg(F.first("total").alias("total"), F.sum("c").alias("known")).select("date", "total", F.lit("specific").alias("part"), F.lit(None).cast("double").alias("exposure"), (F.col("total") - F.col("known")).alias("c"))
    every = W.partitionBy("part")
    rows = made.unionByName(rest)
    rows = rows.withColumn("x", F.col("c") - F.avg("c").over(every)).withColumn("y", F.col("total") - F.avg("total").over(every))
    in_time = every.orderBy("date")
    terms = rows.select("part", "exposure", _long_run(F.col("x"), F.col("y"), in_time, lags).alias("xy"), _long_run(F.col("y"), F.col("y"), in_time, lags).alias("yy"))
    out = terms.groupBy("part").agg(F.avg("exposure").alias("exposure"), F.avg("xy").alias("xy"), F.avg("yy").alias("yy"))
    deviation = F.when(F.col("yy") > 0, F.sqrt("yy"))
    return out.select("part", "exposure", (F.col("xy") / deviation).alias("contribution"), ratio(F.col("xy"), F.col("yy")).alias("share"))


def fingerprint(panel: DataFrame) -> DataFrame:
    """``fingerprint``: first and last date, numbers of dates and symbols, and a digest of the symbols, for caches of results."""
    symbols = F.array_sort(F.collect_set("symbol"))
    row = panel.agg(F.min("date").alias("lo"), F.max("date").alias("hi"), F.count_distinct("date").alias("t"), symbols.alias("s"))
    return row.select(F.concat(F.col("lo").cast("string"), F.lit("~"), F.col("hi").cast("string"), F.lit("#"), F.col("t").cast("string"), F.lit("x"), F.size("s").cast("string"), F.lit("#"), F.left(F.md5(F.array_join("s", ",")), F.lit(8))).alias("fingerprint"))


def least_variance_weights(correlation: np.ndarray, variances: np.ndarray | None = None) -> np.ndarray:
    """Weights of least variance for a k by k correlation matrix: negative ones become 0, and a degenerate matrix gives equal ones."""
    k = len(correlation)
    if not k:
        return np.zeros(0)
    sd = np.sqrt(np.maximum(np.ones(k) if variances is None else np.asarray(variances, float), 1e-12))
    raw = np.linalg.pinv(np.nan_to_num(correlation) * np.outer(sd, sd)) @ np.ones(k)
    raw = np.maximum(raw, 0)
    return raw / raw.sum() if np.isfinite(raw).all() and raw.sum() > 1e-12 else np.full(k, 1 / k)


def learned_factor(df: DataFrame, features: list[str], fwd: str, lags: int = 2, train: float = 0.7, rounds: int = 10, seed: int = 7) -> DataFrame:
    """``date, symbol, part, score``: boosted trees on features and their lags within the symbol, fitted on the earlier dates."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    w = W.partitionBy("symbol").orderBy("date")
    columns = {f"{f}_{j}": F.lag(f, j).over(w) if j else F.col(f) for f in features for j in range(lags + 1)}
    rows = df.select("date", "symbol", fwd, *(c.alias(n) for n, c in columns.items())).dropna(subset=[fwd, *columns])
    dates = rows.select("date").distinct().withColumn("share", F.percent_rank().over(W.orderBy("date")))  # one row for a date
    rows = rows.join(dates, "date").withColumn("part", F.when(F.col("share") < train, "train").otherwise("test"))
    packed = VectorAssembler(inputCols=list(columns), outputCol="x").transform(rows)
    model = GBTRegressor(featuresCol="x", labelCol=fwd, predictionCol="score", maxIter=rounds, maxDepth=3, seed=seed).fit(packed.where("part = 'train'"))
    return model.transform(packed).select("date", "symbol", "part", "score")
