"""Evaluation of factors: information coefficients, buckets, portfolios, combination and de-duplication.

A factor frame has ``date, symbol``, a factor column and a forward return. Everything is an aggregation
by date on top of windows by date or symbol; per-date linear algebra runs in Arrow-grouped pandas, where a
group is one date's cross-section.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ops import ratio, steady


def by_date() -> W:
    return W.partitionBy("date")


def forward_return(panel: DataFrame, h: int = 1, name: str = "fwd") -> DataFrame:
    """Return over the next ``h`` rows of the symbol."""
    w = W.partitionBy("symbol").orderBy("date")
    return panel.withColumn(name, ratio(F.lead("close", h).over(w), F.col("close")) - 1)


def average_rank(x: Column) -> Column:
    """Rank within the date, ties averaged; NULL stays NULL."""
    x = steady(x)
    place = F.rank().over(by_date().orderBy(x.asc_nulls_last()))
    return F.when(x.isNotNull(), place + (F.count(x).over(W.partitionBy("date", x)) - 1) / 2)


def _corr(a: str, b: str) -> Column:
    """Pearson correlation as an aggregate; NULL without variance."""
    spread = F.sqrt(F.var_samp(a)) * F.sqrt(F.var_samp(b))
    return F.when(spread > 1e-12, F.covar_samp(a, b) / F.when(spread > 1e-12, spread))


def daily_ic(df: DataFrame, factor: str = "value", fwd: str = "fwd", least: int = 3) -> DataFrame:
    """``date, n, rank_ic, ic``: correlation of factor and forward return at each date with ``least`` pairs."""
    pairs = df.where(F.col(factor).isNotNull() & F.col(fwd).isNotNull()).select("date", F.col(factor).alias("x"), F.col(fwd).alias("y"))
    ranked = pairs.select("date", "x", "y", average_rank(F.col("x")).alias("rx"), average_rank(F.col("y")).alias("ry"))
    return ranked.groupBy("date").agg(F.count(F.lit(1)).alias("n"), _corr("rx", "ry").alias("rank_ic"), _corr("x", "y").alias("ic")).where(F.col("n") >= least)


def ic_statistics(ic: DataFrame, column: str = "rank_ic") -> DataFrame:
    """``n, mean, std, ir, positive``: over the dates that have a coefficient."""
    x = F.col(column)
    out = ic.where(x.isNotNull()).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.avg((x > 1e-12).cast("double")).alias("positive"))
    return out.withColumn("ir", ratio(F.col("mean"), F.col("std")))


def ic_decay(panel: DataFrame, factor: str = "value", lags: int = 5, least: int = 3) -> DataFrame:
    """``lag, mean_ic``: mean rank coefficient against the return of 1 ... ``lags`` rows ahead."""
    out = None
    for h in range(1, lags + 1):
        part = daily_ic(forward_return(panel, h), factor, "fwd", least).agg(F.avg("rank_ic").alias("mean_ic")).select(F.lit(h).alias("lag"), "mean_ic")
        out = part if out is None else out.unionByName(part)
    return out


def half_life(decay: DataFrame) -> DataFrame:
    """``half_life``: ln 2 over the fall of ln |coefficient| with the lag; NULL if it does not fall or has under three points."""
    points = decay.where(F.abs("mean_ic") > 0).select(F.col("lag").cast("double").alias("x"), F.log(F.abs("mean_ic")).alias("y"))
    slope = ratio(F.covar_samp("x", "y"), F.var_samp("x"))
    return points.agg(F.when((F.count("x") >= 3) & (slope < 0), -F.log(F.lit(2.0)) / slope).alias("half_life"))


def bucketed(df: DataFrame, factor: str = "value", k: int = 5, least: int = 2) -> DataFrame:
    """Rows with a factor value and their ``bucket`` 0 ... k - 1 within the date (ties in the order of symbols)."""
    rows = df.where(F.col(factor).isNotNull())
    place = F.row_number().over(by_date().orderBy(steady(F.col(factor)), "symbol"))
    n = F.count(F.lit(1)).over(by_date())
    bucket = F.greatest(F.lit(0), F.ceil((place - 1) * k / F.when(n > 1, n - 1)) - 1)
    return rows.select("*", bucket.cast("int").alias("bucket"), n.alias("n_date")).where(F.col("n_date") >= least)


def bucket_returns(df: DataFrame, factor: str = "value", fwd: str = "fwd", k: int = 5) -> DataFrame:
    """``bucket, n, mean_return``: mean over dates of the mean forward return of each bucket."""
    rows = bucketed(df.where(F.col(fwd).isNotNull()), factor, k, k)
    return rows.groupBy("date", "bucket").agg(F.avg(fwd).alias("r")).groupBy("bucket").agg(F.count("r").alias("n"), F.avg("r").alias("mean_return"))


def monotonicity(buckets: DataFrame) -> DataFrame:
    """``monotonicity``: correlation of a bucket's number and its mean return."""
    return buckets.select(F.col("bucket").cast("double").alias("b"), F.col("mean_return").alias("r")).agg(_corr("b", "r").alias("monotonicity"))


def long_short(df: DataFrame, factor: str = "value", fwd: str = "fwd", k: int = 5, cost: float = 0.0) -> DataFrame:
    """``date, gross, turnover, net, n``: top bucket long, bottom bucket short, equal weights, each side of sum one.

    Turnover is half the sum of weight changes between consecutive traded dates, 0 at the first; the cost
    is charged on it.
    """
    rows = bucketed(df.where(F.col(fwd).isNotNull()), factor, k, k)
    side = F.when(F.col("bucket") == k - 1, 1.0).when(F.col("bucket") == 0, -1.0)
    held = rows.withColumn("side", side).where(F.col("side").isNotNull())
    held = held.withColumn("weight", F.col("side") / F.count(F.lit(1)).over(W.partitionBy("date", "side"))).select("date", "symbol", "weight", F.col(fwd).alias("r"))
    dates = held.groupBy("date").agg(F.sum(F.col("weight") * F.col("r")).alias("gross"), F.count(F.lit(1)).alias("n"))
    # Traded dates are a dimension; numbering them takes one row for each.
    dates = dates.withColumn("seq", F.row_number().over(W.orderBy("date")))
    now = held.join(dates.select("date", "seq"), "date").select("seq", "symbol", "weight")
    before = now.select((F.col("seq") + 1).alias("seq"), "symbol", F.col("weight").alias("old"))
    moved = now.join(before, ["seq", "symbol"], "full_outer").groupBy("seq").agg(F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))).alias("moved"))
    turnover = F.when(F.col("seq") == 1, 0.0).otherwise(F.col("moved") / 2)
    out = dates.join(moved, "seq").withColumn("turnover", turnover)
    return out.select("date", "gross", "turnover", (F.col("gross") - cost * F.col("turnover")).alias("net"), "n")


def performance(returns: DataFrame, column: str = "net", ppy: float = 252.0) -> DataFrame:
    """Total and annual return, Sharpe, Sortino, maximum drawdown, Calmar, win rate, profit factor of a return series."""
    r = F.col(column)
    path = returns.where(r.isNotNull()).select("date", r.alias("r"), F.exp(F.sum(F.log1p(F.greatest(r, F.lit(-0.999999)))).over(W.orderBy("date"))).alias("equity"))
    path = path.withColumn("drawdown", F.col("equity") / F.greatest(F.lit(1.0), F.max("equity").over(W.orderBy("date"))) - 1)
    down, gain, loss = F.when(F.col("r") < 0, F.col("r")), F.sum(F.when(F.col("r") > 0, F.col("r"))), F.sum(F.when(F.col("r") < 0, -F.col("r")))
    out = path.agg(
        F.count("r").alias("n"), (F.max_by("equity", "date") - 1).alias("total"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), F.stddev_samp(down).alias("sd_down"),
        F.min("drawdown").alias("max_drawdown"), F.avg((F.col("r") > 0).cast("double")).alias("win_rate"), ratio(gain, loss).alias("profit_factor"),
    )
    annual = F.when(F.col("total") > -1, F.pow(1 + F.col("total"), ppy / F.col("n")) - 1).otherwise(-1.0)
    out = out.withColumn("annual", annual)
    root = float(np.sqrt(ppy))
    return out.select("n", "total", "annual", (ratio(F.col("mean"), F.col("sd")) * root).alias("sharpe"), (ratio(F.col("mean"), F.col("sd_down")) * root).alias("sortino"), "max_drawdown", ratio(F.col("annual"), F.abs("max_drawdown")).alias("calmar"), "win_rate", "profit_factor")


def risk_xray(returns: DataFrame, column: str = "net") -> DataFrame:
    """Volatility, value at risk and its tail mean at 5 %, bias-corrected skew and kurtosis, longest time under water."""
    rows = returns.where(F.col(column).isNotNull()).select("date", F.col(column).alias("r"))
    var = rows.agg(F.percentile("r", 0.05).alias("var95"))
    tail = rows.join(F.broadcast(var), F.col("r") <= F.col("var95")).agg(F.avg("r").alias("cvar95"))  # one row on the right
    n = F.count("r").cast("double")
    stats = rows.agg(
        n.alias("n"), (F.stddev_samp("r") * float(np.sqrt(252))).alias("volatility"),
        (F.skewness("r") * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)).alias("skew"),
        (F.when(n > 3, (n - 1) / ((n - 2) * (n - 3))) * ((n + 1) * F.kurtosis("r") + 6)).alias("kurtosis"),
    )
    w = W.orderBy("date")
    path = rows.withColumn("equity", F.sum(F.log1p(F.greatest(F.col("r"), F.lit(-0.999999)))).over(w))
    path = path.withColumn("under", F.col("equity") < F.greatest(F.lit(0.0), F.max("equity").over(w)) - 1e-12)
    path = path.withColumn("island", F.sum(F.when(F.col("under"), 0).otherwise(1)).over(w))
    longest = path.where("under").groupBy("island").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("underwater"))
    return stats.crossJoin(var).crossJoin(tail).crossJoin(longest)  # each is one row


def standardised(df: DataFrame, columns: list[str], clip: float = 3.0) -> DataFrame:
    """Each column as z-score of its date, clipped; NULL where fewer than two values or no spread."""
    def z(c: str) -> Column:
        x = F.col(c)
        sd = F.stddev_samp(x).over(by_date())
        value = (x - F.avg(x).over(by_date())) / F.when(sd > 1e-12, sd)
        return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(-clip)), F.lit(clip)))

    return df.select(*[c for c in df.columns if c not in columns], *(z(c).alias(c) for c in columns))


def factor_correlations(df: DataFrame, factors: list[str]) -> DataFrame:
    """``a, b, correlation``: pooled correlation of cross-sectional ranks, for each pair of factors, in one aggregation."""
    ranked = df.select(*(average_rank(F.col(c)).alias(c) for c in factors))
    pairs = [(a, b) for i, a in enumerate(factors) for b in factors[i + 1 :]]

    def pooled(a: str, b: str) -> Column:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
        spread = F.stddev_samp(x) * F.stddev_samp(y)
        return F.when(spread > 1e-12, F.covar_samp(x, y) / F.when(spread > 1e-12, spread))

    row = ranked.agg(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), pooled(a, b).alias("correlation")) for a, b in pairs)).alias("p"))
    return row.select(F.inline("p"))


def greedy_clusters(names: list[str], metric: dict[str, float], correlation: dict[tuple[str, str], float], threshold: float = 0.7) -> dict[str, list[str]]:
    """Representatives, best metric first, and what each absorbs (signed correlation at the threshold or above).

    This runs on names, a few hundred at most; the correlations come from Spark.
    """
    left = sorted(names, key=lambda n: (-metric.get(n, 0.0), n))
    out: dict[str, list[str]] = {}
    while left:
        head = left.pop(0)
        near = [n for n in left if correlation.get((head, n), correlation.get((n, head), 0.0)) >= threshold]
        out[head] = near
        left = [n for n in left if n not in near]
    return out


def weights(stats: dict[str, tuple[float, float]], scheme: str = "equal") -> dict[str, float]:
    """Long-only weights from (mean, std) of each factor's coefficient: equal, icir, or inverse_variance."""
    if scheme == "icir":
        raw = {k: max(0.0, m / s) if s else 0.0 for k, (m, s) in stats.items()}
    elif scheme == "inverse_variance":
        raw = {k: 1 / s**2 if s else 0.0 for k, (_, s) in stats.items()}
    else:
        raw = dict.fromkeys(stats, 1.0)
    total = sum(raw.values())
    return {k: v / total for k, v in raw.items()} if total > 0 else dict.fromkeys(stats, 1 / max(1, len(stats)))


def combined(df: DataFrame, by: dict[str, float]) -> DataFrame:
    """``date, symbol, value``: weighted sum of standardised factors, missing ones as 0."""
    z = standardised(df.select("date", "symbol", *by), list(by))
    return z.select("date", "symbol", sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in by.items()), F.lit(0.0)).alias("value"))


def neutralised(df: DataFrame, factor: str, group: str) -> DataFrame:
    """The factor less the mean of its group on the date."""
    return df.withColumn(factor, F.col(factor) - F.avg(factor).over(W.partitionBy("date", group)))


def _residuals(part: pd.DataFrame, factor: str, styles: list[str], tails: float) -> pd.Series:
    y = part[factor].astype(float)
    y = y.clip(y.quantile(tails), y.quantile(1 - tails))
    x = np.column_stack([np.ones(len(part)), *(part[s].astype(float) for s in styles)])
    ok = np.isfinite(y) & np.isfinite(x).all(axis=1)
    out = pd.Series(np.nan, index=part.index)
    if ok.sum() >= max(5, x.shape[1] + 2):
        beta = np.linalg.lstsq(x[ok], y[ok], rcond=None)[0]
        out[ok] = y[ok] - x[ok] @ beta
    return out


def neutralised_by_styles(df: DataFrame, factor: str, styles: list[str], tails: float = 0.01) -> DataFrame:
    """``date, symbol, value``: residual of the winsorised factor on an intercept and the styles, date by date."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("symbol")
        return pd.DataFrame({"date": part["date"], "symbol": part["symbol"], "value": _residuals(part, factor, styles, tails)})

    return df.select("date", "symbol", factor, *styles).groupBy("date").applyInPandas(run, "date date, symbol string, value double")


def orthogonalised(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns made uncorrelated in their order, date by date (centred Gram-Schmidt, unit population deviation)."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("symbol").reset_index(drop=True)
        x = part[columns].astype(float).fillna(0.0).to_numpy()
        x = x - x.mean(axis=0)
        done = np.zeros_like(x)
        for k in range(x.shape[1]):
            v = x[:, k] - sum((done[:, j] * (done[:, j] @ x[:, k]) / len(x) for j in range(k)), np.zeros(len(x)))
            sd = v.std()
            done[:, k] = v / sd if sd > 1e-9 else 0.0
        return pd.concat([part[["date", "symbol"]], pd.DataFrame(done, columns=columns)], axis=1)

    fields = ", ".join(f"`{c}` double" for c in columns)
    return df.select("date", "symbol", *columns).groupBy("date").applyInPandas(run, f"date date, symbol string, {fields}")


def factor_returns(df: DataFrame, fwd: str, exposures: list[str], weight: str | None = None, ridge: float = 1e-6) -> DataFrame:
    """``date, factor, ret, r2``: weighted least squares of forward returns on exposures, date by date, with an intercept."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.dropna(subset=[fwd, *exposures]).sort_values("symbol")
        names = ["market", *[e for e in exposures if part[e].std() > 1e-12]]
        if len(part) < len(names) + 1:
            return pd.DataFrame({"date": pd.Series(dtype=object), "factor": pd.Series(dtype=str), "ret": pd.Series(dtype=float), "r2": pd.Series(dtype=float)})
        x = np.column_stack([np.ones(len(part)), *(part[e].astype(float) for e in names[1:])])
        y = part[fwd].astype(float).to_numpy()
        w = np.sqrt(part[weight].astype(float).clip(lower=0).to_numpy()) if weight else np.ones(len(part))
        xw, yw = x * w[:, None], y * w
        beta = np.linalg.solve(xw.T @ xw + ridge * np.eye(len(names)), xw.T @ yw)
        total = ((y - y.mean()) ** 2).sum()
        r2 = 1 - ((y - x @ beta) ** 2).sum() / total if total > 0 else np.nan
        return pd.DataFrame({"date": part["date"].iloc[0], "factor": names, "ret": beta, "r2": r2})

    extra = [weight] if weight else []
    return df.select("date", "symbol", fwd, *exposures, *extra).groupBy("date").applyInPandas(run, "date date, factor string, ret double, r2 double")


def newey_west(returns: DataFrame, a: str, b: str, lags: int) -> DataFrame:
    """``covariance``: long-run covariance of two series with Bartlett weights, from lagged products."""
    means = returns.agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.count(F.lit(1)).alias("t"))
    centred = returns.join(F.broadcast(means)).select("date", (F.col(a) - F.col("ma")).alias("x"), (F.col(b) - F.col("mb")).alias("y"), "t")  # one row on the right
    w = W.orderBy("date")
    terms = F.col("x") * F.col("y")
    for j in range(1, lags + 1):
        lagged = F.coalesce(F.col("x") * F.lag("y", j).over(w), F.lit(0.0)) + F.coalesce(F.col("y") * F.lag("x", j).over(w), F.lit(0.0))
        terms = terms + (1 - j / (lags + 1)) * lagged
    return centred.select(terms.alias("v"), "t").agg((F.sum("v") / F.max("t")).alias("covariance"))


def regimes(df: DataFrame, flat: float = 1e-4) -> DataFrame:
    """``regime`` from the slope of log price: falling, rising, or sideways where its change over five rows is small."""
    w = W.partitionBy("symbol").orderBy("date")
    change = F.col("slope") - F.lag("slope", 5).over(w)
    label = F.when(F.col("slope").isNull() | (F.abs(F.coalesce(change, F.lit(0.0))) < flat), "sideways").when(F.col("slope") > 0, "bull").otherwise("bear")
    return df.withColumn("regime", label)


def time_split(df: DataFrame, train: float = 0.6, valid: float = 0.2) -> DataFrame:
    """``part``: train, valid or test by the date's place among all dates."""
    dates = df.select("date").distinct().withColumn("i", F.row_number().over(W.orderBy("date")))
    dates = dates.withColumn("n", F.count(F.lit(1)).over(W.partitionBy()))
    part = F.when(F.col("i") <= F.floor(F.col("n") * train), "train").when(F.col("i") <= F.floor(F.col("n") * train) + F.floor(F.col("n") * valid), "valid").otherwise("test")
    return df.join(F.broadcast(dates.select("date", part.alias("part"))), "date")  # a row for each date


def turbulence(df: DataFrame, column: str, train: int = 100) -> DataFrame:
    """``turbulence``: distance from the mean of the first ``train`` rows of the symbol, in their deviations."""
    w = W.partitionBy("symbol")
    first = F.when(F.row_number().over(w.orderBy("date")) <= train, F.col(column))
    rows = df.withColumn("first", first)
    sd = F.stddev_samp("first").over(w)
    return rows.withColumn("turbulence", F.abs(F.col(column) - F.avg("first").over(w)) / F.when(sd > 1e-12, sd)).drop("first")


def turbulence_regimes(df: DataFrame, column: str, train: int = 100) -> DataFrame:
    """``turbulence, regime, scale``: EXTREME above the 99 % quantile of the symbol's rows after the first ``train``, HIGH above the 95 % one.

    HIGH is never below one deviation, EXTREME never below the 95 % quantile. ``scale`` is what exposure is left with: all, half, nothing. The
    first rows, which the mean and deviation come from, are LOW.
    """
    w = W.partitionBy("symbol")
    rows = turbulence(df, column, train).withColumn("place", F.row_number().over(w.orderBy("date")))
    later = F.when(F.col("place") > train, F.col("turbulence"))
    bounds = rows.groupBy("symbol").agg(F.percentile(later, 0.95).alias("q95"), F.percentile(later, 0.99).alias("q99"))
    high, extreme = F.greatest("q95", F.lit(1.0)), F.greatest(F.col("q99"), F.col("q95") + 1e-9)
    regime = F.when(later > extreme, "EXTREME").when(later > high, "HIGH").otherwise("LOW")
    rows = rows.join(bounds, "symbol").withColumn("regime", regime).drop("place", "q95", "q99")
    return rows.withColumn("scale", F.when(F.col("regime") == "LOW", 1.0).when(F.col("regime") == "HIGH", 0.5).otherwise(0.0))


def decay_status(ic: DataFrame, recent: int = 60, column: str = "rank_ic") -> DataFrame:
    """``recent, history, ratio, status`` of a coefficient series: its last rows against those before."""
    rows = ic.where(F.col(column).isNotNull()).withColumn("back", F.row_number().over(W.orderBy(F.desc("date"))))
    out = rows.agg(F.avg(F.when(F.col("back") <= recent, F.col(column))).alias("recent"), F.avg(F.when(F.col("back") > recent, F.col(column))).alias("history"))
    out = out.withColumn("ratio", ratio(F.col("recent"), F.col("history")))
    status = F.when(F.col("ratio").isNull(), "ACTIVE").when(F.col("ratio") < 0, "DISABLED").when(F.col("ratio") < 0.5, "DECAYED").when(F.col("ratio") < 0.6, "MONITORING").otherwise("ACTIVE")
    return out.withColumn("status", status)


def ndcg(df: DataFrame, score: str, relevance: str, k: int = 5) -> DataFrame:
    """``date, ndcg``: discounted gain of the first ``k`` by score over the best possible."""
    by_score = F.row_number().over(by_date().orderBy(F.desc(score), "symbol"))
    by_gain = F.row_number().over(by_date().orderBy(F.desc(relevance), "symbol"))
    rows = df.withColumn("p", by_score).withColumn("q", by_gain).withColumn("gain", F.pow(F.lit(2.0), F.col(relevance)) - 1)
    total = lambda at: F.sum(F.when(F.col(at) <= k, F.col("gain") / F.log2(F.col(at) + 1.0)))
    return rows.groupBy("date").agg(ratio(total("p"), total("q")).alias("ndcg"))


def composite_score(df: DataFrame) -> DataFrame:
    """``composite`` of a report's ``mean_ic, ir, sharpe, annual, max_drawdown, monotonicity, turnover``; each part is between 0 and 1, a missing one a half.

    Drawdown and turnover count the less the larger they are.
    """
    c = F.col

    def part(x: Column) -> Column:
        return F.coalesce(x, F.lit(0.5))

    def sigmoid(x: Column) -> Column:
        return 1 / (1 + F.exp(-2 * x))

    within = F.when(c("monotonicity").isNotNull(), F.least(F.abs("monotonicity"), F.lit(1.0)))
    return df.withColumn(
        "composite",
        0.30 * part(sigmoid(c("mean_ic") / 0.05)) + 0.15 * part(sigmoid(c("ir") / 0.5)) + 0.20 * part(sigmoid(c("sharpe"))) + 0.15 * part(sigmoid(c("annual") / 0.30))
        + 0.10 * part(1 - sigmoid(F.abs("max_drawdown") / 0.20)) + 0.05 * part(within) + 0.05 * part(1 - sigmoid(c("turnover") / 10)),
    )
