"""Validation of strategies and factors: folds, cost and parameter sweeps, resampling, gates, and rule strategies."""

from __future__ import annotations

from math import e
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ops import ratio, with_columns, with_factors
from .accounts import replay_targets


def walk_forward(returns: DataFrame, column: str, train: int, test: int) -> DataFrame:
    """``fold, n, mean, sharpe``: consecutive test windows of ``test`` dates after the first ``train`` ones."""
    rows = returns.where(F.col(column).isNotNull()).select("date", F.col(column).alias("r"), F.row_number().over(W.orderBy("date")).alias("i"))
    folds = rows.where(F.col("i") > train).withColumn("fold", F.floor((F.col("i") - train - 1) / test).cast("int"))
    out = folds.groupBy("fold").agg(F.count("r").alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"))
    return out.select("fold", "n", "mean", (ratio(F.col("mean"), F.col("sd")) * float(np.sqrt(252))).alias("sharpe"))


def cost_sensitivity(book: DataFrame, cost: float, multipliers: tuple[float, ...] = (0.0, 0.5, 1.0, 2.0, 4.0)) -> DataFrame:
    """``multiplier, mean, positive``: net return of a book at several costs, in one pass."""
    rows = book.select("gross", "turnover", F.explode(F.array(*map(F.lit, multipliers))).alias("multiplier"))
    net = F.col("gross") - F.col("multiplier") * cost * F.col("turnover")
    return rows.withColumn("net", net).groupBy("multiplier").agg(F.avg("net").alias("mean"), F.avg((F.col("net") > 0).cast("double")).alias("positive"))


def parameter_grid(panel: DataFrame, fast: list[int], slow: list[int]) -> DataFrame:
    """``fast, slow, pnl, trades``: the dual-average strategy for every pair fast < slow, from one compiled batch of windows."""
    pairs = [(a, b) for a in fast for b in slow if a < b]
    means = {f"m{n}": f"gated_mean(close,{n},{n})" for n in sorted({*fast, *slow})}
    rows = panel.join(with_factors(panel, means, "single", fill=False), ["date", "symbol"])
    targets = F.array(*(F.struct(F.lit(a).alias("fast"), F.lit(b).alias("slow"), F.when(F.col(f"m{a}").isNull() | F.col(f"m{b}").isNull(), 0).when(F.col(f"m{a}") > F.col(f"m{b}"), 1).otherwise(-1).alias("target")) for a, b in pairs))
    rows = rows.select("date", "symbol", "open", F.explode(targets).alias("g")).select("date", "symbol", "open", "g.*")
    w = W.partitionBy("fast", "slow", "symbol").orderBy("date")
    position = F.coalesce(F.lag("target").over(w), F.lit(0))
    rows = rows.withColumn("position", position).withColumn("next_open", F.lead("open").over(w)).withColumn("held", F.coalesce(F.lag("position").over(w), F.lit(0)))
    pnl = F.coalesce(F.col("position") * (ratio(F.col("next_open"), F.col("open")) - 1), F.lit(0.0))
    return rows.withColumn("pnl", pnl).groupBy("fast", "slow").agg(F.sum("pnl").alias("pnl"), F.sum(F.abs(F.col("position") - F.col("held"))).alias("trades"))


def _series(rows: DataFrame, column: str) -> np.ndarray:
    """A series in the order of dates; it has one row for a date, and is what tasks draw from."""
    kept = rows.where(F.col(column).isNotNull()).orderBy("date").select(F.col(column).cast("double").alias("r"))
    return np.array([r.r for r in kept.collect()], float)


def monte_carlo(returns: DataFrame, column: str, paths: int = 500, seed: int = 42) -> DataFrame:
    """``path, total, drawdown``: returns drawn with replacement; each path has a seed of its own, and paths are what is spread out."""
    series = _series(returns, column)

    def run(batches):
        for part in batches:
            out = []
            for path in part["id"].tolist():
                draw = np.random.default_rng([seed, path]).choice(series, len(series)) if len(series) else series
                log_equity = np.concatenate([[0.0], np.cumsum(np.log1p(np.maximum(draw, -0.999999)))])
                total = float(np.expm1(log_equity[-1])) if log_equity[-1] < 700 else None  # beyond what a double holds
                out.append((path, total, float(np.expm1(log_equity - np.maximum.accumulate(log_equity)).min())))
            yield pd.DataFrame(out, columns=["path", "total", "drawdown"])

    return returns.sparkSession.range(paths).mapInPandas(run, "path long, total double, drawdown double")


def bootstrap_interval(ic: DataFrame, column: str = "rank_ic", draws: int = 500, seed: int = 42) -> DataFrame:
    """``low, high``: 2.5 and 97.5 % of the mean coefficient over draws of dates with replacement."""
    series = _series(ic, column)

    def run(batches):
        for part in batches:
            yield pd.DataFrame({"mean": [float(np.random.default_rng([seed, p]).choice(series, len(series)).mean()) if len(series) else None for p in part["id"].tolist()]})

    means = ic.sparkSession.range(draws).mapInPandas(run, "mean double")
    return means.agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"))


def shuffled(panel: DataFrame, replicates: int, seed: int = 42) -> DataFrame:
    """``panel`` with ``replicate``: 0 as it is, and 1 ... ``replicates``, in each of which a symbol's bars stand on its dates in another order.

    An order is that of a digest of seed, replicate, symbol and place, so it is the same in any partitioning, and all replicates are one
    job: the places of dates joined with the places of dealt bars.
    """
    values = [c for c in panel.columns if c not in ("date", "symbol")]
    numbered = panel.withColumn("place", F.row_number().over(W.partitionBy("symbol").orderBy("date")))
    dealt = numbered.select("symbol", *values, "place", F.explode(F.sequence(F.lit(0), F.lit(replicates))).alias("replicate"))
    digest = F.md5(F.concat_ws("-", F.lit(seed), "replicate", "symbol", "place"))
    order = F.when(F.col("replicate") == 0, "").otherwise(digest)
    dealt = dealt.withColumn("at", F.row_number().over(W.partitionBy("symbol", "replicate").orderBy(order, "place"))).drop("place")
    return dealt.join(numbered.select("symbol", F.col("place").alias("at"), "date"), ["symbol", "at"]).drop("at")


def shuffle_noise(panel: DataFrame, strategy, replicates: int = 100, seed: int = 42, capital: float = 1_000_000.0, cost: float = 0.0) -> DataFrame:
    """``symbol, n_shuffles, mean, std, p95, real, upper, no_lookahead``: a strategy's return against its returns on shuffled bars.

    ``strategy`` takes a panel and returns ``date, symbol, position``. A return above mean plus two deviations of the
    shuffled ones cannot come from the bars' shapes alone: it is marked for a look at what the strategy knows. Symbols of
    replicates are symbols of their own to the strategy, so any one will do, and all are run at once.
    """
    mark = F.concat_ws("#", "symbol", "replicate")
    rows = shuffled(panel, replicates, seed)
    named = rows.select(F.struct("symbol", "replicate").alias("of"), mark.alias("symbol"), *(c for c in rows.columns if c not in ("symbol", "replicate")))
    made = strategy(named.drop("of")).select("date", "symbol", F.col("position").cast("double").alias("target"))
    run = replay_targets(named.join(made, ["date", "symbol"]), capital, cost)
    totals = run.groupBy("symbol").agg((F.max_by("equity", "date") / capital - 1).alias("total"))
    totals = totals.join(named.select("symbol", "of").distinct(), "symbol").select("of.*", "total")
    noise = F.when(F.col("replicate") > 0, F.col("total"))
    out = totals.groupBy("symbol").agg(
        F.count(noise).alias("n_shuffles"), F.avg(noise).alias("mean"), F.stddev_pop(noise).alias("std"), F.percentile(noise, 0.95).alias("p95"), F.max(F.when(F.col("replicate") == 0, F.col("total"))).alias("real")
    )
    out = out.withColumn("upper", F.col("mean") + 2 * F.col("std"))
    return out.withColumn("no_lookahead", F.col("real") <= F.col("upper"))


def deflated_sharpe(sharpe: float, n: int, trials: int, variance: float, skew: float = 0.0, kurtosis: float = 3.0) -> float:
    """Chance that a Sharpe ratio (per period) is above what the best of ``trials`` would have by luck."""
    normal, gamma = NormalDist(), 0.5772156649015329
    best = variance**0.5 * ((1 - gamma) * normal.inv_cdf(1 - 1 / trials) + gamma * normal.inv_cdf(1 - 1 / (trials * e))) if trials > 1 else 0.0
    spread = 1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe**2
    return normal.cdf((sharpe - best) * (n - 1) ** 0.5 / spread**0.5) if spread > 0 and n > 1 else 0.0


def pair_signal(spread: DataFrame, window: int = 20, entry: float = 2.0, leave: float = 0.5) -> DataFrame:
    """``date, z, position``: short above ``entry`` deviations, long below, flat within ``leave``; in between the last state holds."""
    w = W.orderBy("date").rowsBetween(-(window - 1), 0)
    ready = F.count("close").over(w) >= window
    z = F.when(ready, ratio(F.col("close") - F.avg("close").over(w), F.stddev_samp("close").over(w)))
    rows = spread.select("date", z.alias("z"))
    mark = F.when(F.col("z") > entry, -1).when(F.col("z") < -entry, 1).when(F.abs("z") < leave, 0)
    held = F.last(mark, True).over(W.orderBy("date").rowsBetween(W.unboundedPreceding, 0))
    return rows.select("date", "z", F.coalesce(held, F.lit(0)).alias("position"))


def momentum_signal(panel: DataFrame, window: int = 20, threshold: float = 0.02) -> DataFrame:
    """``date, symbol, position``: the sign of the return over the window where it exceeds the threshold."""
    made = with_factors(panel, {"r": f"pct_change(close,{window})"}, "single", fill=False)
    return made.select("date", "symbol", F.when(F.col("r") > threshold, 1).when(F.col("r") < -threshold, -1).otherwise(0).alias("position"))


def third_buy_signal(panel: DataFrame, trend: int = 20, breakout: int = 10) -> DataFrame:
    """``date, symbol, buy``: the close is above its mean and no lower than the highest of the bars before."""
    made = with_factors(panel, {"up": f"close-gated_mean(close,{trend},{trend})", "over": f"close-delay(ts_max(high,{breakout}),1)"}, "single", fill=False)
    return made.select("date", "symbol", F.coalesce((F.col("up") > 0) & (F.col("over") >= 0), F.lit(False)).alias("buy"))


def bollinger_recover(panel: DataFrame, window: int = 20, width: float = 2.0, within: int = 5, stop: float = 0.05) -> DataFrame:
    """``date, symbol, position``: long when the close comes back over the lower band within some bars of leaving it, short likewise above.

    A position ends at the middle, or beyond the stop. Bands are windows; what is held depends on what was
    held before, so a symbol's bars are folded in order.
    """
    spread = ((window - 1) / window) ** 0.5
    made = with_columns(panel, {"mid": f"gated_mean(close,{window},{window})", "sd": f"gated_std(close,{window},{window})", "ready": f"gated_mean(close,{window + 5},{window + 5})"}, "single")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("date")
        away: dict[int, int | None] = {1: None, -1: None}
        held, entry, out = 0, 0.0, []
        for close, mid, sd, ready in zip(part["close"].tolist(), part["mid"].tolist(), part["sd"].tolist(), part["ready"].tolist(), strict=True):
            back = {}
            if ready is not None and ready == ready:
                for side in (1, -1):
                    beyond = side * (mid - close) - width * sd * spread
                    if beyond > 0:
                        away[side] = 0
                    elif away[side] is not None:
                        away[side] += 1
                        back[side] = away[side] <= within and beyond < 0
                        if back[side]:
                            away[side] = None
                if held and (held * (close - mid) < 0 or held * (close / entry - 1) < -stop):
                    held = 0
                if not held and any(back.values()):
                    held, entry = (1 if back.get(1) else -1), close
            out.append(held)
        return pd.DataFrame({"date": part["date"], "symbol": part["symbol"], "position": out})

    return made.select("date", "symbol", "close", "mid", "sd", "ready").groupBy("symbol").applyInPandas(run, "date date, symbol string, position int")


def first_buy(panel: DataFrame, trend: int = 60, lows: int = 20, speed: int = 10) -> DataFrame:
    """``date, symbol, position``: long where, under the trend, a new low comes with more momentum than the low before it.

    It ends above the trend, or under the low that it was bought at. Folded by symbol, as lows are compared with remembered ones.
    """
    made = with_columns(panel, {"mean": f"gated_mean(close,{trend},{trend})", "rate": f"momentum(close,{speed})"}, "single")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("date")
        close, low, mean, rate = (part[c].to_numpy(float) for c in ("close", "low", "mean", "rate"))
        held, bought, known = 0, np.inf, None
        out = np.zeros(len(part), np.int32)
        for t in range(trend + speed + 4, len(part)):
            at = t - int(np.argmin(low[t - lows + 1 : t + 1][::-1]))
            now = (low[at], rate[at])
            if known is not None and close[t] < mean[t] and now[0] < known[0] and now[1] > known[1]:
                held, bought, known = 1, now[0], now
            else:
                known = now if known is None or now[0] < known[0] else known
                if close[t] > mean[t] or close[t] < bought:
                    held = 0
            out[t] = held
        return pd.DataFrame({"date": part["date"], "symbol": part["symbol"], "position": out})

    return made.select("date", "symbol", "close", "low", "mean", "rate").groupBy("symbol").applyInPandas(run, "date date, symbol string, position int")


def look_ahead(now: DataFrame, ahead: DataFrame, column: str = "rank_ic", most: float = 0.9) -> DataFrame:
    """``now, ahead, suspect``: a factor that knows the same day's return, but not the next one's, looks ahead."""
    a, b = now.agg(F.avg(F.abs(column)).alias("now")), ahead.agg(F.avg(F.abs(column)).alias("ahead"))
    return a.join(b).withColumn("suspect", F.coalesce((F.col("now") > most) | (F.col("ahead") > most), F.lit(False)))  # one row each


def prefix_leaks(panel: DataFrame, make, cuts: list, tolerance: float = 1e-9) -> DataFrame:
    """``cut, date, symbol, full, known``: where what ``make`` gives on the whole panel is not what it gives on the dates up to a cut.

    ``make`` takes a panel and returns ``date, symbol, value``. What looks back only cannot tell whether there are later dates, so any row is
    a leak, whatever the code looks like. Each cut is a run of its own, as values across symbols share their dates; a few cuts will do.
    """
    full = make(panel).select("date", "symbol", F.col("value").alias("full"))
    out = None
    for cut in cuts:
        known = make(panel.where(F.col("date") <= F.lit(cut))).select("date", "symbol", F.col("value").alias("known"))
        both = full.where(F.col("date") <= F.lit(cut)).join(known, ["date", "symbol"], "full_outer")
        apart = F.abs(F.col("full") - F.col("known")) > tolerance * F.greatest(F.lit(1.0), F.abs("full"))
        bad = both.where(F.coalesce(apart, ~F.col("full").eqNullSafe(F.col("known")))).select(F.lit(cut).alias("cut"), "date", "symbol", "full", "known")
        out = bad if out is None else out.unionByName(bad)
    return out


def interval_issues(code: str, interval: str) -> list[str]:
    """What in a strategy's source does not go with the interval of its bars (``1d``, or less than a day).

    Daily bars have no hour to look at, and no view of days beside them; bars within a day should be looked at by time, or by day.
    Source that cannot be parsed has no issues of this kind.
    """
    import ast

    try:
        nodes = list(ast.walk(ast.parse(code)))
    except SyntaxError:
        return []
    read = {n.attr for n in nodes if isinstance(n, ast.Attribute)}
    clock, views = bool(read & {"hour", "minute", "second"}), bool(read & {"daily", "mtf"})
    by_day = views or "date" in read or any(isinstance(n, ast.Name) and "day" in n.id.lower() for n in nodes)
    if interval == "1d":
        found = [("reads the time of day, which daily bars do not have", clock), ("asks for views of days, which daily bars are themselves", views)]
    else:
        found = [("looks at neither time nor day, on bars within a day", not clock and not by_day)]
    return [text for text, holds in found if holds]


def promotion(reports: DataFrame) -> DataFrame:
    """``reasons, promoted``: which gates a run misses: Sharpe 1, drawdown 15 %, 30 days, Calmar 1, win rate 45 %."""
    gates = {"sharpe": F.col("sharpe") < 1, "drawdown": F.col("max_drawdown") < -0.15, "days": F.col("days") < 30, "calmar": F.col("calmar") < 1, "win_rate": F.col("win_rate") < 0.45}
    reasons = F.array_compact(F.array(*(F.when(F.coalesce(miss, F.lit(True)), F.lit(name)) for name, miss in gates.items())))
    return reports.withColumn("reasons", F.array_join(reasons, ",")).withColumn("promoted", F.col("reasons") == "")
