"""Upkeep of what research leaves behind: tables of files, trials, runs, accounts and logs, and verdicts on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ops import ratio

# Markets by exchange, and the name of all others.
MARKETS = {"期货": "CFFEX SHFE DCE CZCE INE GFEX".split(), "A股": "SSE SZSE".split(), "港股": ["HKEX"], "美股": "NASDAQ NYSE AMEX COMEX CME NYMEX CBOT".split()}
OTHER_MARKET = "其他"


def market(exchange: Column) -> Column:
    """The market of an exchange."""
    out = F.lit(OTHER_MARKET)
    for name, places in MARKETS.items():
        out = F.when(F.upper(exchange).isin(*places), name).otherwise(out)
    return out


def symbol_parts(full: Column) -> tuple[Column, Column]:
    """Symbol and exchange of ``symbol.exchange``; the last dot parts them, and without one there is neither."""
    return tuple(F.nullif(F.regexp_extract(full, r"^(.*)\.([^.]+)$", i), F.lit("")) for i in (1, 2))


def full_symbol(symbol: Column, exchange: Column) -> Column:
    return F.concat(symbol, F.lit("."), exchange)


def narrowed(files: DataFrame, exchange: str | None = None, market_name: str | None = None, interval: str | None = None, fresh: str | None = None, text: str | None = None) -> DataFrame:
    """The rows of ``files`` that pass all filters that are given; ``text`` may stand anywhere in the symbol, in any case."""
    out = files
    for column, value in (("exchange", exchange), ("interval", interval), ("class", fresh)):
        if value is not None:
            out = out.where(F.col(column) == value)
    if market_name is not None:
        out = out.where(market(F.col("exchange")) == market_name)
    return out.where(F.contains(F.lower("symbol"), F.lit(text.lower()))) if text else out


def paged(rows: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """The rows of one page (from 1) in the order given, each with ``total`` and ``pages``. ``order`` must leave no ties."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))  # one row
    out = rows.orderBy(*order).offset((max(page, 1) - 1) * size).limit(size).join(F.broadcast(total))
    return out.withColumn("pages", F.ceil(F.col("total") / F.lit(size)).cast("long"))


def first_of(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first ``max(1, k)`` rows in the order given: a list's top, the stalest, the most recent."""
    return rows.orderBy(*order).limit(max(1, k))


def ranked_trials(trials: DataFrame) -> DataFrame:
    """``trials`` with ``place``: by IC outside the sample, else inside, else -1, the highest first; equal ones by name."""
    key = F.coalesce("test_ic", "train_ic", F.lit(-1.0))
    return trials.withColumn("place", F.row_number().over(W.orderBy(F.desc(key), "name")))  # trials are few: one order of all


def largest_sum(rows: DataFrame, group: list[str], member: str, value: str) -> DataFrame:
    """For each group the member with the largest sum of ``value`` (ties: the first by name), and that sum."""
    sums = rows.groupBy(*group, member).agg(F.sum(value).alias("total"))
    place = F.row_number().over(W.partitionBy(*group).orderBy(F.desc("total"), member))
    return sums.withColumn("_place", place).where("_place = 1").drop("_place")


def trials_with_runs(trials: DataFrame, runs: DataFrame) -> DataFrame:
    """Every trial with the idea and the market of its run; a run's latest row counts, and a trial may have none."""
    last = runs.groupBy("run_id").agg(F.max_by(F.struct("idea", "market"), "created").alias("r")).select("run_id", "r.*")
    return trials.join(last, "run_id", "left")


def contributions(weights: DataFrame, steps: DataFrame) -> DataFrame:
    """``weights`` (``expression, weight``) with the IC of their search step and ``contribution``, their product over the sum of all of them."""
    rows = weights.join(steps.groupBy("expression").agg(F.max("ic").alias("ic")), "expression", "left").withColumn("part", F.col("weight") * F.coalesce("ic", F.lit(0.0)))
    total = rows.agg(F.sum(F.abs("part")).alias("all"))  # one row
    return rows.join(F.broadcast(total)).select("expression", "weight", "ic", ratio(F.col("part"), F.col("all")).alias("contribution"))


def logged(log: DataFrame, new: DataFrame, most: int = 200) -> DataFrame:
    """The refresh log with new entries, the newest ``most`` of them; the length is the feature."""
    return log.unionByName(new).orderBy(F.desc("at"), "key").limit(most)


def with_last_refresh(files: DataFrame, log: DataFrame) -> DataFrame:
    """``files`` with the latest log row of their key (ties: the one with more rows), if there is one."""
    last = log.groupBy("key").agg(F.max_by(F.struct("at", "rows", "status"), F.struct("at", "rows", "status")).alias("l"))
    return files.join(last, "key", "left").select(*files.columns, F.col("l.at").alias("refreshed"), F.col("l.rows").alias("refreshed_rows"), F.col("l.status").alias("status"))


def account_reconciled(books: DataFrame, tolerance: float = 1.0, share: float = 0.001) -> DataFrame:
    """``books`` (``local, remote`` equity) with ``delta`` and ``ok``: within the larger of an amount and a share of the remote one; NULL if either is unknown."""
    delta = F.col("remote") - F.col("local")
    bound = F.greatest(F.lit(tolerance), F.abs("remote") * share)
    return books.withColumn("delta", delta).withColumn("ok", F.abs("delta") <= bound)


def returns_correlation(returns: DataFrame) -> DataFrame:
    """``a, b, correlation`` of the returns (``strategy, date, r``) of every two strategies on common dates; 0 where it is undefined.

    Strategies are few and meet on dates, so a date holds as many pairs as strategies have pairs.
    """
    other = returns.select(F.col("strategy").alias("b"), "date", F.col("r").alias("y"))
    both = returns.select(F.col("strategy").alias("a"), "date", F.col("r").alias("x")).join(other, "date").where("a < b")
    spread = F.stddev_samp("x") * F.stddev_samp("y")
    value = F.when(spread > 1e-12, F.covar_samp("x", "y") / spread)
    return both.where("x IS NOT NULL AND y IS NOT NULL").groupBy("a", "b").agg(F.coalesce(value, F.lit(0.0)).alias("correlation"))


def validation_summary(results: DataFrame) -> DataFrame:
    """``strategy, n, passed, pass_rate, mean_return, mean_sharpe, worst_drawdown, best`` of results by symbol."""
    return results.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("passed"), F.avg(F.col("passed").cast("int")).alias("pass_rate"), F.avg("total_return").alias("mean_return"),
        F.avg("sharpe").alias("mean_sharpe"), F.min("max_drawdown").alias("worst_drawdown"), F.max_by("symbol", F.struct("total_return", "symbol")).alias("best"),
    )


def overfit(reports: DataFrame, drop: float = 0.5) -> DataFrame:
    """``reports`` (``train_sharpe, test_sharpe, train_return, test_return``) with ``overfit``: the Sharpe ratio fell below a share of itself, or a gain became a loss."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)).otherwise(0.0)
    a, b, x, y = (finite(c) for c in ("train_sharpe", "test_sharpe", "train_return", "test_return"))
    return reports.withColumn("overfit", ((a > 0) & (b < drop * a)) | ((x > 0) & (y <= 0)))


# What health checks ask for.
HEALTH = {"n": 250, "ic": 0.02, "ir": 0.5, "turnover": 60.0, "drawdown": 0.5, "coverage": 0.8}


def health(reports: DataFrame, limits: dict[str, float] = HEALTH) -> DataFrame:
    """``reports`` (``n, ic, ir, turnover, drawdown, coverage``) with the five checks and ``healthy``: none of those that could be made failed.

    A check whose figure is missing is NULL and counts for nothing; only the number of rows must be there.
    """
    ok = {
        "enough": F.coalesce("n", F.lit(0)) >= limits["n"], "significant": (F.abs("ic") >= limits["ic"]) & (F.abs("ir") >= limits["ir"]), "turnover_ok": F.col("turnover") <= limits["turnover"],
        "drawdown_ok": F.abs("drawdown") <= limits["drawdown"], "covered": F.col("coverage") >= limits["coverage"],
    }
    out = reports.withColumns(ok)
    healthy = F.lit(True)
    for name in ok:
        healthy = healthy & F.coalesce(name, F.lit(True))
    return out.withColumn("healthy", healthy)


# What a formula's text says about it.
TAGS = (("delta", "momentum"), ("-delta", "mean_reversion"), ("std", "volatility"), ("corr", "price_volume"), ("rank", "rank"), ("mean(close,1)-close", "term_structure"))


def rule_tags(expression: Column) -> Column:
    """At most six tags by what occurs in a formula; ``generic`` if none does."""
    text = F.lower(F.coalesce(expression, F.lit("")))
    found = F.array_compact(F.array(*(F.when(F.contains(text, F.lit(part)), tag) for part, tag in TAGS)))
    return F.when(F.size(found) > 0, F.slice(found, 1, 6)).otherwise(F.array(F.lit("generic")))


def complexity(expression: Column) -> Column:
    """The calls and groups in a formula: its opening parentheses."""
    return F.length(expression) - F.length(F.replace(expression, F.lit("("), F.lit("")))


def cache_key(market_name: Column, forward: Column, fingerprint: Column, expression: Column) -> Column:
    """What a report on a formula is kept under."""
    return F.concat_ws("|", market_name, F.concat(F.lit("f"), forward.cast("string")), fingerprint, expression)


def positive_share(series: Column, least: int = 20) -> Column:
    """The share of values above 0 of an array; NULL with fewer than ``least`` values."""
    values = F.filter(series, lambda v: v.isNotNull() & ~F.isnan(v))
    return F.when(F.size(values) >= least, F.size(F.filter(values, lambda v: v > 0)) / F.size(values))


def halves_half_life(series: Column, least: int = 10) -> Column:
    """How long an IC takes to halve, by the means of the two halves of its series; infinite where it does not fall, NULL where it is not positive."""
    values = F.filter(series, lambda v: v.isNotNull() & ~F.isnan(v))
    n = F.size(values)
    half = F.floor(n / F.lit(2)).cast("int")
    mean = lambda part: F.aggregate(part, F.lit(0.0), lambda a, v: a + v) / F.size(part)
    first, second = mean(F.slice(values, F.lit(1), half)), mean(F.slice(values, half + 1, n - half))
    life = F.when(second >= first, float("inf")).otherwise(half / F.log2(first / second))
    return F.when(n >= least, F.when((first > 0) & (second > 0), life))


def judged(trials: DataFrame) -> DataFrame:
    """``trials`` with ``status``: rejected, active or verified, by thresholds in a fixed order.

    ``train_ic, test_ic, test_sharpe, turnover`` and ``ics``, the IC of each date outside the sample.
    """
    share, life = positive_share(F.col("ics")), halves_half_life(F.col("ics"))
    # The thresholds of the verdict.
    ic, sharpe = F.col("test_ic"), F.col("test_sharpe")
    status = (
        F.when(ic.isNull() | (ic < 0.02), "rejected").when(sharpe < 0, "rejected").when(share < 0.52, "rejected").when(life < 2, "rejected").when(F.col("turnover") > 30, "rejected")
        .when((ic >= 0.03) & (sharpe >= 0.5) & (F.col("train_ic") > 0), "verified").otherwise("active")
    )
    return trials.withColumn("status", status)


def keep_first(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row for each key, the one with the smallest ``seq``: what an in-memory store keeps of repeated times."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*others), seq).alias("first")).select(*keys, "first.*")


def range_scan(bars: DataFrame, symbol: str, start: str, end: str, most: int | None = None) -> DataFrame:
    """A symbol's bars from ``start`` to ``end`` in order of time, at most so many; filters reach the scan."""
    out = bars.where((F.col("symbol") == symbol) & F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).orderBy("date")
    return out.limit(most) if most is not None else out


def covered(bars: DataFrame, start: str, end: str) -> DataFrame:
    """``symbol, hit``: whether a symbol's stored bars reach from ``start`` to ``end``; one that does not is a miss, to be fetched anew."""
    out = bars.groupBy("symbol").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    return out.select("symbol", ((F.col("first") <= F.lit(start).cast("date")) & (F.col("last") >= F.lit(end).cast("date"))).alias("hit"))


def unified(stored: DataFrame, fetched: DataFrame, start: str, end: str) -> DataFrame:
    """Bars from ``start`` to ``end``: a symbol's stored ones where they cover all of it, else the fetched ones."""
    hits = covered(stored, start, end).where("hit").select("symbol")
    both = stored.join(hits, "symbol", "left_semi").unionByName(fetched.join(hits, "symbol", "left_anti"))
    return both.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
