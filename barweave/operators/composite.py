"""Composites of factors, fitted on earlier dates and judged on later ones.

Everything starts from :func:`parted`: formulas with the history before a date, and forward returns that end in the part (train,
valid, test) in which they begin. What is fitted (weights, selections) is an aggregate over the rows of one part; it is
applied to others as a one-row model. So no date of another part can move it.

Many factors are evaluated side by side in long form (``name, date, symbol, x, fwd``): one exchange for all of them.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.factors import FAMILIES
from ..functions.ops import ratio, steady, with_columns, with_factors
from .attribution import least_variance_weights
from .research import _corr, standardised, time_split

SCHEMES = ("equal", "icir", "inverse_variance", "least_variance")
YEAR = 252.0


def parted(panel: DataFrame, formulas: dict[str, str], h: int = 1, train: float = 0.6, valid: float = 0.2) -> DataFrame:
    """``date, symbol, part, close, fwd`` and every formula; a return that would end in another part is NULL."""
    rows = time_split(with_columns(panel, formulas).select("date", "symbol", "close", *formulas), train, valid)
    ahead = F.lead("close", h).over(W.partitionBy("symbol", "part").orderBy("date"))
    return rows.withColumn("fwd", ratio(ahead, F.col("close")) - 1)


def factor_scores(panel: DataFrame, name: str | None = None, formula: str | None = None) -> DataFrame:
    """``date, symbol, score``: a named factor of the library across symbols, or any formula (``ref`` counts as ``delay``)."""
    if formula is None:
        known = {n: f for formulas, dialect in FAMILIES.values() if dialect == "panel" for n, f in formulas.items()}
        if name not in known:
            raise KeyError(f"no factor {name!r}")
        formula = known[name]
    return with_factors(panel, {"score": re.sub(r"\bref\(", "delay(", formula)}, fill=False)


def each(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Long form of the columns ``names``: ``name, date, symbol, part, x, fwd``, without missing values of either."""
    made = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").alias("x")) for n in names))).alias("e")
    out = rows.where(F.col("fwd").isNotNull()).select("date", "symbol", "part", "fwd", made)
    return out.select("e.name", "date", "symbol", "part", "e.x", "fwd").where(F.col("x").isNotNull())


def daily_coefficients(long: DataFrame, least: int = 3) -> DataFrame:
    """``name, part, date, n, ic``: rank coefficient of every factor at each date with ``least`` pairs."""

    def place(c: str) -> Column:
        s = steady(F.col(c))
        return F.rank().over(W.partitionBy("name", "date").orderBy(s)) + (F.count(F.lit(1)).over(W.partitionBy("name", "date", s)) - 1) / 2

    ranked = long.select("name", "part", "date", place("x").alias("rx"), place("fwd").alias("ry"))
    daily = ranked.groupBy("name", "part", "date").agg(F.count(F.lit(1)).alias("n"), _corr("rx", "ry").alias("ic"))
    return daily.where(F.col("n") >= least)


def coefficient_statistics(daily: DataFrame) -> DataFrame:
    """``name, part, n, mean, std, ir``."""
    x = F.col("ic")
    out = daily.where(x.isNotNull()).groupBy("name", "part").agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))
    return out.withColumn("ir", ratio(F.col("mean"), F.col("std")))


def _gram(rows: DataFrame, names: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Correlations and variances of standardised columns, from one aggregation of k (k + 1) / 2 sums; missing values are the mean."""
    z = standardised(rows.select("date", "symbol", *names), list(names)).select(*(F.coalesce(F.col(f"`{n}`"), F.lit(0.0)).alias(n) for n in names))
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = z.agg(F.array(*(F.coalesce(F.covar_samp(names[i], names[j]), F.lit(0.0)) for i, j in pairs)).alias("c")).first().c
    cov = np.zeros((len(names), len(names)))
    for (i, j), c in zip(pairs, row, strict=True):
        cov[i, j] = cov[j, i] = c
    variances = np.diag(cov).copy()
    sd = np.sqrt(np.where(variances > 0, variances, 1.0))
    return cov / np.outer(sd, sd), variances


def fitted_weights(rows: DataFrame, names: Sequence[str], scheme: str = "icir", part: str = "train") -> DataFrame:
    """``name, weight``: long-only weights of sum one, from the rows of ``part`` alone.

    ``equal``; ``icir``: mean over deviation of the daily coefficient, none below 0; ``inverse_variance`` of the
    standardised factor; ``least_variance``: of the standardised factors' covariances, none below 0. Where nothing is above 0, weights are equal.
    """
    spark = rows.sparkSession
    fit = rows.where(F.col("part") == part)
    if scheme not in SCHEMES:
        raise ValueError(f"no scheme {scheme!r}")
    if scheme == "least_variance":
        found = least_variance_weights(*_gram(fit, names))
        return spark.createDataFrame([(n, float(w)) for n, w in zip(names, found, strict=True)], "name string, weight double")
    all_names = spark.createDataFrame([(n,) for n in names], "name string")
    if scheme == "equal":
        raw = all_names.withColumn("raw", F.lit(1.0))
    elif scheme == "icir":
        stats = coefficient_statistics(daily_coefficients(each(fit, names)))
        raw = all_names.join(stats, "name", "left").select("name", F.greatest(F.lit(0.0), F.coalesce("ir", F.lit(0.0))).alias("raw"))
    else:
        z = standardised(fit.select("date", "symbol", *names), list(names))
        one = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.coalesce(F.col(f"`{n}`"), F.lit(0.0)).alias("z")) for n in names))).alias("e")
        v = F.var_samp("z")
        stats = z.select(one).select("e.*").groupBy("name").agg(F.when(v > 0, 1 / v).otherwise(0.0).alias("raw"))
        raw = all_names.join(stats, "name", "left").select("name", F.coalesce("raw", F.lit(0.0)).alias("raw"))
    total = F.sum("raw").over(W.partitionBy())  # one row a factor
    return raw.select("name", F.when(total > 0, F.col("raw") / F.when(total > 0, total)).otherwise(1.0 / max(1, len(names))).alias("weight"))


def composed(rows: DataFrame, weights: DataFrame, names: Sequence[str]) -> DataFrame:
    """``rows`` with ``value``: the weighted sum of the date's standardised factors, missing ones as 0."""
    model = weights.agg(F.map_from_entries(F.collect_list(F.struct("name", "weight"))).alias("model"))
    others = [c for c in rows.columns if c not in names]
    z = standardised(rows, list(names)).crossJoin(F.broadcast(model))  # one row on the right
    value = sum((F.coalesce(F.col(f"`{n}`"), F.lit(0.0)) * F.coalesce(F.try_element_at("model", F.lit(n)), F.lit(0.0)) for n in names), F.lit(0.0))
    return z.select(*others, value.alias("value"))


def books(long: DataFrame, k: int = 5, cost: float = 0.0, long_short: bool = True) -> DataFrame:
    """``name, date, gross, turnover, net, n``: for every factor the top bucket held long and, with ``long_short``, the bottom one short.

    Buckets, weights and turnover are as in :func:`barweave.operators.research.long_short`; all factors are
    one job. Turnover counts from each factor's traded date to its next.
    """
    by = W.partitionBy("name", "date")
    place, n = F.row_number().over(by.orderBy(steady(F.col("x")), "symbol")), F.count(F.lit(1)).over(by)
    bucket = F.greatest(F.lit(0), F.ceil((place - 1) * k / F.when(n > 1, n - 1)) - 1)
    held = long.select("name", "date", "symbol", "fwd", bucket.alias("bucket"), n.alias("n_date")).where(F.col("n_date") >= k)
    side = F.when(F.col("bucket") == k - 1, 1.0)
    if long_short:
        side = side.when(F.col("bucket") == 0, -1.0)
    held = held.withColumn("side", side).where(F.col("side").isNotNull())
    weight = F.col("side") / F.count(F.lit(1)).over(W.partitionBy("name", "date", "side"))
    held = held.select("name", "date", "symbol", weight.alias("weight"), F.col("fwd").alias("r"))
    dates = held.groupBy("name", "date").agg(F.sum(F.col("weight") * F.col("r")).alias("gross"), F.count(F.lit(1)).alias("n"))
    dates = dates.withColumn("seq", F.row_number().over(W.partitionBy("name").orderBy("date")))
    now = held.join(dates.select("name", "date", "seq"), ["name", "date"]).select("name", "seq", "symbol", "weight")
    before = now.select("name", (F.col("seq") + 1).alias("seq"), "symbol", F.col("weight").alias("old"))
    change = F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))
    moved = now.join(before, ["name", "seq", "symbol"], "full_outer").groupBy("name", "seq").agg(F.sum(change).alias("moved"))
    turnover = F.when(F.col("seq") == 1, 0.0).otherwise(F.col("moved") / 2)
    out = dates.join(moved, ["name", "seq"]).withColumn("turnover", turnover)
    return out.select("name", "date", "gross", "turnover", (F.col("gross") - cost * F.col("turnover")).alias("net"), "n")


def book_report(book: DataFrame) -> DataFrame:
    """One row for each ``name``: periods, and total, Sharpe ratio, largest drawdown and Calmar ratio before and after costs, mean turnover, cost share.

    ``cost_ratio`` is what costs took of the total return before costs; ``cost_bps`` the same in hundredths of a per cent.
    """
    w = W.partitionBy("name").orderBy("date")
    floor = F.lit(-0.999999)
    path = book
    for c in ("gross", "net"):
        path = path.withColumn(f"e_{c}", F.exp(F.sum(F.log1p(F.greatest(F.col(c), floor))).over(w)))
    for c in ("gross", "net"):
        path = path.withColumn(f"d_{c}", F.col(f"e_{c}") / F.greatest(F.lit(1.0), F.max(f"e_{c}").over(w)) - 1)

    def of(c: str, prefix: str) -> list[Column]:
        return [
            (F.max_by(f"e_{c}", "date") - 1).alias(f"{prefix}total"), (ratio(F.avg(c), F.stddev_samp(c)) * float(np.sqrt(YEAR))).alias(f"{prefix}sharpe"), F.min(f"d_{c}").alias(f"{prefix}max_drawdown"),
        ]

    out = path.groupBy("name").agg(F.count(F.lit(1)).alias("n"), *of("gross", ""), *of("net", "net_"), F.avg("turnover").alias("turnover"))
    for prefix in ("", "net_"):
        annual = F.when(F.col(f"{prefix}total") > -1, F.pow(1 + F.col(f"{prefix}total"), YEAR / F.col("n")) - 1).otherwise(-1.0)
        out = out.withColumn(f"{prefix}calmar", ratio(annual, F.abs(f"{prefix}max_drawdown")))
    share = ratio(F.greatest(F.lit(0.0), F.col("total") - F.col("net_total")), F.abs("total"))
    return out.withColumn("cost_ratio", F.coalesce(share, F.lit(0.0))).withColumn("cost_bps", F.col("cost_ratio") * 1e4)


def composite_backtest(rows: DataFrame, names: Sequence[str], scheme: str = "icir", k: int = 5, cost: float = 0.0, long_short: bool = True, part: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Weights from the train rows of :func:`parted`; the composite's daily coefficients, and its book, on ``part``.

    Returns ``name, weight``; ``name, part, date, n, ic`` of every factor and of ``composite``; and the book.
    """
    weights = fitted_weights(rows, names, scheme)
    later = rows.where(F.col("part") == part)
    value = composed(later.select("date", "symbol", "part", "fwd", *names), weights, names)
    long = each(value.withColumnRenamed("value", "composite"), ["composite"])
    return weights, daily_coefficients(each(later, names).unionByName(long)), books(long, k, cost, long_short)
