"""The operators of formulas as Spark columns.

Time-series operators look at the last n rows of a symbol (``n`` rows of the panel, gaps included, where
the panel has them materialised); cross-sectional ones at a date. Missing values are NULL throughout:
division by zero, infinities and NaN become NULL where they arise. ``mp`` is the least number of values
that a window needs.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .formula import Node, build, parse, plan

SYMBOL, DATE, ROW = "symbol", "date", "row_no"


def clean(x: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def ratio(a: Column, b: Column) -> Column:
    return a / F.when(b != 0, b)


#: Values that differ by less than about the eleventh digit are ties: below each bound, the power of ten that they are
#: rounded to. Bounds go from 1e-25 to 1e26 in steps of a thousand; what is beyond them is not rounded.
TIES = tuple((float(f"1e{at}"), at - 11) for at in range(-25, 27, 3))


def steady(x: Column) -> Column:
    """``x`` rounded to nine to eleven digits, so that ranks do not depend on the last bits of a sum, however small it is.

    The input is computed once (it may be a window of windows), and its size is found by halving the bounds.
    """
    def rounded(v: Column, power: int) -> Column:
        scale = F.lit(float(f"1e{abs(power)}"))
        return F.rint(v / scale) * scale if power >= 0 else F.rint(v * scale) / scale

    def among(v: Column, low: int, high: int) -> Column:
        """For a value that is not below the bounds before ``low``; ``high`` bounds are all there are."""
        if low == high:
            return rounded(v, TIES[low][1]) if low < len(TIES) else v
        middle = (low + high) // 2
        return F.when(F.abs(v) < TIES[middle][0], among(v, low, middle)).otherwise(among(v, middle + 1, high))

    return let(x, lambda v: F.when(v == 0, F.lit(0.0)).otherwise(among(v, 0, len(TIES))))


def trailing(n: int) -> W:
    return W.partitionBy(SYMBOL).orderBy(DATE).rowsBetween(-(n - 1), 0)


def so_far() -> W:
    return W.partitionBy(SYMBOL).orderBy(DATE).rowsBetween(W.unboundedPreceding, 0)


def in_time() -> W:
    return W.partitionBy(SYMBOL).orderBy(DATE)


def across() -> W:
    return W.partitionBy(DATE)


def gated(x: Column, counted: Column, w: W, mp: int) -> Column:
    return F.when(F.count(counted).over(w) >= mp, x)


def frame(x: Column, n: int) -> Column:
    """The values of the window as an array, NULLs kept."""
    return F.transform(F.collect_list(F.struct(x.alias("v"))).over(trailing(n)), lambda e: e["v"])


def let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` computed once for a row."""
    return F.transform(F.array(value), body)[0]


def share_above(x: Column, n: int) -> Column:
    """Share of the window's rows that are greater than its last value; 0 where that is NULL."""
    window = F.collect_list(F.struct(steady(x).alias("v"))).over(trailing(n))

    def share(values: Column) -> Column:
        last = F.element_at(values, -1)["v"]
        return F.size(F.filter(values, lambda e: F.coalesce(e["v"] > last, F.lit(False)))) / F.size(values)

    return let(window, share)


def arg_extreme(x: Column, n: int, best) -> Column:
    """n less the place (from 1) of the first extreme value; of the first NULL, if there is one."""
    def place(values: Column) -> Column:
        gap = F.array_position(F.transform(values, lambda v: v.isNull()), True)
        return F.lit(float(n)) - F.when(gap > 0, gap).otherwise(F.array_position(values, best(values)))

    return let(frame(steady(x), n), place)


def covariance(a: Column, b: Column, w: W) -> Column:
    """Sample covariance, with the arguments in the order in which Spark adds up the products that the SQL's ``covar_samp(a, b)`` does.

    Either order is right; they differ in what rounding leaves of a covariance that is exactly 0, by which ranks may go.
    """
    return F.covar_samp(b, a).over(w)


def co(a: Column, b: Column, w: W, mp: int, what: str) -> Column:
    """Covariance or correlation over the rows of a window where both are there."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    value = covariance(x, y, w)
    if what == "corr":
        value = ratio(value, F.stddev_samp(x).over(w) * F.stddev_samp(y).over(w))
    return gated(value, x, w, mp)


def ewm(x: Column, alpha: float) -> Column:
    """Exponential mean with weight ``alpha`` on the newest value, started at the first one.

    A gap lets the older weight decay and repeats the mean. Rows whose weight is below 1e-17 are left out,
    so the work for a row is bounded by a multiple of 1 / alpha however long a series is.
    """
    n = ceil(40 / alpha) + 1
    start = F.struct(F.lit(None).cast("double").alias("mean"), F.lit(1.0).alias("weight"))

    def step(s: Column, v: Column) -> Column:
        old = s["weight"] * (1 - alpha)
        mean = F.when(v.isNull(), s["mean"]).when(s["mean"].isNull(), v).otherwise((old * s["mean"] + alpha * v) / (old + alpha))
        return F.struct(mean.alias("mean"), F.when(v.isNull() & s["mean"].isNotNull(), old).otherwise(1.0).alias("weight"))

    return F.aggregate(frame(x, n), start, step, lambda s: s["mean"])


def slope(y: Column, n: int) -> Column:
    """Least-squares slope against the row number; NULL if the window has a gap."""
    w, t = trailing(n), F.col(ROW).cast("double")
    value = ratio(covariance(t, y, w), F.var_samp(t).over(w))
    full = F.count(y).over(w) == F.count(F.lit(1)).over(w)
    return gated(F.when(full, value), y, w, max(2, n // 2))


def decay(x: Column, n: int) -> Column:
    """Linearly weighted sum, n down to 1 back in time, over n (n + 1) / 2; NULL if the window has a gap."""
    w, t = trailing(n), F.col(ROW).cast("double")
    total = F.sum(x * t).over(w) + (n - t) * F.sum(x).over(w)
    full = F.count(x).over(w) == F.count(F.lit(1)).over(w)
    return F.when(full, total / (n * (n + 1) / 2))


def moment(x: Column, n: int, mp: int, what: str) -> Column:
    w = trailing(n)
    m = F.count(x).over(w).cast("double")
    spread = F.var_samp(x).over(w) > 1e-24
    if what == "kurt":
        return F.when((m >= mp) & spread, F.kurtosis(x).over(w))
    factor = m * m / F.when(m > 2, (m - 1) * (m - 2)) if what == "skew" else F.sqrt(m * (m - 1)) / F.when(m > 2, m - 2)
    return F.when((m >= mp) & spread, F.skewness(x).over(w) * factor)


def cs_rank(x: Column) -> Column:
    """Percentile rank across symbols, ties averaged, NULLs left out."""
    x = steady(x)
    place = F.rank().over(across().orderBy(x.asc_nulls_last()))
    ties = F.count(x).over(W.partitionBy(DATE, x))
    return F.when(x.isNotNull(), (place + (ties - 1) / 2) / F.count(x).over(across()))


class SparkBackend:
    """Formula nodes as columns."""

    def num(self, value: float) -> Column:
        return F.lit(value)

    def var(self, name: str) -> Column:
        return F.col(name)

    def neg(self, a: Column) -> Column:
        return -a

    def op(self, name: str, a: Column, b: Column) -> Column:
        match name:
            case "+":
                return a + b
            case "-":
                return a - b
            case "*":
                return a * b
            case "/":
                return ratio(a, b)
            case "%":
                return F.pmod(a, F.when(b != 0, b))
            case "//":
                return F.floor(ratio(a, b)).cast("double")
        return clean(F.pow(a, b))

    def cmp(self, name: str, a: Column, b: Column) -> Column:
        made = {">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b, "==": a == b, "!=": a != b}[name]
        return F.coalesce(made, F.lit(False))

    def bool(self, name: str, args: list[Column]) -> Column:
        out = args[0]
        for a in args[1:]:
            out = (out & a) if name == "and" else (out | a)
        return out

    def call(self, name: str, args: list[Column], numbers: list[float | None]) -> Column:
        x = args[0]
        n = int(numbers[1]) if len(numbers) > 1 and numbers[1] is not None else 0
        k = int(numbers[2]) if len(numbers) > 2 and numbers[2] is not None else 0
        w = trailing(n) if n > 0 else None
        match name:
            case "mean":
                return F.avg(x).over(w)
            case "std":
                return F.stddev_samp(x).over(w)
            case "sum":
                return F.sum(x).over(w)
            case "ts_min":
                return F.min(x).over(w)
            case "ts_max":
                return F.max(x).over(w)
            case "ts_arg_max":
                return arg_extreme(x, n, F.array_max)
            case "ts_arg_min":
                return arg_extreme(x, n, F.array_min)
            case "ts_product":
                return F.product(x).over(w)
            case "ts_zscore":
                return ratio(x - F.avg(x).over(w), F.stddev_samp(x).over(w))
            case "zscore":
                return gated(ratio(x - F.avg(x).over(w), F.stddev_samp(x).over(w)), x, w, min(n, 2))
            case "ts_median":
                return F.percentile(x, 0.5).over(w)
            case "ts_percentile":
                full = F.count(x).over(w) == F.count(F.lit(1)).over(w)
                return F.when(full, F.percentile(x, numbers[2] if len(numbers) > 2 else 0.5).over(w))
            case "ts_skew":
                return moment(x, n, max(3, n // 2), "skew")
            case "ts_kurt":
                return moment(x, n, max(4, n // 2), "kurt")
            case "unbiased_skew":
                return moment(x, n, k or 3, "unbiased")
            case "delay":
                return F.lag(x, n).over(in_time())
            case "delta":
                return x - F.lag(x, n).over(in_time())
            case "momentum" | "pct_change":
                return ratio(x, F.lag(x, n).over(in_time())) - 1
            case "slope":
                return slope(x, n)
            case "decay_linear":
                return decay(x, n)
            case "ts_rank":
                return share_above(x, n)
            case "own_rank":
                n = n or 250
                return gated(share_above(x, n), x, trailing(n), 5)
            case "corr" | "cov":
                return co(x, args[1], trailing(k), max(2, k // 2), name)
            case "roll_corr":
                return co(x, args[1], trailing(k), k, "corr")
            case "gated_corr" | "gated_cov":
                return co(x, args[1], trailing(k), int(numbers[3]), name.removeprefix("gated_"))
            case "gated_mean":
                return gated(F.avg(x).over(w), x, w, k)
            case "gated_std":
                return gated(F.stddev_samp(x).over(w), x, w, k)
            case "gated_max":
                return gated(F.max(x).over(w), x, w, k)
            case "gated_min":
                return gated(F.min(x).over(w), x, w, k)
            case "gated_var":
                return gated(F.var_samp(x).over(w), x, w, k)
            case "scale":
                w = trailing(k or 250)
                total = gated(F.sum(F.abs(x)).over(w), x, w, 5)
                return ratio(x * (numbers[1] if len(numbers) > 1 else 1.0), total)
            case "reg_beta" | "reg_resi":
                w = trailing(k)
                both = x.isNotNull() & args[1].isNotNull()
                y, z = F.when(both, x), F.when(both, args[1])
                beta = gated(ratio(covariance(y, z, w), F.var_samp(z).over(w)), y, w, max(2, k // 2))
                if name == "reg_beta":
                    return beta
                return x - (F.avg(y).over(w) - beta * F.avg(z).over(w) + beta * args[1])
            case "ema":
                return ewm(x, 2 / (n + 1))
            case "wilder":
                return ewm(x, 1 / n)
            case "ewm":
                return ewm(x, numbers[1])
            case "cumsum":
                return F.sum(x).over(so_far())
            case "expanding_zscore":
                return ratio(x - F.avg(x).over(so_far()), F.stddev_samp(x).over(so_far()))
            case "mad":
                values = frame(x, n)
                mean = F.avg(x).over(w)
                return F.aggregate(values, F.lit(0.0), lambda s, v: s + F.coalesce(F.abs(v - mean), F.lit(0.0))) / F.count(x).over(w)
            case "cs_rank":
                return cs_rank(x)
            case "cs_zscore":
                return ratio(x - F.avg(x).over(across()), F.stddev_samp(x).over(across()))
            case "winsorize_q":
                low, high = (numbers[1] if len(numbers) > 1 else 0.01), (numbers[2] if len(numbers) > 2 else 0.99)
                return F.when(x.isNotNull(), F.least(F.greatest(x, F.percentile(x, low).over(across())), F.percentile(x, high).over(across())))
            case "sign":
                return F.signum(x)
            case "abs":
                return F.abs(x)
            case "log":
                return F.when(x.isNotNull(), F.log(F.greatest(x, F.lit(1e-9))))
            case "ln":
                return F.log(F.when(x > 0, x))
            case "sqrt":
                return F.sqrt(F.when(x >= 0, x))
            case "power":
                return clean(F.pow(x, args[1]))
            case "signed_power":
                return F.signum(x) * F.pow(F.abs(x), args[1]) if len(args) > 1 else x
            case "winsorize":
                low, high = (-args[1], args[1]) if len(args) == 2 else (args[1], args[2])
                return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))
            case "larger":
                return F.when(x.isNotNull() & args[1].isNotNull(), F.greatest(x, args[1]))
            case "smaller":
                return F.when(x.isNotNull() & args[1].isNotNull(), F.least(x, args[1]))
            case "where":
                return F.when(x, args[1]).otherwise(args[2])
            case "fill":
                return F.coalesce(x, args[1])
            case "nz":
                return F.when(x != 0, x)
        raise ValueError(name)


def with_factors(panel: DataFrame, formulas: dict[str, str], dialect: str = "panel", fill: bool = True) -> DataFrame:
    """``date, symbol`` and one column for each formula; with ``fill``, missing values are 0 as in factor panels.

    ``panel`` has the columns ``date, symbol, open, high, low, close, volume, amount, oi``, one row for a
    symbol and date. All formulas are compiled together (see :mod:`barweave.functions.formula`).
    """
    laid = plan({k: parse(v, dialect) for k, v in formulas.items()})
    backend = SparkBackend()
    df = panel.withColumn(ROW, F.row_number().over(in_time()))
    for stage in laid.stages:
        df = df.select("*", *(build(n, backend).alias(name) for name, n in stage))
    return df.select(DATE, SYMBOL, *(finished(build(n, backend), fill).alias(k) for k, n in laid.outputs.items()))


def finished(x: Column, fill: bool) -> Column:
    x = clean(x.cast("double"))
    return F.coalesce(x, F.lit(0.0)) if fill else x


def with_columns(panel: DataFrame, formulas: dict[str, str], dialect: str = "panel") -> DataFrame:
    """``panel`` with one more column for each formula, which keeps its NULLs; compiled together."""
    laid = plan({k: parse(v, dialect) for k, v in formulas.items()})
    backend, keep = SparkBackend(), panel.columns
    df = panel.withColumn(ROW, F.row_number().over(in_time()))
    for stage in laid.stages:
        df = df.select("*", *(build(n, backend).alias(c) for c, n in stage))
    return df.select(*keep, *(finished(build(n, backend), False).alias(k) for k, n in laid.outputs.items()))


def with_column(panel: DataFrame, name: str, formula: str, dialect: str = "panel") -> DataFrame:
    """``panel`` with one more column, which holds a formula and keeps its NULLs."""
    return with_columns(panel, {name: formula}, dialect)


__all__ = ["Node", "SparkBackend", "with_column", "with_columns", "with_factors"]
