import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barweave.functions import factors, formula, ops
from barweave.functions.ops import with_factors
from barweave.plans import duck


def panel(spark, n=40, symbols=4, seed=0, gaps=False):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(symbols):
        close = np.abs(rng.normal(100, 10, n))
        volume = np.abs(rng.normal(1000, 100, n))
        for i in range(n):
            missing = gaps and rng.random() < 0.1
            v = [None] * 6 if missing else [float(x) for x in (close[i] * 0.99, close[i] * 1.02, close[i] * 0.98, close[i], volume[i], close[i] * volume[i])]
            rows.append((pd.Timestamp("2024-01-01").date() + pd.Timedelta(days=i), f"S{s}", *v, None))
    return spark.createDataFrame(rows, "date date, symbol string, open double, high double, low double, close double, volume double, amount double, oi double")


def wide(df, column):
    return df.pivot(index="date", columns="symbol", values=column).astype(float)


CASES = {
    "mean(close,5)": lambda c, v: c.rolling(5, min_periods=1).mean(),
    "std(close,5)": lambda c, v: c.rolling(5, min_periods=1).std(),
    "delta(close,3)": lambda c, v: c - c.shift(3),
    "ts_rank(close,7)": lambda c, v: c.rolling(7, min_periods=1).apply(lambda w: (w > w[-1]).sum() / len(w), raw=True),
    "decay_linear(volume,4)": lambda c, v: v.rolling(4, min_periods=1).apply(lambda w: (w * np.arange(1, 5)[-len(w):]).sum() / 10, raw=True),
    "slope(close,6)": lambda c, v: c.rolling(6, min_periods=3).apply(lambda w: np.polyfit(np.arange(len(w)), w, 1)[0], raw=True),
    "ts_arg_max(close,6)": lambda c, v: c.rolling(6, min_periods=1).apply(lambda w: 5 - np.argmax(w), raw=True),
    "ema(close,5)": lambda c, v: c.ewm(span=5, adjust=False, ignore_na=False).mean(),
    "rank(close)": lambda c, v: c.rank(axis=1, pct=True),
    "cs_zscore(volume)": lambda c, v: v.sub(v.mean(axis=1), axis=0).div(v.std(axis=1), axis=0),
    "ts_median(volume,5)": lambda c, v: v.rolling(5, min_periods=1).median(),
    "pct_change(close,2)": lambda c, v: c / c.shift(2) - 1,
    "ts_zscore(close,10)": lambda c, v: (c - c.rolling(10, min_periods=1).mean()) / c.rolling(10, min_periods=1).std(),
    "unbiased_skew(close,10,5)": lambda c, v: c.rolling(10, min_periods=5).skew(),
}


@pytest.mark.parametrize("gaps", [False, True])
def test_operators_against_pandas(spark, gaps):
    cases = dict(CASES)
    if gaps:  # what pandas does with a gap inside these windows is the frame's NaN
        for k in ("ts_rank(close,7)", "decay_linear(volume,4)", "slope(close,6)", "ts_arg_max(close,6)", "unbiased_skew(close,10,5)"):
            cases.pop(k)
    df = panel(spark, gaps=gaps)
    names = {f"f{i}": k for i, k in enumerate(cases)}
    got = ops.with_factors(df, names, fill=False).toPandas()
    base = df.toPandas()
    close, volume = wide(base, "close"), wide(base, "volume")
    for f, text in names.items():
        want, have = cases[text](close, volume), wide(got, f)
        np.testing.assert_allclose(have.to_numpy(), want.reindex_like(have).to_numpy(), rtol=1e-9, atol=1e-9, err_msg=text)


@pytest.mark.parametrize("text", ["delay(close,0)", "delay(close,-1)", "ref(close,0)", "close.x", "__import__('os')", "mean(close)", "nothing(close,2)", "price", "1<close<2", "mean(close,n=3)", "mean(close,2.5)", "lambda: 1", "close if 1 else 2", "'a'", "True", "mean(close,"])
def test_what_is_refused(text):
    with pytest.raises(formula.FormulaError):
        formula.parse(text)


def test_dialects_and_aliases():
    assert formula.parse("Mean($close, 5)").key == formula.parse("mean(close,5)").key == formula.parse("sma(close, 5)").key
    assert formula.parse("rank(close)").name == "cs_rank" and formula.parse("rank(close)", "single").name == "own_rank"
    assert formula.parse("rank(close,5)").name == "ts_rank"
    assert formula.parse("mean(close,5)", "expr").name == "gated_mean"
    with pytest.raises(formula.FormulaError):
        formula.parse("cs_rank(close)", "single")


def test_shared_windows_are_computed_once():
    laid = formula.plan({"a": formula.parse("mean(close,5)-close"), "b": formula.parse("rank(mean(close,5))")})
    assert [len(s) for s in laid.stages] == [1, 1]


def test_every_named_factor_parses_and_own_ones_come_first(spark):
    for formulas, dialect in factors.FAMILIES.values():
        for text in formulas.values():
            formula.parse(text, dialect)
    assert sum(len(f) for f, _ in factors.FAMILIES.values()) > 150
    factors.register("mine", "close-open")
    assert factors.formula_of("mine") == "close-open" and factors.formula_of("alpha006").startswith("-corr")
    with pytest.raises(KeyError):
        factors.formula_of("none of these")
    with pytest.raises(ValueError):
        factors.technical("unknown")


def test_fill_and_infinities(spark):
    out = ops.with_factors(panel(spark, 6, 2), {"a": "close/(close-close)", "b": "delay(close,3)"}).toPandas()
    assert (out["a"] == 0).all() and out["b"].notna().all()


#: Twice the ranks of high and of volume on three dates, by symbol; on the last one several symbols' correlations over the three are exactly 0.
HIGH = (
    (34, 28, 40, 24, 6, 32, 2, 16, 44, 20, 42, 30, 50, 22, 36, 38, 46, 8, 10, 12, 4, 14, 18, 26, 48),
    (38, 34, 28, 10, 30, 26, 14, 24, 2, 18, 40, 32, 12, 46, 50, 20, 42, 48, 22, 6, 16, 44, 8, 4, 36),
    (24, 22, 20, 4, 50, 46, 38, 26, 14, 40, 10, 6, 18, 2, 28, 8, 30, 48, 42, 32, 36, 16, 44, 34, 12),
)
VOLUME = (
    (50, 4, 14, 19, 6, 28, 42, 46, 36, 32, 10, 38, 26, 2, 34, 12, 40, 44, 8, 30, 48, 22, 19, 16, 24),
    (38, 6, 8, 10, 24, 16, 18, 28, 32, 30, 14, 22, 44, 4, 40, 34, 36, 46, 12, 48, 26, 20, 50, 2, 42),
    (46, 6, 38, 2, 28, 36, 30, 20, 14, 44, 26, 18, 8, 16, 48, 12, 50, 34, 10, 32, 40, 22, 42, 4, 24),
)


def test_correlations_of_zero_rank_as_in_the_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    rows = [(f"2024-01-0{d + 1}", f"s{i:02d}", float(h), float(v)) for d in range(3) for i, (h, v) in enumerate(zip(HIGH[d], VOLUME[d], strict=True))]
    panel = spark.createDataFrame(rows, "date string, symbol string, high double, volume double").withColumn("date", F.to_date("date"))
    formulas = {"f": "R(corr(R(high),R(volume),3))", "cov": "R(cov(R(high),R(volume),3))"}
    got = {(str(r.date), r.symbol): (r.f, r.cov) for r in with_factors(panel, formulas).collect()}
    made = ", ".join(f"('{d}'::DATE, '{s}', {h}::DOUBLE, {v}::DOUBLE)" for d, s, h, v in rows)
    sql = duck.factor_query(formulas, f"panel AS (SELECT * FROM (VALUES {made}) t(date, symbol, high, volume))")
    want = {(d, s): values for d, s, *values in duckdb.sql(sql).fetchall()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)
