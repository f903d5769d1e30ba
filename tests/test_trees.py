import datetime

import pytest
from pyspark.sql import functions as F

from barweave.operators import research, validation
from barweave.sources import trees
from tests.test_mining import NAMES, START, bars


def write(path, header, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join([header, *(",".join(map(str, r)) for r in rows)]) + "\n", encoding="utf-8")


def test_main_contract_of_a_tree(spark, tmp_path):
    header = "datetime,open,high,low,close,volume,open_interest"
    day = lambda d, c, oi: (f"2024-01-0{d} 15:00:00", c - 1, c + 2, c - 2, c, 10, oi)
    write(tmp_path / "5min/CFFEX/IC/IC2401.csv", header, [day(2, 100, 50), day(3, 105, 50)])
    write(tmp_path / "5min/CFFEX/IC/IC2403.csv", header, [day(3, 200, 200), day(4, 205, 200)])
    write(tmp_path / "5min/CFFEX/IC/notes.csv", header, [day(2, 999, 999)])
    root = f"file://{tmp_path}"
    for name in ("IC9999", "IC0", "ic"):
        got = trees.read_futures(spark, root, "cffex", name).orderBy("ts").collect()
        assert [(r.ts, r.contract, r.close, r.high) for r in got] == [(datetime.datetime(2024, 1, d, 7), c, x, x + 2) for d, c, x in ((2, "IC2401", 195), (3, "IC2403", 200), (4, "IC2403", 205))]
    plain = trees.read_futures(spark, root, "CFFEX", "IC9999", adjusted=False).orderBy("ts").collect()
    assert [r.close for r in plain] == [100, 200, 205]
    one = trees.read_futures(spark, root, "CFFEX", "IC2401").orderBy("ts").collect()
    assert [(r.symbol, r.close) for r in one] == [("IC2401", 100), ("IC2401", 105)]
    assert trees.read_futures(spark, root, "CFFEX", "XX").count() == 0 and trees.read_futures(spark, root, "SHFE", "IC2409").count() == 0


@pytest.mark.parametrize("symbol, want", [("RB2405", ("RB", "RB2405")), ("rb9999", ("RB", None)), ("RB0", ("RB", None)), ("RB", ("RB", None)), ("SR405", ("SR405", None))])
def test_products(symbol, want):
    assert trees.product_of(symbol) == want


def test_daily_files_of_markets(spark, tmp_path):
    root = f"file://{tmp_path}"
    rows = [("2024-01-02", 10, 11, 9, 10.5, 1000), ("2024-01-03", 10, 11, 9, 10.7, 1000)]
    write(tmp_path / "daily/SH600000.csv", "date,open,high,low,close,volume", rows)
    write(tmp_path / "hk/00700.csv", "日期,开盘,最高,最低,收盘,成交量", rows)
    write(tmp_path / "options/x/y/IO2401-C-3500.csv", "date,open,high,low,close,volume", rows)
    spark.createDataFrame([("20240105", 1.0, 2.0, 0.5, 1.5, 7.0)], "date string, open double, high double, low double, close double, volume double").coalesce(1).write.parquet(str(tmp_path / "stock/000001.SZ.parquet"))
    got = trees.read_daily(spark, root, "shares", "SSE", "600000").orderBy("ts").collect()
    assert [(r.ts, r.close, r.symbol) for r in got] == [(datetime.datetime(2024, 1, 2), 10.5, "600000"), (datetime.datetime(2024, 1, 3), 10.7, "600000")]
    assert trees.read_daily(spark, root, "hk", "HKEX", "00700").count() == 2
    assert trees.read_daily(spark, root, "options", "CFFEX", "IO2401-C-3500").count() == 2
    assert trees.read_daily(spark, root, "shares", "SZSE", "000001").first().close == 1.5
    assert trees.read_daily(spark, root, "shares", "SZSE", "600000") is None  # another exchange's file
    assert trees.read_daily(spark, root, "shares", "HKEX", "00700") is None and trees.read_daily(spark, root, "hk", "HKEX", "09988") is None


def test_a_planted_leak_is_told(spark):
    from pyspark.sql import Window as W

    panel = spark.createDataFrame(bars(30, 4), NAMES)
    w = W.partitionBy("symbol").orderBy("date")
    honest = lambda df: df.select("date", "symbol", (F.col("close") / F.avg("close").over(w.rowsBetween(-4, 0))).alias("value"))
    ahead = lambda df: df.select("date", "symbol", F.lead("close", 2).over(w).alias("value"))
    whole = lambda df: df.select("date", "symbol", (F.col("close") - F.avg("close").over(W.partitionBy("symbol"))).alias("value"))
    cuts = [START + datetime.timedelta(d) for d in (12, 20, 25)]
    assert validation.prefix_leaks(panel, honest, cuts).count() == 0
    assert {(r.date - START).days for r in validation.prefix_leaks(panel, ahead, cuts).collect()} == {11, 12, 19, 20, 24, 25}
    told = validation.prefix_leaks(panel, whole, cuts)
    assert told.select("cut").distinct().count() == 3 and told.count() == 4 * (13 + 21 + 26)


@pytest.mark.parametrize("code, interval, n", [
    ("if bar.datetime.hour == 14: sell()", "1d", 1), ("if bar.datetime.hour == 14: sell()", "5m", 0), ("x = self.daily.ma(5)", "1d", 1), ("x = self.daily.ma(5)", "5m", 0),
    ("buy()", "5m", 1), ("n_days = 3", "5m", 0), ("buy()", "1d", 0), ("def broken(", "1d", 0),
])
def test_code_and_interval(code, interval, n):
    assert len(validation.interval_issues(code, interval)) == n


def test_turbulence_regimes(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    values = rng.normal(0, 1, 400)
    values[[150, 300]] = 9, -12
    df = spark.createDataFrame([(START + datetime.timedelta(i), "s", float(v)) for i, v in enumerate(values)], "date date, symbol string, r double")
    rows = research.turbulence_regimes(df, "r", 100).orderBy("date").collect()
    d = np.abs(values - values[:100].mean()) / values[:100].std(ddof=1)
    later = d[100:]
    high = max(np.quantile(later, 0.95), 1.0)
    extreme = max(np.quantile(later, 0.99), np.quantile(later, 0.95) + 1e-9)
    want = [None] * 100 + ["EXTREME" if x > extreme else "HIGH" if x > high else "LOW" for x in later]
    assert [r.regime if i >= 100 else None for i, r in enumerate(rows)] == want and rows[0].regime == "LOW"
    assert {r.regime: r.scale for r in rows} == {"LOW": 1.0, "HIGH": 0.5, "EXTREME": 0.0}
