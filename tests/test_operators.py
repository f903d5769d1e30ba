import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barweave.operators import accounts, bars, research, search
from barweave.sources import files
from barweave.streaming import ticks


def day(i):
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)


def test_contract_roll_is_back_adjusted(spark):
    rows = [("IC", day(1), "IC2401", 100.0, 50.0), ("IC", day(2), "IC2401", 105.0, 50.0), ("IC", day(2), "IC2403", 200.0, 200.0), ("IC", day(3), "IC2403", 205.0, 200.0)]
    got = bars.continuous(spark.createDataFrame(rows, "symbol string, date date, contract string, close double, oi double")).orderBy("date").collect()
    assert [r.adjusted for r in got] == [195.0, 200.0, 205.0]


def test_five_minute_bars_to_days(spark):
    at = lambda d, h, m: dt.datetime(2024, 1, d, h, m)
    rows = [("X", at(2, 9, 0), 5000.0, 5010.0, 4990.0, 5005.0, 100.0, 50.0, 0.0), ("X", at(2, 9, 5), 5005.0, 5020.0, 5000.0, 5015.0, 120.0, 52.0, 0.0), ("X", at(3, 9, 0), 5015.0, 5030.0, 5010.0, 5025.0, 200.0, 60.0, 0.0), ("X", at(5, 13, 0), 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.0)]
    got = bars.resample_daily(spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double, oi double, amount double")).orderBy("date").collect()
    assert (got[0].open, got[0].high, got[0].low, got[0].close, got[0].volume) == (5000.0, 5020.0, 4990.0, 5015.0, 220.0)
    assert got[1].close == 5025.0 and got[2].date == dt.date(2024, 1, 8)  # Friday afternoon belongs to Monday


def test_files_are_read_by_any_header(spark, tmp_path):
    (tmp_path / "rb2505.csv").write_text("日期,Open,HIGH,low,收盘,Vol\n2024-01-02 09:00,1,2,0.5,1.5,10\nnonsense,1,2,0.5,1.5,10\n2024-01-03,1,2,0.5,,10\n")
    got = files.read_bars(spark, str(tmp_path / "rb2505.csv"), hours=8).collect()
    assert len(got) == 1 and got[0].ts == dt.datetime(2024, 1, 2, 1, 0) and got[0].contract == "RB2505" and got[0].volume == 10 and got[0].oi is None
    with pytest.raises(ValueError):
        files.read_bars(spark, str(tmp_path / "x.xlsx"))
    ends = spark.createDataFrame([("RB2502",), ("X",)], "c string").select(files.expiry(F.col("c")).alias("e")).collect()
    assert ends[0].e == dt.date(2025, 2, 28) and ends[1].e is None


def test_mock_bars_are_the_same_each_time_and_written_bars_replace(spark, tmp_path):
    a = files.mock_bars(spark, ["a", "b"], "2024-01-01", 50)
    assert sorted(a.collect()) == sorted(a.repartition(7).collect()) and a.count() == 100
    rows = a.withColumnRenamed("date", "ts").withColumn("interval", F.lit("1d")).withColumn("exchange", F.lit("SSE"))
    files.write_bars(rows, str(tmp_path / "w"))
    files.write_bars(rows.limit(10), str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w")).count() == 10
    assert files.first_source(lambda: a.limit(0), lambda: a).count() == 100
    with pytest.raises(LookupError):
        files.first_source(lambda: None)


def test_keep_last_and_upsert(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, s string, v double")
    new = spark.createDataFrame([(2, None, 9.0), (3, "c", 3.0)], "k int, s string, v double")
    assert sorted((r.k, r.s, r.v) for r in bars.upserted(old, new, ["k"]).collect()) == [(1, "a", 1.0), (2, None, 9.0), (3, "c", 3.0)]


def test_predictive_factor_is_recognised(spark):
    n, rng = 80, np.random.default_rng(1)
    rows = []
    for s in range(8):
        ret = rng.normal(0, 0.01, n)
        close = 100 * np.cumprod(1 + ret)
        rows += [(day(i), f"S{s}", float(close[i]), float(ret[i + 1]) if i + 1 < n else None) for i in range(n)]
    df = research.forward_return(spark.createDataFrame(rows, "date date, symbol string, close double, value double"))
    ic = research.daily_ic(df)
    assert research.ic_statistics(ic).collect()[0]["mean"] > 0.99
    assert research.monotonicity(research.bucket_returns(df)).collect()[0].monotonicity > 0.9
    book = research.long_short(df, cost=0.001).orderBy("date").collect()
    assert book[0].turnover == 0 and all(b.gross > 0 for b in book) and all(b.net <= b.gross for b in book)


def test_buckets_match_quantile_cuts(spark):
    import pandas as pd

    for n in (5, 7, 13, 24):
        values = np.random.default_rng(n).normal(size=n)
        df = spark.createDataFrame([(day(0), f"{i:03}", float(v)) for i, v in enumerate(values)], "date date, symbol string, value double")
        got = [r.bucket for r in research.bucketed(df, "value", 5).orderBy("symbol").collect()]
        want = pd.qcut(pd.Series(values).rank(method="first"), 5, labels=False).tolist()
        assert got == want


def test_regressions_by_date_against_numpy(spark):
    rng = np.random.default_rng(7)
    rows = [(day(t), f"S{i}", *map(float, rng.normal(size=4))) for t in range(3) for i in range(12)]
    df = spark.createDataFrame(rows, "date date, symbol string, y double, a double, b double, c double")
    ortho = research.orthogonalised(df, ["a", "b", "c"]).toPandas()
    for _, part in ortho.groupby("date"):
        x = part[["a", "b", "c"]].to_numpy()
        np.testing.assert_allclose(x.T @ x / len(x), np.eye(3), atol=1e-9)
    got = research.factor_returns(df, "y", ["a", "b"], ridge=0.0).toPandas()
    for d, part in df.toPandas().groupby("date"):
        x = np.column_stack([np.ones(12), part["a"], part["b"]])
        want = np.linalg.lstsq(x, part["y"], rcond=None)[0]
        np.testing.assert_allclose(got[got["date"] == d]["ret"], want, atol=1e-9)
    residual = research.neutralised_by_styles(df, "y", ["a"], tails=0.0).toPandas().merge(df.toPandas())
    assert residual.groupby("date").apply(lambda p: abs(np.corrcoef(p["value"], p["a"])[0, 1]), include_groups=False).max() < 1e-9


def test_clusters_and_weights():
    out = research.greedy_clusters(["a", "b", "c"], {"a": 3.0, "b": 2.0, "c": 1.0}, {("a", "b"): 0.9, ("a", "c"): -0.9, ("b", "c"): 0.1})
    assert out == {"a": ["b"], "c": []}
    assert research.weights({"a": (0.1, 0.1), "b": (-0.1, 0.1)}, "icir") == {"a": 1.0, "b": 0.0}
    assert research.weights({"a": (0.0, 0.0), "b": (0.0, 0.0)}, "icir") == {"a": 0.5, "b": 0.5}
    assert research.weights({}, "equal") == {}


def test_folds_of_trades(spark):
    rows = [("x", 1, 1, 10.0, 100.0), ("x", 2, 1, 10.0, 110.0), ("x", 3, -1, 5.0, 120.0), ("x", 4, -1, 25.0, 90.0)]
    trades = spark.createDataFrame(rows, "symbol string, seq int, side int, volume double, price double")
    r = accounts.average_cost(trades).collect()[0]
    assert (r.net, r.average, r.realised) == (-10.0, 90.0, 5 * 15.0 - 15 * 15.0)
    r = accounts.paired_profit(trades).collect()[0]
    assert (r.pairs, r.wins, r.profit) == (3, 1, 50.0 - 100.0 - 100.0)


def test_fold_equals_windows_without_limits(spark):
    rows = files.mock_bars(spark, ["a", "b"], "2024-01-01", 60).withColumn("amount", F.col("close") * F.col("volume"))
    made = accounts.dual_average(rows, 3, 8)
    a = {(r.date, r.symbol): r.equity for r in accounts.replay_targets(made, 1e6, 0.0005).collect()}
    b = {(r.date, r.symbol): r.equity for r in accounts.replay_fold(made, 1e6, 0.0005, limit=1e9).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-6 for k in a)


def test_tokens_and_scores(spark):
    rows = spark.createDataFrame([(1, "alpha beta beta"), (2, "gamma"), (3, None), (4, "因子 alpha")], "id int, text string")
    got = {r.id: r.score for r in search.bm25(rows, "id", "text", ["beta", "alpha"]).collect()}
    assert set(got) == {1, 4} and got[1] > got[4] > 0
    assert [r.id for r in search.top(search.bm25(rows, "id", "text", ["beta", "alpha"]), "id", 1).collect()] == [1]


def stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def test_streams(spark, tmp_path):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    schema = "symbol string, ts timestamp, seq long, price double, volume double"
    rows = [("a", t(s), s, float(p), 1.0) for s, p in ((0, 5), (20, 9), (59, 4), (61, 7), (130, 8), (400, 1))]
    source = stream(spark, tmp_path, rows, schema)
    got = ticks.run_available(ticks.window_bars(source), "w1", "complete", str(tmp_path / "c1")).orderBy("start").collect()
    assert [(r.open, r.high, r.low, r.close, r.n) for r in got] == [(5, 9, 4, 4, 3), (7, 7, 7, 7, 1), (8, 8, 8, 8, 1), (1, 1, 1, 1, 1)]
    got = ticks.run_available(ticks.anchored_bars(source, 60), "w2", "append", str(tmp_path / "c2")).orderBy("start").collect()
    assert [(r.open, r.close, r.volume) for r in got] == [(5, 4, 3), (7, 7, 1), (8, 8, 1)]


def test_order_streams(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    schema = "order_id string, trade_id string, ts timestamp, status string, traded double"
    source = stream(spark, tmp_path, [("o", "1", t, "ALL_TRADED", 5.0), ("o", "1", t, "PART_TRADED", 3.0), ("o", "2", t, "NOT_TRADED", 0.0)], schema)
    got = ticks.run_available(ticks.order_states(source), "o1", "complete", str(tmp_path / "c1")).collect()
    assert [(r.status, r.traded) for r in got] == [("ALL_TRADED", 5.0)]
    assert ticks.run_available(ticks.distinct_trades(source), "o2", "append", str(tmp_path / "c2")).count() == 2
