import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barweave.operators import accounts, attribution, desk, formula_search, validation

COMMON = dict.fromkeys(desk.MODEL, 0.0) | {"rate": 1e-4, "today": 1.0, "yesterday": 1.0}


def day(i):
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)


def model(**given):
    return tuple(float((COMMON | given)[f]) for f in desk.MODEL)


def test_cost_models_go_from_the_symbol_to_the_common_one(spark):
    kinds = ", ".join(f"{f} double" for f in desk.MODEL)
    models = spark.createDataFrame([("RB", *model(rate=1.0)), ("rb0", *model(rate=2.0))], f"key string, {kinds}")
    places = spark.createDataFrame([("SSE", *model(rate=3.0))], f"exchange string, {kinds}")
    rows = spark.createDataFrame([("rb0", "SSE"), ("rb2405", "SSE"), ("600000", "SSE"), ("600000", "X"), ("zz1", None)], "symbol string, exchange string")
    got = {(r.symbol, r.exchange): r.model.rate for r in desk.cost_models(rows, models, places, COMMON).collect()}
    assert got == {("rb0", "SSE"): 2.0, ("rb2405", "SSE"): 1.0, ("600000", "SSE"): 3.0, ("600000", "X"): 1e-4, ("zz1", None): 1e-4}
    assert desk.cost_models(rows.limit(0), models, places, COMMON).count() == 0


def test_trade_and_roll_costs(spark):
    fields = [F.struct(*(F.lit(v).alias(f) for f, v in zip(desk.MODEL, model(rate=1e-3, today=0.0, yesterday=2.0, least=5.0, stamp=1e-3, slip=1e-3), strict=True))).alias("model")]
    rows = spark.createDataFrame([(10.0, 100.0, 10.0, -1, "CLOSE_YESTERDAY", 4.0), (1.0, 1.0, 1.0, 1, "OPEN", 0.0)], "volume double, price double, size double, side int, offset string, closed_today double").select("*", *fields)
    a, b = desk.trade_costs(rows).orderBy(F.desc("volume")).collect()
    assert abs(a.commission - 1000 * 1e-3 * 6 * 2) < 1e-9 and abs(a.stamp - 10.0) < 1e-9
    assert (b.commission, b.stamp) == (5.0, 0.0)
    assert abs(desk.roll_costs(rows, 100.0, 2).first().bps - (5 + 5 + 2e-3) * 1e4) < 1e-6


def test_offsets(spark):
    rows = spark.createDataFrame([("OPEN", 1.0, 1.0, 0.0, True), ("CLOSE", 3.0, 5.0, 1.0, True), ("CLOSE", 5.0, 5.0, 1.0, True), ("CLOSE", 5.0, None, None, True), ("CLOSE", 5.0, 5.0, 1.0, False)], "o string, v double, h double, y double, d boolean")
    got = [r.out for r in rows.select(desk.closing_offset(*map(F.col, "ovhyd")).alias("out")).collect()]
    assert got == ["OPEN", "CLOSE_TODAY", "CLOSE_YESTERDAY", "CLOSE_TODAY", "CLOSE"]


def test_gate_names_the_first_failure(spark):
    limits = desk.Limits(most_volume=100, least_volume=1, step=1, deviation=0.05, most_position=150, margin_rate=0.1, most_margin=0.8, a_day=100, a_minute=3)
    at = lambda s: dt.datetime(2024, 1, 2) + dt.timedelta(seconds=s)
    base = dict(symbol="x", side=1, offset="OPEN", volume=10.0, price=10.0, reference=10.0, held=0.0, equity=1e6, halt=None, in_session=True)
    cases = [({}, "PASS"), ({"halt": "HARD"}, "HALTED"), ({"halt": "SOFT"}, "HALTED"), ({"symbol": "bad"}, "SYMBOL_DENIED"), ({"in_session": False}, "CLOSED"), ({"volume": 0.5}, "VOLUME"), ({"volume": 1.5}, "VOLUME"), ({"price": 11.0}, "PRICE"), ({"price": 0.0}, "PASS"),
             ({"symbol": "own"}, "SELF_TRADE"), ({"offset": "CLOSE", "side": -1}, "CLOSE_VOLUME"), ({"volume": 100.0, "symbol": "y"}, "PASS"), ({"volume": 100.0, "symbol": "y"}, "POSITION"), ({"equity": 1.0, "symbol": "z"}, "MARGIN")]
    rows = [dict(base, order_id=i, account="a", ts=at(100 * i), **case) if not set(case) & set(base) else {**base, "order_id": i, "account": "a", "ts": at(100 * i), **case} for i, (case, _) in enumerate(cases)]
    rows += [{**base, "order_id": 100 + i, "account": "b", "ts": at(i)} for i in range(4)]
    schema = "order_id long, account string, symbol string, ts timestamp, side int, offset string, volume double, price double, reference double, held double, equity double, halt string, in_session boolean"
    orders = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    denied = spark.createDataFrame([("bad",), ("bad",)], "symbol string")
    active = spark.createDataFrame([("a", "own", -1), ("a", "own", -1)], "account string, symbol string, side int")
    got = {r.order_id: r.code for r in desk.order_gate(orders, denied, active, limits).collect()}
    assert [got[i] for i in range(len(cases))] == [code for _, code in cases]
    assert [got[100 + i] for i in range(4)] == ["PASS", "PASS", "PASS", "RATE"]


def test_halts_stay(spark):
    rows = spark.createDataFrame([("s", day(i), e) for i, e in enumerate((100.0, 99.0, 90.0, 95.0))], "symbol string, date date, equity double")
    got = desk.equity_halts(rows, "symbol", 0.05, 0.5).orderBy("date").collect()
    assert [(r.code, r.halted) for r in got] == [(None, False), (None, False), ("DAILY_LOSS_LIMIT", True), (None, True)]


def test_expanding_buckets_match_quantile_cuts(spark):
    values = np.random.default_rng(3).normal(size=40).tolist()
    rows = spark.createDataFrame([(day(i), "s", None if i == 5 else v, 0.01 if i < 39 else None) for i, v in enumerate(values)], "date date, symbol string, value double, fwd double")
    got = [(r.bucket, r.ret) for r in attribution.expanding_long_short(rows).orderBy("date").collect()]
    seen = []
    for i, v in enumerate(values):
        if i == 5 or i == 39:
            assert got[i] == (None, 0.0)
            continue
        seen.append(v)
        if len(seen) < 6:
            assert got[i] == (None, 0.0)
        else:
            b = int(pd.qcut(pd.Series(seen).rank(method="first"), 5, labels=False).iloc[-1])
            assert got[i] == (b, 0.01 if b == 4 else -0.01 if b == 0 else 0.0)


def test_contributions_sum_to_the_deviation(spark):
    rng = np.random.default_rng(7)
    rows = [(day(t), f"S{i}", *map(float, rng.normal(size=4))) for t in range(60) for i in range(12)]
    df = spark.createDataFrame(rows, "date date, symbol string, weight double, fwd double, f1 double, f2 double").withColumn("flat", F.lit(1.0))
    got = {r.part: r for r in attribution.risk_attribution(df, "weight", "fwd", ["f1", "f2", "flat"]).collect()}
    assert set(got) == {"market", "f1", "f2", "flat", "specific"}
    assert abs(sum(r.share for r in got.values()) - 1) < 1e-9 and abs(got["flat"].contribution) < 1e-12
    total = df.groupBy("date").agg(F.sum(F.col("weight") * F.col("fwd")).alias("v")).orderBy("date").toPandas()["v"].to_numpy()
    x = total - total.mean()
    variance = (x @ x + 2 * sum((1 - j / 4) * (x[j:] @ x[:-j]) for j in (1, 2, 3))) / len(x)
    assert abs(sum(r.contribution for r in got.values()) - variance**0.5) < 1e-9


def test_weights_of_least_variance():
    np.testing.assert_allclose(attribution.least_variance_weights(np.eye(2), np.array([1.0, 3.0])), [0.75, 0.25])
    assert attribution.least_variance_weights(np.zeros((0, 0))).size == 0
    assert abs(attribution.least_variance_weights(np.full((3, 3), np.nan)).sum() - 1) < 1e-12


def bars_of(spark, closes):
    rows = [(day(i), "s", c, c, c, c, 1.0, 1.0, 1.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "date date, symbol string, open double, high double, low double, close double, volume double, amount double, oi double")


def test_bollinger_positions(spark):
    calm = [100.0 + (i % 2) for i in range(30)]
    closes = [*calm, 90.0, 99.0, 101.5, 99.0]
    got = [r.position for r in validation.bollinger_recover(bars_of(spark, closes)).orderBy("date").collect()]
    assert got == [0] * 31 + [1, 1, 0]
    assert not any(r.position for r in validation.bollinger_recover(bars_of(spark, calm)).collect())


def test_first_buy_needs_a_new_low_with_more_momentum(spark):
    falling = [200.0 - i for i in range(90)]  # ever faster, in shares of the price
    assert not any(r.position for r in validation.first_buy(bars_of(spark, falling)).collect())
    slower = [*falling[:80], *[falling[79] * 0.999**i for i in range(1, 20)]]
    got = [r.position for r in validation.first_buy(bars_of(spark, slower)).orderBy("date").collect()]
    assert got[79] == 0 and got[85] == 1


def test_reports_of_many_formulas(spark):
    rng = np.random.default_rng(2)
    rows = []
    for s in range(6):
        close = 100 * np.cumprod(1 + rng.normal(0, 0.01, 40))
        rows += [(day(i), f"S{s}", float(c), float(c), float(c), float(c), 1.0 + s, 1.0, float(close[i + 1] / c) if i < 39 else None) for i, c in enumerate(close)]
    panel = spark.createDataFrame(rows, "date date, symbol string, open double, high double, low double, close double, volume double, amount double, oi double")
    formulas = {"next": "oi", "again": "oi*2+1", "against": "-oi"}
    got = {r["name"]: r["mean"] for r in formula_search.batch_report(panel, formulas).collect()}
    assert got["next"] > 0.999 and got["again"] > 0.999 and got["against"] < -0.999
    heads = {r["name"]: r.head for r in formula_search.deduplicated(panel, formulas).collect()}
    assert heads["next"] == heads["again"] and heads["against"] == "against"
    tried = formula_search.evolved(panel, ["volume", "mean(oi,3)"], 2, 2, 3).collect()
    assert {r.generation for r in tried} == {0, 1, 2} and len({r.formula for r in tried}) == len(tried)
    assert formula_search.evolved(panel, [], 1).count() == 0


def test_working_orders(spark):
    t = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("x", t, "NOT_TRADED", 1, 10.0, None), ("x", t, "PART_TRADED", -1, 10.0, 4.0), ("x", t, "CANCELLED", 1, 10.0, 0.0), ("y", t + dt.timedelta(seconds=200), "SUBMITTING", 1, 1.0, 0.0)], "symbol string, ts timestamp, status string, side int, volume double, traded double")
    assert {r.symbol: r.frozen for r in accounts.frozen_volume(rows).collect()} == {"x": 4.0, "y": 1.0}
    assert [r.age for r in accounts.overdue(rows, "2024-01-01 00:05:00").collect()] == [300, 300]
