import datetime
import math
import random

import pandas as pd
import pytest

from barweave.functions.formula import FormulaError, parse
from barweave.functions.ops import with_factors
from barweave.operators import accounts, backtest, bars, sessions, upkeep

START = datetime.date(2024, 1, 1)


def trades(n=300):
    rng = random.Random(2)
    return [(rng.choice("ab"), i, rng.choice((-1, 1)), float(rng.randrange(1, 9)), round(rng.uniform(5, 15), 2)) for i in range(n)]


def test_average_cost_and_pairs_against_lots(spark):
    rows = trades()
    df = spark.createDataFrame(rows, "symbol string, seq int, side int, volume double, price double").repartition(5)
    costs = {r.symbol: r for r in accounts.average_cost(df).collect()}
    pairs = {r.symbol: r for r in accounts.paired_profit(df).collect()}
    for symbol in "ab":
        net = average = realised = 0.0
        units, done = [], []
        for _, _, side, volume, price in (r for r in rows if r[0] == symbol):
            for _ in range(int(volume)):  # one unit at a time
                if net * side < 0:
                    realised += (price - average) * (1 if net > 0 else -1)
                else:
                    average = (average * abs(net) + price) / (abs(net) + 1)
                net += side
                average = average if net else 0.0
                if units and units[-1][0] != side:
                    s, p = units.pop()
                    done.append((price - p) * s)
                else:
                    units.append((side, price))
        assert (costs[symbol].net, pytest.approx(costs[symbol].average), pytest.approx(costs[symbol].realised)) == (net, average, realised)
        assert pairs[symbol].profit == pytest.approx(sum(done)) and pairs[symbol].wins <= pairs[symbol].pairs


def panel(n=120, symbols="uvw", gap=0.1):
    rng = random.Random(4)
    rows = []
    for s in symbols:
        price = 10.0
        for i in range(n):
            open_ = round(price * rng.choice((1, 1.02, 0.97, 1.1, 0.9)), 4)
            price = round(open_ * rng.uniform(0.95, 1.05), 4)
            dead = rng.random() < gap
            rows.append(("x" if s in "uv" else "y", START + datetime.timedelta(i), s, None if dead else open_, None if dead else price, float(rng.randrange(-4, 8) * 130)))
    return rows


def brute(rows, rules, capital):
    """Date by date and symbol by symbol, with units of lots in plain lists."""
    out, log = {}, []
    for account in sorted({r[0] for r in rows}):
        mine = [r for r in rows if r[0] == account]
        cash, held, cost, lots, close, queue = capital, {}, {}, {}, {}, []
        dates = sorted({r[1] for r in mine})

        def deal(symbol, volume, price, day, forced=False):
            nonlocal cash
            have, opened = held.get(symbol, 0.0), 0.0
            away = min(abs(volume), abs(have)) if have * volume < 0 else 0.0
            cash += away * (price - cost.get(symbol, 0.0)) * math.copysign(1, have) if away else 0.0
            left = away
            book = lots.setdefault(symbol, [])
            while left > 1e-9:
                take = min(left, abs(book[0][1]))
                opened += take if book[0][0] == day else 0.0
                book[0] = (book[0][0], book[0][1] - math.copysign(take, book[0][1]))
                left -= take
                if abs(book[0][1]) < 1e-9:
                    book.pop(0)
            fresh = abs(volume) - away
            new = have + volume
            if fresh > 1e-9:
                book.append((day, math.copysign(fresh, volume)))
                old = abs(have) if have * volume > 0 else 0.0
                cost[symbol] = (cost.get(symbol, 0.0) * old + price * fresh) / (old + fresh)
            held[symbol] = new if abs(new) > 1e-9 else 0.0
            if not held[symbol]:
                cost[symbol] = 0.0
            fee = max(abs(volume) * price * rules.rate, rules.least) + (abs(volume) * price * rules.stamp if volume < 0 else 0.0)
            cash -= fee
            log.append((account, day, symbol, round(volume, 6), round(price, 6), round(opened, 6), forced))

        margin = lambda: rules.margin * sum(abs(v) * cost[s] for s, v in held.items())
        for n, day in enumerate(dates, 1):
            refused, traded = 0, []
            for _, _, symbol, open_, last, target in sorted(r for r in mine if r[1] == day):
                if open_ is None:
                    continue
                traded.append(symbol)
                rest = []
                for s, v, since in queue:
                    if s != symbol or since == day:
                        rest.append((s, v, since))
                        continue
                    move = open_ / close[s] - 1 if s in close else 0.0
                    stuck = rules.limit and s in close and (move >= rules.limit - 1e-6 if v > 0 else move <= -rules.limit + 1e-6)
                    if v < 0 and not rules.same_day:
                        today = sum(x for d, x in lots.get(s, []) if d == day and x > 0)
                        stuck = stuck or -v > max(0.0, held.get(s, 0.0) - today) + 1e-9
                    if stuck:
                        rest.append((s, v, since))
                    else:
                        deal(s, v, open_ * (1 + math.copysign(rules.slip, v)), day)
                queue = rest
                close[symbol] = last
                order = target - held.get(symbol, 0.0) - sum(v for s, v, _ in queue if s == symbol)
                if abs(order) < 1e-9:
                    continue
                if n <= rules.warm_up:
                    refused += 1
                    continue
                if order > 0 and rules.lot:
                    order = math.floor(order / rules.lot) * rules.lot
                    if not order:
                        refused += 1
                        continue
                if rules.margin and held.get(symbol, 0.0) * order >= 0 and rules.margin * abs(order) * last > cash - margin() + 1e-9:
                    refused += 1
                    continue
                queue.append((symbol, float(order), day))
            if day == dates[-1]:
                queue = []
                for s in sorted(traded):
                    if held.get(s):
                        deal(s, -held[s], close[s], day, True)
            gain = sum(v * (close[s] - cost[s]) for s, v in held.items())
            out[account, day] = (cash, cash + gain, refused, len(queue))
    return out, log


RULES = (
    backtest.Rules(),
    backtest.Rules(lot=100, rate=0.0003, least=5, stamp=0.001, slip=0.001),
    backtest.Rules(lot=100, limit=0.1, rate=0.0003, least=5),
    backtest.Rules(limit=0.1, same_day=False, margin=0.2, warm_up=6, slip=0.002),
)


@pytest.mark.parametrize("rules", RULES)
def test_accounts_against_a_plain_loop(spark, rules):
    rows = panel()
    df = spark.createDataFrame(rows, "account string, date date, symbol string, open double, close double, target double").repartition(7)
    run = backtest.accounts(df, rules, 20_000.0)
    got = {(r.account, r.date): (r.cash, r.equity, r.refused, r.pending) for r in run.collect()}
    want, log = brute(rows, rules, 20_000.0)
    assert set(got) == set(want)
    for key, values in want.items():
        assert got[key] == pytest.approx(values), key
    dealt = [(r.account, r.date, r.symbol, round(r.side * r.volume, 6), round(r.price, 6), round(r.closed_today, 6), r.forced) for r in backtest.trades(run).collect()]
    assert sorted(dealt) == sorted(log)
    assert backtest.accounts(df.limit(0), rules).count() == 0


def test_orders_of_one_bar_wait_for_the_next(spark):
    rows = [("x", START + datetime.timedelta(i), "s", 10.0, 10.0, v) for i, v in ((0, 100.0), (0, -30.0), (1, None), (2, None))]
    df = spark.createDataFrame(rows, "account string, date date, symbol string, open double, close double, volume double")
    dealt = backtest.trades(backtest.accounts(df)).collect()
    assert sorted((r.date, r.side * r.volume, r.forced) for r in dealt) == [(START + datetime.timedelta(1), -30.0, False), (START + datetime.timedelta(1), 100.0, False), (START + datetime.timedelta(2), -70.0, True)]


def by_units(rows, rules_of, capital):
    """Cash after each date, with every single unit of volume kept by itself; orders are whole signed volumes."""
    cash, units, average, waiting, closes, out, today_closed = capital, {}, {}, {}, {}, {}, {}
    days = sorted({r[1] for r in rows})

    def deal(symbol, volume, price, day):
        nonlocal cash
        rules, mine = rules_of(symbol), units.setdefault(symbol, [])
        side, fresh, n_opened, spent = (1 if volume > 0 else -1), 0, 0, 0.0
        for _ in range(abs(volume)):
            if mine and mine[0][0] == -side:
                _, opened = mine.pop(0)
                fresh += opened == day
                cash += (price - average[symbol]) * -side * rules.size
            else:
                if not mine:
                    average[symbol] = 0.0
                average[symbol] = (average[symbol] * len(mine) + price) / (len(mine) + 1)
                mine.append((side, day))
        value = price * rules.size
        today = rules.rate if rules.today_rate is None else rules.today_rate
        fee = max(value * (fresh * today + (abs(volume) - fresh) * rules.rate) + rules.per_lot * abs(volume), rules.least)
        cash -= fee + value * abs(volume) * (rules.impact + (rules.stamp if side < 0 else 0))
        today_closed[day, symbol] = today_closed.get((day, symbol), 0) + fresh

    for day in days:
        for _, _, symbol, open_, close, volume, price in sorted((r for r in rows if r[1] == day), key=lambda r: r[2]):
            for order in waiting.pop(symbol, []):
                deal(symbol, order, open_ * (1 + rules_of(symbol).slip * (1 if order > 0 else -1)), day)
            closes[symbol] = close
            limit = rules_of(symbol).limit
            if volume and not (limit and price is not None and not close * (1 - limit) <= price <= close * (1 + limit)):
                waiting.setdefault(symbol, []).append(volume)
        if day == days[-1]:
            for symbol in sorted(closes):
                held = units.get(symbol, [])
                if held:
                    deal(symbol, -held[0][0] * len(held), closes[symbol], day)
        gains = sum((closes[s] - average[s]) * side * rules_of(s).size for s, mine in units.items() for side, _ in mine)
        out[day] = (cash, cash + gains)
    return out, today_closed


def test_futures_and_shares_in_one_account(spark):
    rng = random.Random(11)
    rows = []
    for i in range(40):
        for symbol, level in (("future", 4000.0), ("share", 12.0)):
            open_ = level * (1 + rng.uniform(-0.03, 0.03))
            close = open_ * (1 + rng.uniform(-0.02, 0.02))
            volume = rng.choice([0, 0, 3, -2, 5, -6, 1])
            price = None if rng.random() < 0.5 else close * (1 + rng.uniform(-0.2, 0.2))
            rows.append(("a", START + datetime.timedelta(i), symbol, open_, close, volume, price))
    rules = {"future": backtest.Rules(size=10.0, rate=2e-4, today_rate=6e-4, per_lot=1.5, slip=1e-4, margin=0.1), "share": backtest.Rules(limit=0.1, rate=3e-4, least=5.0, stamp=1e-3, impact=2e-4)}
    df = spark.createDataFrame([(*r[:5], float(r[5]) or None, r[6]) for r in rows], "account string, date date, symbol string, open double, close double, volume double, price double")
    # Opens jump by less than the limit, so only prices are ruled out.
    run = backtest.accounts(df, backtest.Rules(), 1e6, rules)
    want, closed_today = by_units(rows, rules.__getitem__, 1e6)
    got = {r.date: (r.cash, r.equity) for r in run.collect()}
    assert set(got) == set(want)
    for day, values in want.items():
        assert got[day] == pytest.approx(values, rel=1e-12)
    assert sum(r.refused for r in run.collect()) > 0
    fresh = {}
    for r in backtest.trades(run).collect():
        fresh[r.date, r.symbol] = fresh.get((r.date, r.symbol), 0) + r.closed_today
    assert {k: v for k, v in fresh.items() if v} == {k: v for k, v in closed_today.items() if v}


def test_what_opened_today_closes_last(spark):
    bars = [("x", START + datetime.timedelta(i), "s", 10.0, 10.0, v) for i, v in ((0, 5.0), (1, 4.0), (1, -7.0), (2, None), (3, None))]
    df = spark.createDataFrame(bars, "account string, date date, symbol string, open double, close double, volume double")
    dealt = backtest.trades(backtest.accounts(df)).collect()
    # Five are held from the day before when four are bought and seven sold (sells come first here): none of today's.
    assert [(r.side * r.volume, r.closed_today) for r in sorted(dealt, key=lambda r: (r.date, r.side))] == [(5.0, 0.0), (-7.0, 0.0), (4.0, 2.0), (-2.0, 0.0)]


def test_folds_pass_over_missing_values(spark):
    trades = spark.createDataFrame([("s", 1, 1, 10.0, 5.0), ("s", 2, None, 3.0, 5.0), ("s", 3, -1, None, 6.0), ("s", 4, -1, 4.0, None), ("s", 5, -1, 4.0, 7.0)], "symbol string, seq int, side int, volume double, price double")
    r = accounts.average_cost(trades).first()
    assert (r.net, r.average, r.realised) == (6.0, 5.0, 8.0)
    p = accounts.paired_profit(trades).first()
    assert (p.pairs, p.wins, p.profit) == (1, 1, 8.0)
    rows = [(START + datetime.timedelta(i), "s", o, c, t) for i, (o, c, t) in enumerate([(10.0, 10.0, 1.0), (None, None, 1.0), (10.4, 10.5, None), (None, 9.0, 0.0), (9.2, 9.0, 0.0)])]
    got = accounts.replay_fold(spark.createDataFrame(rows, "date date, symbol string, open double, close double, target double"), 100.0, 0.0).orderBy("date").collect()
    assert [r.position for r in got] == [0, 0, 1, 1, 1] and [round(r.equity, 9) for r in got] == [100, 100, 100.1, 100.1, 98.6]


def test_split_borrows_bars_for_warm_up(spark):
    df = spark.createDataFrame(panel(50), "account string, date date, symbol string, open double, close double, target double")
    inside, outside = backtest.split_with_warm_up(df, 0.7, 10)
    assert inside.select("date").distinct().count() == 35
    assert outside.select("date").distinct().count() == 25 and outside.where("warm").select("date").distinct().count() == 10


def test_replay_fold_keeps_orders_at_the_limit(spark):
    rows = [(START + datetime.timedelta(i), "s", o, c, t) for i, (o, c, t) in enumerate([(10.0, 10.0, 1.0), (11.0, 10.5, 1.0), (10.4, 10.4, 0.0), (9.0, 9.1, 0.0), (9.2, 9.0, 0.0)])]
    got = accounts.replay_fold(spark.createDataFrame(rows, "date date, symbol string, open double, close double, target double"), 100.0, 0.0, 0.1).orderBy("date").collect()
    assert [r.position for r in got] == [0, 0, 1, 1, 0] and got[-1].equity == pytest.approx(100 - 10.4 + 9.2)


@pytest.mark.parametrize("scale", [1e-12, 1e-6, 1.0, 1e6, 1e12])
def test_ranks_at_any_scale_against_pandas(spark, scale):
    rng = random.Random(7)
    values = [rng.randrange(1, 60) * scale for _ in range(80)]
    df = spark.createDataFrame([(START + datetime.timedelta(i // 2), "st"[i % 2], v) for i, v in enumerate(values)], "date date, symbol string, close double")
    full = df.selectExpr("date", "symbol", "close as open", "close as high", "close as low", "close", "close as volume", "close as amount", "close as oi")
    got = with_factors(full, {"r": "ts_rank(close,5)", "m": "ts_arg_max(close,5)", "c": "rank(close)"}, fill=False).toPandas().sort_values(["symbol", "date"])
    frame = pd.DataFrame({"date": [START + datetime.timedelta(i // 2) for i in range(80)], "symbol": ["st"[i % 2] for i in range(80)], "x": [round(v / scale) for v in values]}).sort_values(["symbol", "date"])
    by = frame.groupby("symbol")["x"]
    assert got["r"].tolist() == pytest.approx(by.transform(lambda s: s.rolling(5, min_periods=1).apply(lambda w: (w > w.iloc[-1]).mean())).tolist())
    assert got["m"].tolist() == pytest.approx(by.transform(lambda s: s.rolling(5, min_periods=1).apply(lambda w: 5 - 1 - w.to_numpy().argmax())).tolist())
    assert got["c"].tolist() == pytest.approx(frame.groupby("date")["x"].rank(pct=True).tolist())


def test_sums_that_differ_in_the_last_bits_are_ties(spark):
    rows = [(START, s, v) for s, v in (("a", 0.1 + 0.2), ("b", 0.3), ("c", 0.5))]
    df = spark.createDataFrame(rows, "date date, symbol string, close double").selectExpr("date", "symbol", "close as open", "close as high", "close as low", "close", "close as volume", "close as amount", "close as oi")
    got = {r.symbol: r.c for r in with_factors(df, {"c": "rank(close)"}).collect()}
    assert got["a"] == got["b"] < got["c"]


@pytest.mark.parametrize("text", ["own_rank(close,-3)", "ewm(close,0)", "ewm(close,2)", "scale(close,1,-5)", "scale(close,1,0)", "ema(close,0)"])
def test_windows_that_make_no_sense(text):
    with pytest.raises(FormulaError):
        parse(text, "single")


def test_upserts_do_not_hang_on_partitions(spark):
    old = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 1.0)], "k string, seq int, v double")
    new = spark.createDataFrame([("a", 5, 2.0), ("a", 7, 1.5), ("c", 1, 9.0)], "k string, seq int, v double")
    for n in (1, 3):
        got = sorted(tuple(r) for r in bars.upserted(old, new.repartition(n), ["k"], "seq").collect())
        assert got == [("a", 7, 1.5), ("b", 1, 1.0), ("c", 1, 9.0)]


def test_holidays_and_open_days(spark):
    lines = spark.createDataFrame([("2024-01-01 2024-02-12  # new year",), ("# 2024-03-01",), ("nothing 2024-13-01",), ("",)], "value string")
    closed = sessions.holidays(lines)
    assert sorted(str(r.day) for r in closed.collect()) == ["2024-01-01", "2024-02-12"]
    days = spark.sql("SELECT explode(sequence(DATE '2024-01-01', DATE '2024-01-07')) AS day")
    assert [r.is_open for r in sessions.open_days(days, closed).orderBy("day").collect()] == [False, True, True, True, True, False, False]


def test_symbols_without_an_exchange(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("a.b.SSE",), ("ab",), (None,)], "s string")
    assert [tuple(r) for r in rows.select(*upkeep.symbol_parts(F.col("s"))).collect()] == [("a.b", "SSE"), (None, None), (None, None)]
