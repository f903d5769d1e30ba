import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barweave.operators import gate, ranker, research

T0 = datetime.datetime(2024, 3, 1, 23, 59, 0)


def brute(orders, lim):
    """Verdicts of one account, by scanning all orders that passed before each."""
    out, passed = {}, []
    for o in sorted(orders, key=lambda o: (o["ts"], o["order_id"])):
        mine = [p for p in passed if p["symbol"] == o["symbol"]]
        first = next(x for x in sorted(orders, key=lambda x: (x["ts"], x["order_id"])) if x["symbol"] == o["symbol"])
        now = (first["held"] or 0.0) + sum(p["side"] * p["volume"] for p in mine)
        after = now + o["side"] * o["volume"]
        today = [p for p in passed if p["ts"].date() == o["ts"].date()]
        lately = [p for p in passed if p["ts"] > o["ts"] - datetime.timedelta(seconds=lim.within)]
        letters = "".join(c for c in o["symbol"].split(".")[0].upper() if c.isalpha())
        grows = abs(after) > abs(now) + 1e-9
        price = o["reference"] or o["price"]
        if o["halt"] == "HARD" or (o["halt"] == "SOFT" and o["offset"] == "OPEN" and grows):
            code = "HALTED"
        elif letters in lim.denied or o["symbol"] in lim.denied:
            code = "DENIED"
        elif lim.allowed and letters not in lim.allowed:
            code = "NOT_ALLOWED"
        elif not o["in_session"]:
            code = "CLOSED"
        elif grows and not lim.allow_open:
            code = "OPEN_FORBIDDEN"
        elif o["volume"] <= 0 or o["volume"] > lim.most_volume:
            code = "VOLUME"
        elif o["volume"] % lim.step:
            code = "STEP"
        elif o["price"] and abs(o["price"] / o["reference"] - 1) > lim.deviation:
            code = "PRICE"
        elif o["against"]:
            code = "SELF_TRADE"
        elif o["offset"] != "OPEN" and o["volume"] > abs(now):
            code = "CLOSE_VOLUME"
        elif grows and abs(after) > lim.most_position:
            code = "POSITION"
        elif grows and abs(after) * price * lim.size > lim.most_value:
            code = "VALUE"
        elif grows and (o["margin"] + (abs(after) - abs(now)) * price * lim.size * lim.margin_rate) / o["equity"] > lim.most_margin:
            code = "MARGIN"
        elif len(today) >= lim.a_day:
            code = "DAY_ORDERS"
        elif len(lately) >= lim.a_while:
            code = "RATE"
        elif sum(p["volume"] for p in today) + o["volume"] > lim.volume_a_day:
            code = "DAY_VOLUME"
        else:
            code = "PASS"
            passed.append(o)
        out[o["order_id"]] = code
    return out


def orders(seed, n=120):
    rng = random.Random(seed)
    at, rows = T0, []
    for i in range(n):
        at += datetime.timedelta(seconds=rng.choice([0, 1, 5, 20, 400]))
        reference = rng.uniform(90, 110)
        rows.append({
            "order_id": i, "account": f"a{seed}", "symbol": rng.choice(["rb2405.SHFE", "IF2406.CFFEX", "cu1.SHFE", "zz9.X"]), "ts": at, "side": rng.choice([-1, 1]), "offset": rng.choice(["OPEN", "OPEN", "CLOSE"]),
            "volume": float(rng.choice([0, 1, 2, 2, 4, 4, 6, 12, 20])), "price": rng.choice([0.0, reference * rng.uniform(0.93, 1.07)]), "reference": reference, "held": float(rng.randrange(-4, 5)), "equity": 10_000.0,
            "margin": rng.uniform(0, 4000), "halt": rng.choice([None] * 12 + ["SOFT", "HARD"]), "in_session": rng.random() > 0.05, "against": rng.random() < 0.04,
        })
    return rows


def test_gate_against_scanning_what_passed(spark):
    lim = gate.Limits(denied=frozenset({"ZZ"}), most_volume=12, step=2, deviation=0.05, most_position=14, most_value=1300.0, size=1.0, most_margin=0.5, margin_rate=0.5, a_day=14, volume_a_day=60.0, a_while=4, within=60)
    tight = gate.Limits(allowed=frozenset({"RB", "CU"}), allow_open=False, most_volume=50, step=1, deviation=0.5, most_position=99, most_value=1e9, most_margin=9.0, a_day=999, volume_a_day=1e9, a_while=999)
    rows = [o for seed in range(4) for o in orders(seed)]
    schema = "order_id long, account string, symbol string, ts timestamp, side int, offset string, volume double, price double, reference double, held double, equity double, margin double, halt string, in_session boolean, against boolean"
    names = [c.split()[0] for c in schema.split(", ")]
    df = spark.createDataFrame([tuple(o[c] for c in names) for o in rows], schema).repartition(5)
    seen = set()
    for limits in (lim, tight):
        got = {(r.account, r.order_id): r.code for r in gate.gated(df, limits).collect()}
        want = {(f"a{seed}", i): code for seed in range(4) for i, code in brute(orders(seed), limits).items()}
        assert got == want
        seen |= set(want.values())
    assert seen >= {"PASS", "HALTED", "DENIED", "NOT_ALLOWED", "CLOSED", "OPEN_FORBIDDEN", "VOLUME", "STEP", "PRICE", "SELF_TRADE", "CLOSE_VOLUME", "POSITION", "DAY_ORDERS", "RATE", "DAY_VOLUME"}


def test_orders_that_did_not_pass_take_no_place_in_the_limits(spark):
    rows = [(i, "a", "x", T0 + datetime.timedelta(seconds=i), 1, v) for i, v in enumerate([5.0, 50.0, 5.0, 5.0, None, 5.0])]
    df = spark.createDataFrame(rows, "order_id long, account string, symbol string, ts timestamp, side int, volume double")
    got = {r.order_id: (r.code, r.held) for r in gate.gated(df, gate.Limits(most_volume=10.0, a_while=3)).collect()}
    assert got == {0: ("PASS", 5.0), 1: ("VOLUME", 5.0), 2: ("PASS", 10.0), 3: ("PASS", 15.0), 4: ("INCOMPLETE", None), 5: ("RATE", 15.0)}
    assert gate.gated(df.limit(0), gate.Limits()).count() == 0


def plain_gradient(x, y, w, k):
    s = x @ w
    place = {i: p for p, i in enumerate(sorted(range(len(x)), key=lambda i: -s[i]))}
    d = lambda i: 1 / np.log2(place[i] + 2) if place[i] < k else 0.0
    gain = 2.0**y - 1
    ideal = sum(g / np.log2(p + 2) for p, g in enumerate(sorted(gain, reverse=True)[:k]))
    out = np.zeros(x.shape[1])
    for i in range(len(x)):
        for j in range(len(x)):
            if y[i] > y[j]:
                weight = abs((gain[i] - gain[j]) * (d(i) - d(j))) / ideal
                out += weight / (1 + np.exp(s[i] - s[j])) * (x[i] - x[j])
    return out


@pytest.mark.parametrize("n, k", [(12, 3), (4, 9), (30, 5), (1, 2)])
def test_gradient_against_all_pairs(n, k):
    rng = np.random.default_rng(n)
    x, y, w = rng.normal(size=(n, 3)), rng.integers(0, 5, n).astype(float), rng.normal(size=3)
    if not y.any():
        y[0] = 1
    assert ranker.date_gradient(x, y, w, k) == pytest.approx(plain_gradient(x, y, w, k))
    assert not ranker.date_gradient(x, np.zeros(n), w, k).any()


def test_ranker_is_above_the_regression_on_later_dates(spark):
    rng = random.Random(4)
    rows = []
    for d in range(60):
        for s in range(20):
            a, b = rng.gauss(0, 1), rng.gauss(0, 1)
            # What is best hangs on a; how bad the bad ones are, which is most of the variance, on b.
            top = a + 0.4 * rng.gauss(0, 1)
            rows.append((datetime.date(2024, 1, 1) + datetime.timedelta(d), f"s{s:02}", a, b, top if top > 0.5 else -0.5 - 8 * abs(b) * (b < 0) + 0.2 * rng.gauss(0, 1)))
    df = spark.createDataFrame(rows, "date date, symbol string, a double, b double, fwd double")
    df = research.bucketed(df, "fwd", 5, 5).select("date", "symbol", "a", "b", "fwd", "bucket")
    early = F.col("date") < datetime.date(2024, 2, 10)
    w = ranker.fitted(df.where(early), ["a", "b"], "bucket", 5)
    surrogate = ranker.least_squares(df.where(early), ["a", "b"], "fwd")
    later = df.where(~early)
    mean = lambda weights: research.ndcg(ranker.scored(later, ["a", "b"], weights), "score", "bucket", 5).agg(F.avg("ndcg")).first()[0]
    assert mean(w) > mean(surrogate) + 0.02
    assert not ranker.fitted(df.limit(0), ["a", "b"], "bucket").any()


def test_fits_and_scores_of_the_ranker_query_do_not_read_the_shipments_again(spark, monkeypatch):
    from barweave.plans import mining_queries

    read = []
    for name in ("fitted", "least_squares", "scored"):
        def watched(rows, *args, make=getattr(ranker, name)):
            read.append(rows._jdf.queryExecution().withCachedData().toString())
            return make(rows, *args)

        monkeypatch.setattr(ranker, name, watched)
    mining_queries.QUERIES["research_ranker"](spark, "/root/testdata/sf0.001")
    assert len(read) == 4 and all("InMemoryRelation" in plan for plan in read)
    spark.catalog.clearCache()
