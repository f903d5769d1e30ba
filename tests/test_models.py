import datetime
import itertools
import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barweave.operators import accounts, formula_search, lattice, validation
from barweave.operators import multifactor as mf
from tests.test_mining import NAMES, START, bars

SPECS = (mf.Spec("a", "delta(close,1)/close", 1.0), mf.Spec("twin", "-2*delta(close,1)/close", -0.9), mf.Spec("b", "volume/mean(volume,5)", 0.3), mf.Spec("flat", "close*0", 0.8))


@pytest.fixture(scope="module")
def panel(spark):
    return spark.createDataFrame(bars(50, 3), NAMES).cache()


def test_model_against_pandas(spark, panel):
    z = mf.signals(panel, SPECS)
    by = mf.kept(z, SPECS, 0.7)
    got = mf.scores(z, SPECS, by).toPandas().sort_values(["symbol", "date"])
    plain = mf.scores(z, SPECS).toPandas().sort_values(["symbol", "date"])
    frame = panel.toPandas().sort_values(["symbol", "date"])
    for symbol, part in frame.groupby("symbol"):
        part = part.reset_index(drop=True)
        raw = {"a": part["close"].diff() / part["close"], "b": part["volume"] / part["volume"].rolling(5, min_periods=1).mean(), "flat": part["close"] * 0}
        raw["twin"] = -2 * raw["a"]
        made = z.where(F.col("symbol") == symbol).toPandas().sort_values("date")
        m = pd.DataFrame({s.name: made[s.name].to_numpy() for s in SPECS})
        e = raw["a"].expanding()
        assert made["a"].to_numpy()[-1] == pytest.approx(((raw["a"] - e.mean()) / e.std()).fillna(0).to_numpy()[-1])
        corr = m.corr().abs().fillna(0)
        keep = []
        for i in sorted(range(4), key=lambda i: -abs(SPECS[i].weight)):
            if all(corr.iloc[i, k] < 0.7 for k in keep):
                keep.append(i)
        assert by.where(F.col("symbol") == symbol).first().kept == sorted(keep) == [0, 2, 3]
        weights = np.array([SPECS[i].weight for i in keep])
        want = m.iloc[:, keep].to_numpy() @ weights / np.abs(weights).sum()
        assert got[got["symbol"] == symbol]["score"].to_numpy() == pytest.approx(want)
        every = np.array([s.weight for s in SPECS])
        assert plain[plain["symbol"] == symbol]["score"].to_numpy() == pytest.approx(m.to_numpy() @ every / np.abs(every).sum())


def test_what_is_kept_may_be_learned_from_early_dates_only(spark, panel):
    z = mf.signals(panel, SPECS)
    early = F.col("date") < START + datetime.timedelta(20)
    other = z.withColumn("b", F.when(early, F.col("b")).otherwise(F.col("a")))
    assert {r.symbol: r.kept for r in mf.kept(z, SPECS, 0.7, early).collect()} == {r.symbol: r.kept for r in mf.kept(other, SPECS, 0.7, early).collect()}


def test_targets_hold_between_two_bounds(spark):
    path = [0.0, 0.6, 0.3, 0.15, 0.3, -0.3, -0.6, -0.3, 0.3, 0.7, -0.3, -0.1]
    scored = spark.createDataFrame([(START + datetime.timedelta(i), "s", v) for i, v in enumerate(path)], "date date, symbol string, score double")
    plain = [r.target for r in mf.targets(scored, 0.5, size=2.0).orderBy("date").collect()]
    assert plain == [0, 2, 0, 0, 0, 0, -2, 0, 0, 2, 0, 0]
    held = [r.target for r in mf.targets(scored, 0.5, 0.2).orderBy("date").collect()]
    state, want, before = 0, [], 0.0
    for v in path:
        state = 1 if v > 0.5 else -1 if v < -0.5 else 0 if abs(v) < 0.2 or v * before < 0 else state
        want.append(state)
        before = v
    assert held == want and 1 in want and -1 in want


def test_shuffled_bars_are_the_same_bars_on_the_same_dates(spark, panel):
    rows = validation.shuffled(panel, 5, 7).toPandas()
    real = panel.toPandas().sort_values(["symbol", "date"])
    orders = set()
    for (symbol, replicate), part in rows.groupby(["symbol", "replicate"]):
        part, own = part.sort_values("date"), real[real["symbol"] == symbol]
        assert part["date"].tolist() == own["date"].tolist()
        assert sorted(zip(part["open"], part["close"])) == sorted(zip(own["open"], own["close"]))
        assert (part["close"].tolist() == own["close"].tolist()) == (replicate == 0)
        orders.add(tuple(part["close"]))
    assert len(orders) == 3 * 6
    again = validation.shuffled(panel.repartition(7), 5, 7).toPandas().sort_values(["symbol", "replicate", "date"])["close"].tolist()
    assert again == rows.sort_values(["symbol", "replicate", "date"])["close"].tolist()


def test_shuffle_noise_by_hand_and_a_strategy_that_knows_the_next_bar(spark, panel):
    def knows(df):
        from pyspark.sql import Window as W

        ahead = F.lead("next").over(W.partitionBy("symbol").orderBy("date"))
        rows = df.withColumn("next", F.col("close") - F.col("open"))
        return rows.select("date", "symbol", F.signum(F.coalesce(ahead, F.lit(0.0))).alias("position"))

    for strategy in (lambda df: validation.momentum_signal(df, 5, 0.01), knows):
        got = {r.symbol: r for r in validation.shuffle_noise(panel, strategy, 12, 3, 1000.0, 0.001).collect()}
        rows = validation.shuffled(panel, 12, 3).toPandas()
        for symbol, mine in rows.groupby("symbol"):
            totals = {}
            for replicate, part in mine.groupby("replicate"):
                df = spark.createDataFrame(part.sort_values("date")[panel.columns], NAMES)
                run = accounts.replay_targets(df.join(strategy(df).withColumnRenamed("position", "target"), ["date", "symbol"]), 1000.0, 0.001)
                totals[replicate] = run.orderBy(F.desc("date")).first().equity / 1000 - 1
                if replicate == 3:
                    break
            r = got[symbol]
            assert totals[0] == pytest.approx(r.real) and r.n_shuffles == 12 and r.no_lookahead == (r.real <= r.mean + 2 * r.std)
            break
    assert all(r.real > 0 for r in got.values())


def test_grids_from_defaults_and_their_size():
    grid = lattice.auto_grid({"fast": 10, "one": 1, "k": 2.0, "size": 5, "flag": True, "name": "x", "zero": 0, "slow": 30, "more": 7})
    assert grid == {"fast": [5, 10, 20], "one": [1, 2], "k": [1.0, 2.0, 3.0], "slow": [15, 30, 60]}
    small = lattice.shrunk(grid, 20)
    assert np.prod([len(v) for v in small.values()]) <= 20 and all(small[k][0] == grid[k][0] and small[k][-1] == grid[k][-1] for k in small)
    assert lattice.shrunk({"a": [1, 2], "b": [3, 4], "c": [5, 6]}, 5) == {"a": [1, 2], "b": [3, 4]}
    assert lattice.shrunk({"a": list(range(9))}, 4) == {"a": [0, 1, 2, 3]} and lattice.shrunk({}, 4) == {}


def test_plateaus_against_a_plain_loop(spark):
    rng = random.Random(2)
    grid = {"a": [1, 2, 3, 4], "b": [0.5, 1.0, 1.5], "c": [7]}
    at = {p: rng.uniform(-0.5, 2) for p in itertools.product(range(4), range(3), range(1)) if rng.random() < 0.9}
    points = lattice.points(spark, grid)
    assert points.count() == 12 and {tuple(r.at): (r.a, r.b, r.c) for r in points.collect()}[3, 0, 0] == (4.0, 0.5, 7.0)
    results = points.join(spark.createDataFrame([(list(p), v) for p, v in at.items()], "at array<int>, sharpe double"), "at")
    top = max(at.values())
    for r in lattice.plateau(results, 3, least=0.6).collect():
        p = tuple(r.at)
        near = [v for q, v in at.items() if sum(abs(x - y) for x, y in zip(p, q)) == 1]
        median = statistics.median(near) if near else None
        assert (r.neighbours, r.median) == (len(near), pytest.approx(median) if near else None)
        assert r.ok == (at[p] > 0 and (not near or median / at[p] >= 0.6)) and r.best == (at[p] == top)
    with pytest.raises(ValueError):
        lattice.points(spark, {"a": list(range(61))})
    with pytest.raises(ValueError):
        lattice.points(spark, {})


def test_tree_with_room_for_all_is_the_exhaustive_search(spark, panel, monkeypatch):
    monkeypatch.setattr(formula_search, "WINDOWS", (2, 3))
    monkeypatch.setattr(formula_search, "WRAPS", ("rank({})", "-({})"))
    seed = "mean(close,2)/close"
    every, level = {seed}, [seed]
    for _ in range(2):
        level = [f for g in level for f in formula_search.proposals(g) if f not in every]
        every |= set(level)
    tree = formula_search.tree_searched(panel, seed, 2, 99, 99).collect()
    assert {r.formula for r in tree} == every and len(tree) == len(every)
    means = {r["name"]: r["mean"] for r in formula_search.batch_report(panel, {f: f for f in sorted(every)}).collect()}
    assert {r.formula: r.mean for r in tree} == pytest.approx({f: means.get(f) for f in every})
    best = max(means.values())
    assert max(r.mean for r in tree if r.mean is not None) == pytest.approx(best)
    narrow = formula_search.tree_searched(panel, seed, 2, 99, 1).collect()
    assert sum(r.kept for r in narrow) <= 3 and {r.parent for r in narrow if r.level == 2} == {r.formula for r in narrow if r.level == 1 and r.kept}
    first = [r.mean for r in narrow if r.level == 1 and r.mean is not None]
    assert [r.mean for r in narrow if r.level == 1 and r.kept] == [max(first)]
    chain = formula_search.chain_searched(panel, seed, 3, 99).collect()
    steps = [r.mean for r in sorted(chain, key=lambda r: r.level) if r.kept]
    assert steps == sorted(steps) and len(chain) == len({r.formula for r in chain})


def test_generations_of_the_evolution(spark, panel):
    out = formula_search.evolved(panel, ["mean(close,5)/close", "-delta(close,3)"], 2, 2, 3, seed=4).collect()
    means = {r["name"]: r["mean"] for r in formula_search.batch_report(panel, {r.formula: r.formula for r in out}).collect()}
    assert {r.formula: r.mean for r in out} == pytest.approx({r.formula: means.get(r.formula) for r in out})
    assert len({r.formula for r in out}) == len(out) and {r.generation for r in out} == {0, 1, 2}
    for g in (1, 2):
        before = {r.formula: r.mean for r in out if r.generation < g and r.mean is not None}
        parents = sorted(before, key=lambda f: (-before[f], f))[:2]
        steps = {c for p in parents for c in formula_search.proposals(p)} | {w.format(p) for p in parents for w in formula_search.WRAPS}
        windows = lambda f: __import__("re").sub(r",\d+\)", ",n)", f)
        assert all(r.formula in steps or any(windows(r.formula) == windows(p) for p in parents) for r in out if r.generation == g)


def test_composite_score_by_hand(spark):
    import math

    from barweave.operators import research

    rows = [(0.03, 0.4, 1.2, 0.15, -0.1, 0.8, 3.0), (None, None, None, None, None, None, None), (-0.2, -2.0, -3.0, -0.9, -0.6, -1.0, 40.0)]
    names = ("mean_ic", "ir", "sharpe", "annual", "max_drawdown", "monotonicity", "turnover")
    got = research.composite_score(spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))).collect()
    sig = lambda x, s: 0.5 if x is None else 1 / (1 + math.exp(-2 * x / s))
    for r in got:
        less = lambda x, s: 0.5 if x is None else 1 - sig(x, s)
        mono = 0.5 if r.monotonicity is None else min(1.0, abs(r.monotonicity))
        drawdown = None if r.max_drawdown is None else abs(r.max_drawdown)
        want = 0.30 * sig(r.mean_ic, 0.05) + 0.15 * sig(r.ir, 0.5) + 0.20 * sig(r.sharpe, 1) + 0.15 * sig(r.annual, 0.3) + 0.10 * less(drawdown, 0.2) + 0.05 * mono + 0.05 * less(r.turnover, 10)
        assert r.composite == pytest.approx(want)


def test_a_learned_factor_is_fitted_on_early_dates_only(spark, panel):
    from barweave.operators import attribution, research

    rows = research.forward_return(panel).withColumn("f", F.col("close") / F.col("open") - 1).select("date", "symbol", "fwd", "f")
    cut = START + datetime.timedelta(40)
    other = rows.withColumn("fwd", F.when(F.col("date") >= cut, -5 * F.col("fwd")).otherwise(F.col("fwd")))
    a, b = ({(r.date, r.symbol): r.score for r in attribution.learned_factor(x, ["f"], "fwd", 1, 0.7, 3).collect()} for x in (rows, other))
    assert a == pytest.approx(b) and len(a) > 100
