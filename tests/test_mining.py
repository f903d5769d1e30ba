import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barweave.operators import composite as c
from barweave.operators import mining, research
from barweave.operators.stored import Stored, content_key

START = datetime.date(2024, 1, 1)
NAMES = "date date, symbol string, open double, high double, low double, close double, volume double, amount double, oi double"
POOL = {"reversal": "-delta(close,2)/close", "twin": "-2*delta(close,2)/close", "activity": "volume/mean(volume,5)", "range": "(high-low)/close"}


def bars(n_dates=60, n_symbols=8, seed=5):
    rng = random.Random(seed)
    out = []
    for s in range(n_symbols):
        level = 100.0
        for i in range(n_dates):
            close = 100 + 0.5 * (level - 100) + rng.gauss(0, 3)
            out.append((START + datetime.timedelta(i), f"s{s}", level, max(level, close) + rng.random(), min(level, close) - rng.random(), close, 1000 * rng.random() + 1, close * 1000, 1.0))
            level = close
    return out


@pytest.fixture(scope="module")
def panel(spark):
    return spark.createDataFrame(bars(), NAMES).cache()


def after(panel, day, how):
    """The panel with another close from ``day`` on."""
    return panel.withColumn("close", F.when(F.col("date") >= day, how).otherwise(F.col("close")))


def test_no_later_date_moves_what_is_fitted(spark, panel):
    later = START + datetime.timedelta(36)  # the first date after the train part
    other = after(panel, later, F.col("close") * (1 + F.rand(3)))
    for scheme in c.SCHEMES:
        a, b = ({r["name"]: r.weight for r in c.fitted_weights(c.parted(p, POOL), list(POOL), scheme).collect()} for p in (panel, other))
        assert a == pytest.approx(b, abs=1e-15) and sum(a.values()) == pytest.approx(1)
    settings = mining.Settings(least_ic=0.0)
    a, b = (sorted(map(tuple, mining.chosen(c.parted(p, POOL), POOL, settings).collect())) for p in (panel, other))
    assert a == b and {r[0]: r[2] for r in a}["twin"] == {r[0]: r[2] for r in a}["reversal"]
    # A return that ends in the next part is nobody's.
    ends = c.parted(panel, POOL).groupBy("part").agg(F.max(F.when(F.col("fwd").isNotNull(), F.col("date"))).alias("d"))
    assert {r.part: (r.d - START).days for r in ends.collect()} == {"train": 34, "valid": 46, "test": 58}


def test_earlier_dates_do_move_it(spark, panel):
    other = after(panel, START + datetime.timedelta(30), F.col("close") * (1 + F.rand(3)))
    a, b = ({r["name"]: r.weight for r in c.fitted_weights(c.parted(p, POOL), list(POOL), "icir").collect()} for p in (panel, other))
    assert a != b


def test_weights_against_numpy(spark, panel):
    names = list(POOL)
    rows = c.parted(panel, POOL)
    frame = rows.where("part = 'train'").toPandas()
    z = frame.copy()
    for n in names:
        by = frame.groupby("date")[n]
        z[n] = ((frame[n] - by.transform("mean")) / by.transform("std")).clip(-3, 3).fillna(0.0)
    cov = np.cov(z[names].to_numpy().T)
    got = {s: {r["name"]: r.weight for r in c.fitted_weights(rows, names, s).collect()} for s in c.SCHEMES}
    inverse = 1 / np.diag(cov)
    assert [got["inverse_variance"][n] for n in names] == pytest.approx(inverse / inverse.sum())
    raw = np.maximum(np.linalg.pinv(cov) @ np.ones(len(names)), 0)
    assert [got["least_variance"][n] for n in names] == pytest.approx(raw / raw.sum(), abs=1e-6)
    means = {}
    for n in names:
        ics = []
        for _, day in frame.dropna(subset=[n, "fwd"]).groupby("date"):
            if len(day) >= 3:
                ics.append(day[n].rank().corr(day["fwd"].rank()))
        means[n] = max(0.0, np.nanmean(ics) / np.nanstd(ics, ddof=1))
    assert [got["icir"][n] for n in names] == pytest.approx([means[n] / sum(means.values()) for n in names], abs=1e-9)
    assert set(got["equal"].values()) == {0.25}


def test_books_of_many_factors_are_the_books_of_each(spark, panel):
    rows = c.parted(panel, POOL)
    many = c.books(c.each(rows, list(POOL)), 3, 0.01)
    for n in POOL:
        one = research.long_short(rows.where(F.col("fwd").isNotNull()).select("date", "symbol", F.col(n).alias("value"), "fwd"), "value", "fwd", 3, 0.01)
        got = sorted((r.date, round(r.gross, 12), round(r.turnover, 12), round(r.net, 12), r.n) for r in many.where(F.col("name") == n).collect())
        assert got == sorted((r.date, round(r.gross, 12), round(r.turnover, 12), round(r.net, 12), r.n) for r in one.collect())
    long_only = c.books(c.each(rows, ["range"]), 3, 0.0, False)
    assert long_only.agg(F.max("n")).first()[0] < many.where("name = 'range'").agg(F.max("n")).first()[0]
    report = {r["name"]: r for r in c.book_report(many).collect()}
    perf = research.performance(many.where("name = 'range'").select("date", "net")).first()
    r = report["range"]
    assert (r.net_total, r.net_sharpe, r.net_max_drawdown, r.net_calmar, r.n) == pytest.approx((perf.total, perf.sharpe, perf.max_drawdown, perf.calmar, perf.n))
    assert r.cost_ratio == pytest.approx(max(0, r.total - r.net_total) / abs(r.total))


def test_a_broken_run_goes_on_and_later_settings_reuse_earlier_steps(spark, panel, tmp_path):
    folder = f"file://{tmp_path}"
    settings = mining.Settings(least_ic=0.0, k=3)
    plain = mining.mine(panel, POOL, settings)
    want = sorted(map(tuple, plain.book.collect()))
    first = mining.mine(panel, POOL, settings, folder)
    assert sorted(map(tuple, first.book.collect())) == want
    steps = sorted(p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir())
    assert steps == ["book", "chosen", "coefficients", "judged", "parted", "weights"]

    def made(run):
        before = {p.name for p in tmp_path.iterdir() if (p / "_SUCCESS").exists()}
        out = run()
        return out, sorted(p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir() if p.name not in before)

    again, new = made(lambda: mining.mine(panel, POOL, settings, folder))
    assert new == [] and sorted(map(tuple, again.book.collect())) == want
    # A table that was not finished is made again; one whose settings changed is made beside the old one.
    [p for p in tmp_path.iterdir() if p.name.startswith("book-")][0].joinpath("_SUCCESS").unlink()
    again, new = made(lambda: mining.mine(panel, POOL, settings, folder))
    assert new == ["book"] and sorted(map(tuple, again.book.collect())) == want
    _, new = made(lambda: mining.mine(panel, POOL, mining.Settings(least_ic=0.0, k=3, cost=0.01), folder))
    assert new == ["book", "judged"]
    _, new = made(lambda: mining.mine(panel.withColumn("close", F.col("close") + 1e-9), POOL, settings, folder))
    assert len(new) == 6


def test_gates_and_pools_of_which_nothing_passes(spark, panel):
    none = mining.mine(panel, POOL, mining.Settings(least_ic=2.0))
    assert none.book is None and none.steps.count() == 0 and none.chosen.count() == 0
    steps = {r["name"]: r.turnover for r in mining.mine(panel, POOL, mining.Settings(least_ic=0.0, k=3)).steps.collect()}
    least = min(steps.values())
    gated = mining.mine(panel, POOL, mining.Settings(least_ic=0.0, k=3, most_turnover=least + 1e-9))
    assert [r["name"] for r in gated.weights.collect()] == [n for n, t in steps.items() if t == least]
    assert gated.steps.count() == len(steps)


def test_content_keys(spark, panel):
    assert content_key(panel) == content_key(panel.repartition(5)) != content_key(panel.limit(100)) and content_key(panel.limit(0))
    assert content_key(panel.union(panel)) != content_key(panel)


def test_named_scores(spark, panel):
    with pytest.raises(KeyError):
        c.factor_scores(panel, "no_such_factor")
    a = c.factor_scores(panel, formula="ref(close,2)").where("score IS NOT NULL").count()
    assert a == 8 * 58
    assert isinstance(Stored(spark, "x/").folder, str)
