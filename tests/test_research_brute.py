"""Research operators that SQL cannot express, against plain numpy on whole panels."""

import datetime
import random

import numpy as np
import pandas as pd
import pytest

from barweave.operators import research, validation

START = datetime.date(2024, 1, 1)
SYMBOLS = [f"s{i:02d}" for i in range(14)]


@pytest.fixture(scope="module")
def panel():
    rng = random.Random(3)
    rows = []
    for d in range(12):
        for s in SYMBOLS:
            a, b = rng.gauss(0, 1), rng.gauss(0, 1)
            hole = rng.random() < 0.06
            rows.append((START + datetime.timedelta(d), s, a + 0.3 * b, b, 0.5 * a + rng.gauss(0, 1), None if hole else 0.02 * a - 0.01 * b + rng.gauss(0, 0.01), rng.uniform(0.5, 3)))
    return pd.DataFrame(rows, columns=["date", "symbol", "x", "y", "z", "fwd", "w"])


@pytest.fixture(scope="module")
def frame(spark, panel):
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in panel.itertuples(index=False)]
    return spark.createDataFrame(rows, "date date, symbol string, x double, y double, z double, fwd double, w double").repartition(3)


def test_factor_returns_against_normal_equations(frame, panel):
    got = {(r.date, r.factor): (r.ret, r.r2) for r in research.factor_returns(frame, "fwd", ["x", "y"], "w").collect()}
    for date, part in panel.dropna().groupby("date"):
        w = np.diag(part["w"].to_numpy())
        m = np.column_stack([np.ones(len(part)), part["x"], part["y"]])
        y = part["fwd"].to_numpy()
        beta = np.linalg.inv(m.T @ w @ m + 1e-6 * np.eye(3)) @ (m.T @ w @ y)
        r2 = 1 - ((y - m @ beta) ** 2).sum() / ((y - y.mean()) ** 2).sum()
        for name, b in zip(("market", "x", "y"), beta, strict=True):
            assert got[date, name] == pytest.approx((b, r2), rel=1e-8, abs=1e-12)
    assert len(got) == 3 * 12


def test_orthogonalised_columns_are_uncorrelated_and_span_the_same(frame, panel):
    got = research.orthogonalised(frame, ["x", "y", "z"]).toPandas().sort_values(["date", "symbol"])
    for date, part in got.groupby("date"):
        q = part[["x", "y", "z"]].to_numpy()
        assert np.allclose(q.T @ q / len(q), np.eye(3), atol=1e-9)
        raw = panel[panel["date"] == date].sort_values("symbol")[["x", "y", "z"]].to_numpy()
        raw = raw - raw.mean(axis=0)
        r = np.linalg.lstsq(q, raw, rcond=None)[0]
        assert np.allclose(q @ r, raw) and np.allclose(np.tril(r, -1), 0, atol=1e-9) and (np.diag(r) > 0).all()


def test_neutralised_factors_are_residuals(frame, panel):
    got = research.neutralised_by_styles(frame, "z", ["x", "y"]).toPandas().set_index(["date", "symbol"])["value"]
    for date, part in panel.groupby("date"):
        y = part["z"].clip(part["z"].quantile(0.01), part["z"].quantile(0.99)).to_numpy()
        m = np.column_stack([np.ones(len(part)), part["x"], part["y"]])
        want = y - m @ np.linalg.pinv(m) @ y
        assert np.allclose(got.loc[date].loc[part["symbol"]].to_numpy(), want, atol=1e-9)


def test_draws_have_the_moments_of_their_series(frame, spark, panel):
    rows = spark.createDataFrame([(START + datetime.timedelta(i), 0.001 * (i % 7 - 3)) for i in range(140)], "date date, r double")
    paths = validation.monte_carlo(rows, "r", 300).toPandas()
    assert len(paths) == 300 and (paths["drawdown"] <= 0).all() and (paths["total"] > -1).all()
    logs = np.log1p(paths["total"])
    one = np.log1p(0.001 * (np.arange(140) % 7 - 3))
    assert abs(logs.mean() - 140 * one.mean()) < 4 * one.std() * 140**0.5 / 300**0.5
    assert logs.std() == pytest.approx(one.std() * 140**0.5, rel=0.2)
    again = validation.monte_carlo(rows, "r", 300).toPandas()
    assert paths.sort_values("path")["total"].tolist() == again.sort_values("path")["total"].tolist()
    low, high = validation.bootstrap_interval(rows, "r").first()
    assert low < one.mean() < high and high - low == pytest.approx(2 * 1.96 * 0.002 / 140**0.5, rel=0.25)


def test_deflated_sharpe_falls_with_trials():
    chances = [validation.deflated_sharpe(0.1, 500, n, 0.002) for n in (1, 10, 100)]
    assert chances[0] > 0.98 and chances == sorted(chances, reverse=True)
    assert validation.deflated_sharpe(0.1, 1, 5, 0.002) == 0.0


def test_look_ahead_is_told(spark):
    ic = lambda v: spark.createDataFrame([(START, v), (START + datetime.timedelta(1), -v)], "date date, rank_ic double")
    assert validation.look_ahead(ic(0.97), ic(0.02)).first().suspect is True
    assert validation.look_ahead(ic(0.1), ic(0.05)).first().suspect is False
