import datetime
import random

import numpy as np
import pytest

from barweave.streaming import states

T0 = datetime.datetime(2024, 1, 2, 9, 0)


@pytest.fixture()
def stored(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, states.PROVIDER)
    yield spark
    spark.conf.set(key, old)


def feed(spark, folder, batches, schema, make, out, check):
    """Every batch is a run of its own: the stream is stopped after it and goes on from its checkpoint."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/b{i}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        states.run_into(make(stream), out, check)
    return spark.read.parquet(out).collect()


def test_orders_over_restarts_and_their_deadlines(stored, tmp_path):
    s = lambda sec: T0 + datetime.timedelta(seconds=sec)
    batches = [
        [("a", s(0), "SUBMITTING", 0.0), ("b", s(1), "NOT_TRADED", 0.0), ("c", s(2), "PART_TRADED", 3.0)],
        [("a", s(5), "PART_TRADED", 2.0), ("a", s(4), "NOT_TRADED", 0.0), ("c", s(6), "PART_TRADED", 2.0)],
        [("a", s(9), "ALL_TRADED", 5.0), ("d", s(200), "SUBMITTING", 0.0)],
        [("d", s(400), "CANCELLED", 0.0)],
        [("e", s(900), "NOT_TRADED", 0.0)],
    ]
    got = feed(stored, str(tmp_path), batches, "order_id string, ts timestamp, status string, traded double", lambda x: states.orders(x, 60, "10 seconds"), str(tmp_path / "out"), str(tmp_path / "check"))
    by = {}
    for r in sorted(got, key=lambda r: r.at):
        by.setdefault(r.order_id, []).append((r.status, r.traded))
    assert by["a"] == [("SUBMITTING", 0.0), ("PART_TRADED", 2.0), ("ALL_TRADED", 5.0)]
    assert by["b"] == [("NOT_TRADED", 0.0), ("TIMEOUT", 0.0)]
    assert by["c"] == [("PART_TRADED", 3.0), ("TIMEOUT", 3.0)]
    assert by["d"][0] == ("SUBMITTING", 0.0) and ("CANCELLED", 0.0) in by["d"] and by["e"] == [("NOT_TRADED", 0.0)]


def test_rolling_bars_over_restarts_are_the_batch_result(stored, tmp_path):
    rng = random.Random(2)
    rows = [(f"s{i % 2}", T0 + datetime.timedelta(minutes=i // 2), round(rng.uniform(90, 110), 2)) for i in range(60)]
    got = feed(stored, str(tmp_path), [rows[:7], rows[7:31], rows[31:60]], "symbol string, ts timestamp, close double", lambda x: states.rolling(x, 5), str(tmp_path / "out"), str(tmp_path / "check"))
    for symbol in ("s0", "s1"):
        closes = [c for s, _, c in rows if s == symbol]
        mine = sorted((r for r in got if r.symbol == symbol), key=lambda r: r.at)
        assert len(mine) == 30
        for i, r in enumerate(mine):
            window = closes[max(0, i - 4) : i + 1]
            assert (r.n, r.mean, r.high, r.low) == (len(window), pytest.approx(np.mean(window)), max(window), min(window))
            assert r.std == pytest.approx(np.std(window)) if len(window) == 5 else r.std is None or r.std != r.std
