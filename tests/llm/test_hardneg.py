import math
import os
import random

import pytest
from pyspark.sql import functions as F

from barweave.llm import hardneg, queries

DATA = "/root/testdata/sf0.001"


def brute(rows, is_anchor, n_positives=5, n_negatives=10):
    kept = {}
    for i, v, label in rows:
        if None in (i, v, label) or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept[i, label, tuple(math.floor(256 * x) for x in v)] = True
    out = []
    score = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731, B905
    for a_id, a_label, a in kept:
        if not is_anchor(a_id):
            continue
        rest = sorted((-score(a, v), i, label) for i, label, v in kept)
        positives = [(i, -s) for s, i, label in rest if label == a_label and i != a_id][:n_positives]
        for p, ps in positives:
            found = [(i, -s) for s, i, label in rest if label != a_label and 30 * ps <= -100 * s <= 90 * ps][:n_negatives]
            out += [(a_id, p, k + 1, i, ps, s) for k, (i, s) in enumerate(found)]
    return sorted(out)


def run(spark, rows, is_anchor=lambda i: i % 10 == 0, anchor=None, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = hardneg.mine(df, F.col("vec_id") % 10 == 0 if anchor is None else anchor, **more).collect()
    return sorted(map(tuple, got))


def made(n, dim, seed, labels=3, scale=1.0, ties=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        v = [rng.gauss(0, scale) for _ in range(dim)]
        v = [float(__import__("numpy").float32(x)) for x in v]
        rows.append((i, v, rng.randrange(labels)))
    for i in range(ties):
        rows.append((n + i, rows[i % 3][1], rng.randrange(labels)))
    return rows


@pytest.mark.parametrize("n, dim, labels, scale, ties", [(200, 8, 3, 1.0, 0), (200, 4, 2, 0.01, 0), (120, 3, 2, 1.0, 200), (60, 8, 1, 1.0, 0), (25, 8, 60, 1.0, 0), (80, 6, 3, 300.0, 0), (40, 4, 2, 30000.0, 5)])
def test_against_all_pairs(spark, n, dim, labels, scale, ties):
    rows = made(n, dim, n + dim, labels, scale, ties)
    assert run(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_blocks_and_salts_change_nothing(spark, monkeypatch):
    rows = made(400, 6, 5, ties=50)
    want = brute(rows, lambda i: i % 10 == 0)
    for name, value in (("BLOCK", 7), ("STEP", 5), ("CELLS", 60), ("BROADCAST", 0), ("HELD", 1)):
        monkeypatch.setattr(hardneg, name, value)
        assert run(spark, rows) == want


def test_nulls_repeats_and_lengths(spark):
    nan, inf = float("nan"), float("inf")
    rows = made(60, 3, 9)
    rows += [(None, [1.0, 1.0, 1.0], 1), (100, None, 1), (101, [1.0, None, 1.0], 1), (102, [nan, 1.0, 1.0], 0), (103, [inf, 1.0, 1.0], 0), (104, [1.0, 1.0, 1.0], None), (110, [0.5, 0.5], 1), (111, [], 0), (120, [], 1)]
    rows += rows[:5] + [(0, [0.25, 0.5, 0.75], 2), (3, [0.5, 0.5, 0.5], 1)]
    assert run(spark, rows) == brute(rows, lambda i: i % 10 == 0)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as id", "2 as vector", "true as anchor", "3 as block", "4 as place", "5 as n_")
    assert sorted(map(tuple, hardneg.mine(df, F.col("vec_id") % 10 == 0).collect())) == run(spark, rows)


def test_none(spark):
    rows = made(20, 3, 1)
    assert run(spark, []) == [] and run(spark, rows, anchor=F.lit(False)) == []


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_its_sql(spark, sf):
    import duckdb

    folder = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    cursor = con.execute(queries.ORACLE_SQL["op11_hardneg"])
    names = [d[0] for d in cursor.description]
    df = queries.QUERIES["op11_hardneg"](spark, folder)
    assert names == df.columns
    want = sorted(cursor.fetchall())
    assert want and sorted(map(tuple, df.collect())) == want
