import random

import pytest

import corpus_pipeline
from barweave.llm import common, nearcopies, simhash
from barweave.llm.graph import components


def test_look_up_with_one_key_on_half_of_the_rows(spark):
    rng = random.Random(1)
    rows = [(i, 7 if i % 2 else rng.randrange(900) if i % 10 else None) for i in range(5000)]
    table = [(k, f"v{k}") for k in range(0, 900, 3)] + [(7, "hot")]
    left = common.written(spark.createDataFrame(rows, "i int, k int"), "rows")
    got = {r.i: r.v for r in common.left_joined(left, spark.createDataFrame(table, "k int, v string"), "k").collect()}
    known = dict(table)
    assert got == {i: known.get(k) for i, k in rows}


def test_a_shared_folder_is_needed_off_one_machine():
    class Context:
        applicationId, master = "app-x", "spark://host:7077"

    class Session:
        sparkContext = Context

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_folder(Session)


def test_a_star_and_a_chain_in_one_component(spark, monkeypatch):
    from barweave.llm import graph

    edges = [(0, i) for i in range(1, 3000)] + [(2999 + i, 3000 + i) for i in range(40)]
    for most in (50_000, 0):  # moved roots by broadcast, and dealt into parts
        monkeypatch.setattr(graph, "BROADCAST", most)
        got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert set(got.values()) == {0} and len(got) == 3040


def test_stages_take_clashing_names_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    names = "doc_id long, text string, row string, node int, fp int, fp_ int, root string, band string, d string"
    rows = [(1, text, "a", 1, 2, 3, "b", "c", "d"), (1, text, "a", 1, 2, 3, "b", "c", "d"), (2, text + " x", "e", 1, 2, 3, "b", "c", "d"), (None, "alone it is", "f", 1, 2, 3, "b", "c", "d")]
    docs = spark.createDataFrame(rows, names)
    for keep in (nearcopies.keep_one, lambda d: corpus_pipeline.near_copies(spark, d, "")):
        out = keep(docs)
        assert out.columns == docs.columns and sorted(r.row for r in out.collect()) == ["a", "f"]
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns and sorted(r.row for r in out.collect()) in (["a", "f"], ["a", "e", "f"])


def test_fingerprint_of_a_very_long_text(spark):
    from tests.llm.test_simhash import brute_fingerprint

    long_text = " ".join(f"w{i % 977}" for i in range(150_000))
    got = simhash.fingerprints(spark.createDataFrame([(1, long_text), (2, "w1")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.fp % 2**64 for r in got} == {1: brute_fingerprint(long_text), 2: brute_fingerprint("w1")}
