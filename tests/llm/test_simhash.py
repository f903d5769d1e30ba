import random

import numpy as np
import pytest

from barweave.llm import simhash
from barweave.llm.graph import components


def brute_fingerprint(text):
    import re

    import xxhash

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize("text", ["", " \n", "One", "One two", "One TWO three", "a b c d e", "ÄÖ é x", "a a a a a a", "tab\tline\x0bfeed\x0c x\x1cy z w v", "word " * 40000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) % (1 << 64) == brute_fingerprint(text)


def brute_groups(values, budget):
    seen, out = set(), {}
    for start in sorted(values):
        if start in seen:
            continue
        todo, group = [start], {start}
        while todo:
            x = todo.pop()
            near = {y for y in values if (x ^ y).bit_count() <= budget} - group
            group |= near
            todo += near
        seen |= group
        out |= {x: frozenset(group) for x in group}
    return out


@pytest.mark.parametrize("budget,blocks", [(2, 4), (1, 4)])
def test_near_pairs(spark, budget, blocks):
    rng = random.Random(budget)
    values = {0, 1, 3, (1 << 64) - 1}
    for _ in range(60):
        base = rng.getrandbits(64)
        values.add(base)
        for _ in range(rng.randrange(8)):
            base ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5)))
            values.add(base)
    hub = rng.getrandbits(64)
    values |= {hub ^ 1 << i for i in range(64)}
    signed = np.array(sorted(values), np.uint64).astype(np.int64).tolist()
    got = [tuple(r) for r in simhash.near_pairs(spark.createDataFrame([(v,) for v in signed], "fp long"), budget, blocks).collect()]
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % (1 << 64)).bit_count() <= budget}
    assert len(got) == len(set(got)) and set(got) == want


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 60)] + [(500, 500), (None, 3), (901, 900)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 1 for i in range(1, 60)} | {500: 500, 900: 900, 901: 900}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_against_brute_force(spark):
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "delta", "eps", "zeta", "eta", "théta"]
    texts = [None, "", " \t ", "one", "ONE"]
    for _ in range(12):
        base = [rng.choice(words) + str(rng.randrange(50)) for _ in range(400)]
        texts.append(" ".join(base))
        for _ in range(6):
            base = list(base)
            base[rng.randrange(400)] = "changed"
            texts += [" ".join(base)] * rng.randrange(1, 3)
    ids = rng.sample(range(1000), len(texts))
    docs = spark.createDataFrame([(i, t, 3, "x") for i, t in zip(ids, texts)], "doc_id long, text string, fp int, root string")
    got = {r.doc_id: r for r in simhash.groups(docs).collect()}
    fps = {i: brute_fingerprint(t or "") for i, t in zip(ids, texts)}
    groups = brute_groups(set(fps.values()), 2)
    for i in ids:
        assert got[i].fingerprint == f"{fps[i]:016x}"
        assert got[i].component_id == min(j for j in ids if fps[j] in groups[fps[i]])
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert kept == {r.component_id for r in got.values()}
    assert simhash.keep_one(docs).columns == docs.columns


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "other words here"), (None, "a b c"), (None, "lonely text it is"), (None, "lonely text it is")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.groups(docs).collect())
    assert got == [(-1, -1), (-1, -1), (-1, 1), (1, 1), (1, 1), (1, 1)]
    kept = sorted((r.doc_id or -1, r.text) for r in simhash.keep_one(docs).collect())
    assert kept == [(-1, "lonely text it is"), (1, "a b c"), (1, "other words here")]
    assert simhash.groups(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0
