import random
import re

import corpus_pipeline
from barweave.llm import nearcopies


def brute_set(text):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_kept(rows):
    sets = {i: brute_set(t) for i, t in rows}
    left, kept = set(sets), set()
    while left:
        todo, group = [min(left)], {min(left)}
        while todo:
            x = sets[todo.pop()]
            near = {j for j in left - group if len(x & sets[j]) >= 0.8 * len(x | sets[j])}
            group |= near
            todo += near
        kept.add(min(group))
        left -= group
    return kept


def planted():
    rng = random.Random(3)
    texts = [None, "", "one", "ONE", "one two"]
    for n in (60, 100, 248, 400):
        base = [f"w{rng.randrange(900)}" for _ in range(n)]
        texts.append(" ".join(base))
        for changes in (1, 2, n // 60 + 1, n // 40, n // 20, n // 10):
            other = list(base)
            for at in rng.sample(range(n), changes):
                other[at] = "changed"
            texts.append(" ".join(other))
    family = [f"f{rng.randrange(900)}" for _ in range(150)]
    for i in range(80):
        other = list(family)
        for at in rng.sample(range(150), rng.randrange(1, 6)):
            other[at] = f"x{i}"
        texts.append(" ".join(other))
    ids = rng.sample(range(1000), len(texts))
    return list(zip(ids, texts))


def test_near_copies_with_a_few_words_changed(spark):
    rows = planted()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string")
    got = corpus_pipeline.near_copies(spark, docs, "")
    assert got.columns == docs.columns
    assert {r.doc_id for r in got.collect()} == brute_kept(rows)


def test_large_groups_and_small_rounds_give_the_same(spark, monkeypatch):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for rounds, pairs in ((0, 2), (6, 0), (1, 0)):
        monkeypatch.setattr(nearcopies, "ROUNDS", rounds)
        monkeypatch.setattr(nearcopies, "PAIRS", pairs)
        assert {r.doc_id for r in nearcopies.keep_one(docs).collect()} == brute_kept(rows)


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "other words here"), (None, "a b c"), (None, "lonely text it is"), (None, "lonely text it is")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.text) for r in nearcopies.keep_one(docs).collect()) == [(-1, "lonely text it is"), (1, "a b c"), (1, "other words here")]
    assert nearcopies.keep_one(docs.limit(0)).count() == 0


def template(n, words=100, changed=3):
    rng = random.Random(n)
    base = [f"t{i}" for i in range(words)]
    rows = []
    for i in range(n):
        other = list(base)
        for at in rng.sample(range(words), changed):
            other[at] = f"x{i}.{at}"
        rows.append((i, " ".join(other)))
    return rows


def test_texts_of_one_template_that_are_no_near_copies_meet_in_pairs_that_grow_with_the_texts(spark, monkeypatch):
    made = []
    meeting = nearcopies._meeting

    def counted(rare):
        pairs = nearcopies.written(meeting(rare), "met")
        made.append((rare.count(), pairs.count()))
        return pairs

    monkeypatch.setattr(nearcopies, "_meeting", counted)
    for n in (250, 1000):
        rows = template(n)
        kept = {r.doc_id for r in nearcopies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        sets = [brute_set(t) for _, t in rows[:40]]
        assert max(len(a & b) / len(a | b) for a in sets for b in sets if a is not b) < 0.8 + 1e-9 or kept <= set(range(n))
        assert len(kept) > 0.9 * n
    assert all(pairs <= 20 * n for (_, pairs), n in zip(made, (250, 1000), strict=False))


def leaves_below(rng, keys=3, bases=6, each=7):
    """``key, node, root, n, top`` and eight words: families of fingerprints, of which some share their first words, some all."""
    rows = []
    for node in range(bases * each):
        rng_base = random.Random(node // each)
        words = [rng_base.getrandbits(64) for _ in range(8)]
        for bit in rng.sample(range(64 * rng.randrange(8), 512), rng.choice((0, 0, 20, 50, 58, 59, 64))):
            words[bit // 64] ^= 1 << bit % 64
        words = [w - (1 << 64) if w >> 63 else w for w in words]
        n, root = rng.choice((80, 90, 100, 100)), rng.choice((node, node // each * each))
        for key in rng.sample(range(keys), rng.randrange(1, keys + 1)):
            rows.append((key, node, root, n, n - rng.choice((0, 0, 0, 5, 30)), *words))
    return rows


def test_walk_finds_all_pairs_below_a_root_within_the_budget(spark):
    rows = leaves_below(random.Random(1))
    leaves = spark.createDataFrame(rows, "key long, node long, root long, n int, top int, " + ", ".join(f"fp{i} long" for i in range(8)))

    def brute(left, ordered):
        out, over = set(), 0
        for x in left:
            for y in rows:
                off = sum(((p ^ q) % (1 << 64)).bit_count() for p, q in zip(x[5:], y[5:], strict=True))
                fits = x[0] == y[0] and x[2] != y[2] and min(x[4], y[4]) * 1.8 >= 0.8 * (x[3] + y[3]) - 1e-9 and (not ordered or (x[3], x[1]) < (y[3], y[1]))
                over += fits and off > nearcopies.BUDGET
                if fits and off <= nearcopies.BUDGET:
                    out.add((x[1], y[1]))
        assert over and out
        return out

    for ordered in (False, True):
        got = [tuple(r) for r in nearcopies.walk(leaves, leaves, ordered).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, ordered)
    few = [r for r in rows if r[1] % 5 == 0]
    assert {tuple(r) for r in nearcopies.walk(leaves.where("node % 5 = 0"), leaves).collect()} == brute(few, False)


def test_every_pair_of_the_stage_is_walked_level_by_level(spark, monkeypatch):
    depths, level = [], nearcopies._level
    monkeypatch.setattr(nearcopies, "_level", lambda leaves, depth, side: depths.append((depth, side)) or level(leaves, depth, side))
    rows = planted()
    kept = {r.doc_id for r in nearcopies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    once = [(d, side) for d in range(nearcopies.WORDS // nearcopies.LEVEL) for side in "ab"]
    assert kept == brute_kept(rows) and len(once) > 4 and depths == once * (nearcopies.ROUNDS + 1)
