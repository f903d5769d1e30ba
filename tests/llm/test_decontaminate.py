import random

import numpy as np

from barweave.llm import decontaminate as d


def brute(text, item):
    """Least edits between ``item`` and any piece of ``text``, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def plain(text):
    return "".join(map(chr, d.plain(text).tolist()))


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        i = rng.randrange(len(out))
        rng.choice((lambda: out.insert(i, rng.choice("abc ")), lambda: out.pop(i), lambda: out.__setitem__(i, rng.choice("abcé"))))()
    return "".join(out)


def test_against_plain_alignment():
    rng = random.Random(3)
    words = [w * k for w in ("th", "er", "in", "on", "tion", "ble") for k in (1, 2)]

    def prose(n):
        return " ".join(rng.choice(words) + rng.choice(words) for _ in range(n))

    items = [prose(rng.randrange(3, 40)) for _ in range(25)] + ["", "short", "the the the the the the the the"]
    texts = ["", "x", prose(2000), "the " * 4000]
    for item in items[:25]:
        m = len(item)
        for n in (0, m // 20, m // 10, m // 10 + 1, m // 6):
            texts.append(prose(rng.randrange(30)) + "  \n" + edited(rng, item, n).upper() + "\t" + prose(rng.randrange(30)))
    texts += [items[0], items[1] + " " + items[1], items[2][:-3]]
    index = d.Index(items, d.Q, d.RATE)
    got = {(r.row, r.item): r for r in d.matches(texts, index).itertuples()}
    for i, text in enumerate(texts):
        if len(text) > 3000:
            continue
        for k, item in enumerate(items):
            edits = d.budget(len(plain(item)))
            want = brute(plain(text), plain(item)) if edits >= 0 else 99
            assert ((i, k) in got) == (want <= edits), (i, k, want, edits)
            if want <= edits:
                r = got[i, k]
                assert r.edits == want
                assert brute(plain(text[r.start : r.end]), plain(item)) == want
    assert (3, 27) in got and got[3, 27].edits == 0


def test_long_hot_text_and_cut_pairs(monkeypatch):
    monkeypatch.setattr(d, "PAIRS", 500)
    item = "the quick brown fox jumps over the lazy dog and runs away"
    index = d.Index([item, item + " again and again"], d.Q, d.RATE)
    found = d.matches(["over the lazy dog " * 300 + item + " over the lazy dog" * 300], index)
    assert found["item"].tolist() == [0] and found["edits"].tolist() == [0]
    assert found["start"].tolist() == [18 * 300]


def test_separator_inside_a_text():
    item = "the quick brown fox jumps over the lazy dog"
    found = d.matches(["a\U0010ffffb", "x " + item + "\U0010ffff"], d.Index([item], d.Q, d.RATE))
    assert found["row"].tolist() == [1] and found["start"].tolist() == [2]


def test_on_spark(spark):
    item = "The quick brown fox jumps over the lazy dog."
    docs = spark.createDataFrame([(1, "a " + item, 9), (1, "a " + item, 9), (2, None, 1), (3, "", 1), (None, item.upper() + " b", 4), (4, "clean words only", 2)], "doc_id long, text string, item int")
    bench = spark.createDataFrame([(7, item, 1), (8, item, 2), (9, None, 3), (None, item, 4), (10, "nothing of the kind is anywhere here", 5)], "item_id long, text string, doc_id int")
    got = sorted(tuple(r) for r in d.contamination(docs, bench, block_chars=50).fillna(-1, ["doc_id"]).collect())
    places = [(1, 2), (1, 2), (-1, 0)]
    assert got == sorted((i, k, 0, s, s + len(item)) for i, s in places for k in (7, 8))
    assert sorted(r.doc_id for r in d.clean(docs, bench).collect()) == [2, 3, 4]
    assert d.clean(docs, bench).columns == docs.columns
    assert d.contamination(docs, bench.limit(0)).count() == 0
    assert d.contamination(docs.limit(0), bench).count() == 0
    assert d.clean(docs, bench.limit(0)).count() == 6


def test_align_within_its_band():
    a, b = np.array([5, 1, 2, 3, 4, 9], np.int64), np.array([1, 2, 4], np.int64)
    assert d.align(a, b, 0, 3, 3)[0] == 1 and d.align(a, b, 0, 3, 0)[0] > 0
