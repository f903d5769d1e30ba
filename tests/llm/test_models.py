import random
import zlib

import numpy as np

from barweave.llm import langid, quality
from barweave.llm.common import held_out


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


WORDS = {"en": "the and that with from this have been which would".split(), "de": "der und nicht mit über auch einen schön größer".split(), "es": "que los para una año señor también está".split()}


def corpus(rng, n):
    return [(i, prose(rng, WORDS[lang], rng.randrange(3, 40)), lang) for i, lang in enumerate(rng.choices(list(WORDS), k=n))]


def brute_scores(model_rows, text):
    """Naive Bayes with plain dictionaries over the same buckets."""
    from collections import Counter
    from math import exp, log

    counts, docs = {}, Counter()
    for _, t, lang in model_rows:
        counts.setdefault(lang, Counter()).update(langid.grams([t])[0].tolist())
        docs[lang] += 1
    out = {}
    for lang, c in counts.items():
        total = sum(c.values()) + langid.SMOOTHING * langid.BUCKETS
        out[lang] = log((docs[lang] + 1) / (len(model_rows) + len(docs))) + sum(log((c[b] + langid.SMOOTHING) / total) for b in langid.grams([text])[0].tolist())
    top = max(out.values())
    z = sum(exp(v - top) for v in out.values())
    return {k: exp(v - top) / z for k, v in out.items()}


def test_language_held_out_and_against_plain_naive_bayes(spark):
    rng = random.Random(1)
    rows = corpus(rng, 120)
    docs = spark.createDataFrame([(i, t, lang, i) for i, t, lang in rows], "doc_id long, text string, lang string, score int")
    got = {r.doc_id: r for r in langid.learn_and_identify(docs).collect()}
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    for i, text, lang in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        want = brute_scores(learned, text)
        assert abs(want[got[i].lang_pred] - max(want.values())) < 1e-4
        assert abs(got[i].score - max(want.values())) < 1e-3
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows if got[i].held_out]) > 0.95


def test_language_of_odd_rows(spark):
    rows = [(1, "der und nicht", "de"), (2, "the and that", "en"), (3, None, "en"), (4, "", "en"), (5, " 123 !? ", "en"), (None, "the and", None), (6, "und " * 50000, None), (6, "a\U0010ffffb", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    got = [(r.doc_id, r.lang_pred) for r in langid.identify(docs, model).collect()]
    assert [x for x in got if x[0] in (3, 4, 5)] == [(3, "und"), (4, "und"), (5, "und")]
    assert (6, "de") in got and (None, "en") in got and len(got) == 8
    assert {r.doc_id for r in langid.accepted(docs, model).collect()} <= {1, 2, 6, None}
    nothing = langid.train(docs.limit(0))
    assert {(r.lang_pred, r.score) for r in langid.identify(docs, nothing).collect()} == {("und", 0.0)}
    assert langid.identify(docs.limit(0), model).count() == 0


def test_quality_ranks_and_thresholds(spark):
    rng = random.Random(2)
    rows, marks = [], []
    for i in range(300):
        good = i % 3 != 0
        text = ". ".join(prose(rng, WORDS["en"], 9).capitalize() for _ in range(rng.randrange(2, 9)))
        rows.append((i, text if good else (rng.choice(("buy now!! ", "spam&&& ")) * rng.randrange(5, 60)), "en"))
        if i % 2:
            marks.append((i, int(good), 0))
    marks += [(5, None, 0), (None, 1, 0), (99999, 1, 0), (7, 1, 0)]
    rows += [(1000, None, None), (1001, "", None), (1001, "", None), (1002, "x" * 100000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    out = quality.learn_and_score(docs, labels).collect()
    assert len(out) == len(rows)
    held = [r for r in out if r.held_out and r.doc_id < 300]
    assert np.mean([r.predicted == int(r.doc_id % 3 != 0) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    none = quality.learn_and_score(docs, labels.where("false"))
    assert {round(r.score, 9) for r in none.collect()} == {0.7}
    assert quality.learn_and_score(docs.limit(0), labels).count() == 0


def test_bradley_terry_recovers_order():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 4))
    good = x @ np.array([2.0, -1.0, 0.0, 0.5]) + rng.normal(size=500) * 0.2 > 0.3
    model = quality.fit(x, good)
    assert ((model.score(x) >= quality.CUT) == good).mean() > 0.95
    assert model.weights[0] > 0 > model.weights[1]
    assert model.score(x[:0]).shape == (0,)


def test_held_out_rule(spark):
    ids = spark.createDataFrame([(i,) for i in (0, 1, 17, -5, None)], "doc_id long").select("doc_id", held_out().alias("h")).collect()
    assert [r.h for r in ids] == [r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in ids]
