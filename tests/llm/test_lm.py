import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barweave.llm import lm, queries

DATA = "/root/testdata/sf0.01"
END = object()


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), END]


def is_held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def brute_base(rows):
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score of every row."""
    seen = Counter(t for i, text in rows if not is_held(i) for t in tokens(text))
    total, distinct = sum(seen.values()), len(seen)
    out = []
    for i, text in rows:
        ts = tokens(text)
        base = sum(math.log10((seen[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in ts)
        out.append((i, is_held(i), len(ts), sum(seen[t] > 0 for t in ts), total, base))
    return out


def close(got, want):
    key = lambda r: (str(r[0]), *map(str, r[1:5]), round(r[5], 6))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9, atol=1e-9)


def made(n, seed=3):
    rng = random.Random(seed)
    words = [f"W{i}" for i in range(60)] + ["café", "x y", "a\x1cb"]
    rows = [(i, " ".join(rng.choice(words[: 10 + i % 54]) for _ in range(rng.randrange(40)))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\x0b\x0c\r\n"), (None, "w1 W2 alone"), (None, "w1 W2 alone"), (3, "again w1"), (3, "again w1"), (n + 3, "long " * 120_000 + "end")]
    return rows + [(20 * n + i, f"only{i} here{i}") for i in range(40)]


@pytest.mark.parametrize("known", [1 << 17, 12, 0])
def test_counts_and_unigram(spark, monkeypatch, known):
    monkeypatch.setattr(lm, "KNOWN", known)  # words whose counts are sent; the others are joined
    rows = made(80)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as word", "2 as n", "3 as rare", "4 as row_").repartition(3)
    got = lm.learn_and_score(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
    close([tuple(r)[:6] for r in got], brute_base(rows))
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_empty_and_all_held_out(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm.learn_and_score(empty).collect() == []
    held = [(i, "a b") for i in range(200) if is_held(i)]
    got = lm.learn_and_score(spark.createDataFrame(held, "doc_id long, text string")).collect()
    close([tuple(r)[:6] for r in got], brute_base(held))


def learned(spark, n=300):
    rng = random.Random(7)
    # Words of one text come from one of two vocabularies: the words before tell which.
    rows = [(i, " ".join(rng.choice("abcdefgh" if i % 2 else "stuvwxyz") for _ in range(60))) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = lm.written(lm.counts(docs), "counts")
    return docs, found, lm.train(docs, found), rows


def test_probabilities_sum_up_to_one_and_scores_are_theirs(spark):
    docs, found, model, rows = learned(spark)
    p = {k: v.astype(float) for k, v in model.params.items()}

    def plain(last, before):
        s = (p["r"][last] @ p["c1"] + p["r"][before] @ p["c2"]) @ p["q"].T + p["b"]
        e = np.exp(s - s.max())
        return e / e.sum()

    every = np.arange(lm.TARGETS)
    for last, before in ((0, 1), (lm.START, lm.START), (5, lm.START), (lm.WORDS + 3, 2)):
        got = np.exp(model.log_probability(np.full(lm.TARGETS, last), np.full(lm.TARGETS, before), every))
        assert abs(got.sum() - 1) < 1e-5 and np.allclose(got, plain(last, before), atol=1e-6)
    # Within a class: its words and one that was not seen.
    seen = Counter(t for _, text in rows for t in lm.words(text))
    own = set(model.joined.split(b"\n")[: lm.WORDS])
    for k in range(lm.CLASSES):
        inside = [n for w, n in seen.items() if w not in own and lm.class_of(w) == k]
        assert abs(sum((n + 0.1) / model.class_size[k] for n in inside) + 0.1 / model.class_size[k] - 1) < 1e-12

    def brute(text):
        last = before = lm.START
        total = 0.0
        for w in lm.words(text):
            t = model.places[w] if w in own else lm.WORDS + lm.class_of(w)
            total += math.log10(plain(last, before)[t])
            if w not in own:
                total += math.log10((seen[w] + 0.1) / model.class_size[lm.class_of(w)])
            last, before = t, last
        return total

    some = [(1, rows[0][1]), (2, rows[1][1]), (3, None), (4, "A zz B unseen unseen"), (5, "q")]
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(some, "doc_id long, text string"), model, found).collect()}
    for i, text in some:
        assert abs(got[i] - brute(text or "")) < 1e-4


def test_the_words_before_help(spark):
    docs, found, model, _ = learned(spark)
    sums = lm.score(docs, model, found).agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert sums.s - sums.b > 0.15 * sums.n  # a bit a token would be 0.30


def test_a_step_follows_the_gradient(spark):
    rng = np.random.default_rng(1)
    share = np.full(lm.TARGETS, 1 / lm.TARGETS)
    params = {"r": rng.normal(size=(lm.TARGETS + 1, lm.SIZE)) * 0.3, "q": rng.normal(size=(lm.TARGETS, lm.SIZE)) * 0.3, "b": rng.normal(size=lm.TARGETS), "c1": np.eye(lm.SIZE), "c2": np.eye(lm.SIZE) / 2}
    last, before, target = np.array([1, 2, 1]), np.array([lm.START, 1, 5]), np.array([2, 1, 7])
    noise = np.minimum(np.searchsorted(np.cumsum(share), np.random.default_rng((4, 2)).random(lm.NOISE)), lm.TARGETS - 1)

    def loss(p):
        guess = p["r"][last] @ p["c1"] + p["r"][before] @ p["c2"]
        real = (guess * p["q"][target]).sum(axis=1) + p["b"][target] - np.log(lm.NOISE * share[target])
        fake = guess @ p["q"][noise].T + p["b"][noise] - np.log(lm.NOISE * share[noise])
        return np.log1p(np.exp(-real)).sum() + np.log1p(np.exp(fake)).sum()

    steps = lm.Steps(params, {k: np.zeros_like(v) for k, v in params.items()}, share, (4, 2))
    with np.errstate(invalid="ignore", divide="ignore"):
        steps.step(last, before, target)
    for name, at in (("r", (1, 3)), ("r", (lm.START, 0)), ("q", (2, 4)), ("q", (int(noise[0]), 1)), ("b", (7,)), ("c1", (0, 2)), ("c2", (3, 3))):
        up, down = ({k: v.copy() for k, v in params.items()} for _ in range(2))
        up[name][at] += 1e-5
        down[name][at] -= 1e-5
        slope = (loss(up) - loss(down)) / 2e-5
        assert abs(math.sqrt(steps.g[name][at]) - abs(slope)) < 1e-4 * max(1, abs(slope))
        assert (steps.p[name][at] - params[name][at]) * slope < 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_held_out_texts_of_the_query(spark):
    got = queries.QUERIES["op13_lm"](spark, DATA).collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    close([tuple(r)[:6] for r in got], brute_base(rows))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)
    assert sum(r.score > r.base_score for r in held) > 0.95 * len(held)
