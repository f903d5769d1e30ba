import hashlib
import json
import random

import pytest

from barweave.llm import minhash, wordpiece
from barweave.llm.bpe import default_path


def shingles(text, k=5):
    words = text.encode().lower().split()
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def test_estimates_are_close_to_the_likeness():
    rng = random.Random(1)
    errors = []
    for n in (8, 40, 300, 3000):
        for _ in range(30):
            words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            other = list(words)
            for i in range(rng.randrange(n)):
                other[rng.randrange(n // 2 + i // 2)] = "x" + str(i)
            a, b = " ".join(words), " ".join(other)
            errors.append(minhash.likeness(minhash.fingerprint(a), minhash.fingerprint(b)) - jaccard(a, b))
    assert abs(sum(errors) / len(errors)) < 0.02
    assert (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.05


def test_equal_empty_and_short_texts():
    f = minhash.fingerprint
    assert f("") == f(" \n\t") == f("")
    assert f("A  b c") == f("a B\nc") and len(f("a")) == minhash.BINS * minhash.BITS // 8
    assert minhash.likeness(f("one two"), f("one three")) < 0.1 and minhash.likeness(f(""), f("one")) < 0.1
    assert minhash.likeness(f("x " * 50000), f("x " * 40000)) == 1.0


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_next_document(spark, parts):
    rng = random.Random(parts)
    texts = [" ".join(f"é{rng.randrange(999)}" for _ in range(rng.randrange(60))) for _ in range(50)] + ["", None]
    ids = rng.sample(range(-100, 10**6), len(texts))
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in zip(ids, texts)], "doc_id long, text string, bucket int, key string")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    got = {r.doc_id: r for r in minhash.compare_with_next(docs).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    order = sorted(zip(ids, texts), reverse=True)
    assert len(got) == len(order)
    for (i, text), (_, following) in zip(order, order[1:] + order[:1]):
        text, following = text or "", following or ""
        k = len(text) // 3
        want = text[: len(text) - k] + following[:k]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert r.fingerprint == minhash.fingerprint(text).hex() and r.edited_fingerprint == minhash.fingerprint(want).hex()
        assert r.near_next == minhash.likeness(minhash.fingerprint(text), minhash.fingerprint(following))


def test_single_repeated_and_missing_ids(spark):
    one = spark.createDataFrame([(5, "abc def")], "doc_id long, text string")
    assert minhash.compare_with_next(one).collect()[0].near_next == 1.0
    same = spark.createDataFrame([(1, "b"), (1, "a"), (None, "n"), (2, "z"), (2, "z")], "doc_id long, text string")
    got = [(r.doc_id, r.n_chars) for r in minhash.compare_with_next(same).collect()]
    assert sorted(got, key=str) == sorted([(2, 1), (2, 1), (1, 1), (1, 1), (None, 1)], key=str)
    assert minhash.compare_with_next(one.limit(0)).count() == 0


def greedy(pieces, word):
    n = at = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        n, at = n + 1, end
    return n


def test_piece_counts_against_greedy_search():
    rng = random.Random(4)
    for _ in range(150):
        pieces = {"".join(rng.choices("abc", k=rng.randrange(1, 6))) for _ in range(rng.randrange(1, 25))}
        counter = wordpiece.PieceCounter(pieces)
        for _ in range(60):
            word = "".join(rng.choices("abc", k=rng.randrange(12)))
            assert counter.count(word) == greedy(pieces, word), (pieces, word)


def test_token_counts_of_texts(spark):
    with open(default_path(), encoding="utf-8") as file:
        vocab = json.load(file)["model"]["vocab"]
    counter = wordpiece.counter(default_path())
    pieces = {t.replace("</w>", wordpiece.END) for t in vocab}
    words = "the cat's interoperability 1234 naïve Größe 漢字!? zzzzzz".split()
    for word in words:
        for part in counter._words(word.lower()):
            mapped = "".join(wordpiece.byte_letters()[b] for b in part.encode()) + wordpiece.END
            assert counter._pieces.count(mapped) == greedy(pieces, mapped)
    rows = [(1, " ".join(words)), (1, " ".join(words)), (2, None), (None, ""), (3, "z" * 100000)]
    got = wordpiece.count_tokens(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 5 and all(r.n_tokens == counter.count(dict(rows[:3] + rows[4:]).get(r.doc_id) or "")[1] for r in got)
