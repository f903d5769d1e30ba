"""What the learned contexts of personal data find, on 12,000 texts with planted values that no fixed pattern accepts."""

import random

import pytest

from barweave.llm import pii
from tests.llm.test_pii_secrets import luhn

PLACES = {
    "card": ["my card number is {}", "please charge the card {} for it", "paid by credit card no {}", "{} is my new card"],
    "phone": ["call me on {}", "our phone: {}", "you can reach us at tel {}", "{} is her mobile number"],
    "ip": ["the server at {} is down", "ping host {} again", "their ip address was {}", "traffic from ip {} again"],
    "email": ["write to {} about it", "my mail is {}", "contact {} for help", "send it to address {} today"],
}
DECOYS = ["order number {16}", "tracking code {15} was sent", "isbn {13} is a book", "invoice no {8}", "chapter {7} of the log", "build 10.2.333.{3} is out", "team {w}@{w} won", "the ratio {3}.{3}.{3}.{3}x holds", "lot {14} of many", "part {10} is out of stock"]
WORDS = [a + b for a in "ba de fi go lu mi na po ru sa te vo".split() for b in "ln rk st m n sh t".split()]


def digits(rng, n):
    return str(rng.randrange(1, 10)) + "".join(str(rng.randrange(10)) for _ in range(n - 1))


def seed(rng, kind):
    """A value that the fixed pattern of its kind accepts."""
    if kind == "card":
        n = digits(rng, 15)
        return next(n + str(d) for d in range(10) if luhn(n + str(d)))
    if kind == "phone":
        return f"+{rng.randrange(1, 90)} {digits(rng, 3)} {digits(rng, 3)} {digits(rng, 4)}"
    if kind == "ip":
        return ".".join(str(rng.randrange(1, 255)) for _ in range(4))
    return f"{rng.choice(WORDS)}{rng.randrange(10**6)}@{rng.choice(WORDS)}.example.org"


def unseen(rng, kind):
    """One that it does not."""
    if kind == "card":
        n = digits(rng, 15)
        return next(n + str(d) for d in rng.sample(range(10), 10) if not luhn(n + str(d)))
    if kind == "phone":
        return rng.choice(["({}) {}-{}", "{} {} {}", "{}-{}-{}"]).format(digits(rng, 3), digits(rng, 3), digits(rng, 4))
    if kind == "ip":
        return f"{rng.randrange(1, 255)}.{rng.randrange(256, 999)}.{rng.randrange(255)}.{rng.randrange(255)}"
    return f"{rng.choice(WORDS)}{rng.randrange(10**6)}@localhost"


def planted(n=12_000):
    """Texts, and the spans of what no fixed pattern accepts."""
    rng = random.Random(11)
    texts, want = [], []
    for i in range(n):
        before, after = (" ".join(rng.choices(WORDS, k=rng.randrange(4, 16))) for _ in range(2))
        kind, draw = rng.choice(pii.KINDS), rng.random()
        value = seed(rng, kind) if draw < 0.35 else unseen(rng, kind) if draw < 0.5 else None
        if value:
            place = rng.choice(PLACES[kind])
            start = len(before) + 1 + place.index("{}")
            texts.append(f"{before} {place.format(value)} {after}")
            if draw >= 0.35:
                want.append((i, kind, start, start + len(value)))
        else:
            text = rng.choice(DECOYS)
            for size in (16, 15, 14, 13, 10, 8, 7, 3):
                while f"{{{size}}}" in text:
                    text = text.replace(f"{{{size}}}", digits(rng, size), 1)
            texts.append(f"{before} {text.replace('{w}', rng.choice(WORDS))} {after}")
    return texts, want


def test_precision_and_recall_of_what_is_discovered(spark):
    texts, want = planted()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    base, found = set(), set()
    for r in pii.find(docs).select("doc_id", "base", "spans").collect():
        base |= {(r.doc_id, s.kind, s.start, s.end) for s in r.base}
        found |= {(r.doc_id, s.kind, s.start, s.end) for s in r.spans}
    assert base <= found
    new = found - base
    right = new & set(want)
    print(f"planted {len(want)}, discovered {len(new)}, of them right {len(right)}")
    assert len(right) / len(new) >= 0.98 and len(right) / len(want) >= 0.95


def test_nothing_is_learned_where_contexts_say_nothing(spark):
    rng = random.Random(5)
    texts = []
    for i in range(3000):
        kind = rng.choice(pii.KINDS)
        value = seed(rng, kind) if rng.random() < 0.3 else unseen(rng, "card")
        texts.append(f"{' '.join(rng.choices(WORDS, k=9))} {value} {' '.join(rng.choices(WORDS, k=9))}")
    rows = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(r.base == r.spans for r in rows)


@pytest.mark.parametrize("n", [0, 40, 5000])
def test_spans_clear_of_others_against_all_pairs(spark, n):
    from pyspark.sql import functions as F

    from barweave.llm.spans import clear_of

    rng = random.Random(n)
    make = lambda k: sorted((a, a + rng.randrange(1, 30)) for a in rng.sample(range(60 * max(1, n)), k))
    spans, others = make(min(n, 300)), make(n)
    kind = "array<struct<start:int,end:int>>"
    got = spark.createDataFrame([(spans, others)], f"a {kind}, b {kind}").select(clear_of(F.col("a"), F.col("b")).alias("x"), clear_of(F.col("a"), F.col("b"), same=True).alias("y")).first()
    assert [tuple(s) for s in got.x] == [s for s in spans if not any(s[0] < o[1] and o[0] < s[1] for o in others)]
    assert [tuple(s) for s in got.y] == [s for s in spans if s not in set(others)]


def test_masking_long_texts_with_many_spans(spark):
    parts, want = [], []
    for i in range(1500):
        gap = "x😀ü" * ((i * 7919) % 40) + ("y" * 9000 if i % 500 == 7 else "")
        parts.append(f"{gap} a{i}@b.co 10.0.0.{i % 200} ")
        want.append(f"{gap} <EMAIL> <IP> ")
    docs = spark.createDataFrame([(1, "".join(parts))], "doc_id long, text string")
    assert pii.redact(docs).first().text == "".join(want)


def test_a_column_named_like_ours(spark):
    docs = spark.createDataFrame([(1, "a@b.co", "keep", 7, "z")], "doc_id long, text string, text_key string, d int, spans string")
    row = pii.redact(docs).first()
    assert tuple(row) == (1, "<EMAIL>", "keep", 7, "z")
