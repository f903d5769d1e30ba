import hashlib
import random

import pytest

from barweave.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
PLACES = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def both():
    path = PLACES.path("word_bpe_49k.json")
    slow = tokenizers.Tokenizer.from_file(path)
    slow.no_truncation()
    slow.no_padding()
    return bpe.WordBpe(path), slow


def same(both, text):
    fast, slow = both
    want = slow.encode(text, add_special_tokens=False)
    assert fast.encode(text) == want.ids, text
    assert fast.encode_parts(text)[2] == slow.decode(want.ids, skip_special_tokens=False), text


def test_every_token_and_pairs_of_tokens(both):
    fast, _ = both
    names = [t.replace("</w>", "") for t in fast.names.values()]
    rng = random.Random(1)
    for _ in range(60):
        same(both, " ".join(rng.choice(names) + rng.choice(names) for _ in range(200)))
    for start in range(0, len(names), 5000):
        same(both, " ".join(names[start : start + 5000]))


def test_random_letters_and_marks(both):
    rng = random.Random(2)
    for alphabet in ("aeinrst", "abcdefghijklmnopqrstuvwxyz", "ab", "0123456789 a.", "'stremvld ", "éèüßñ Σς İı ﬁ Å é 漢字 🙂​\x1f\x85 \x00\t\n"):
        for _ in range(300):
            same(both, "".join(rng.choices(alphabet, k=rng.randrange(60))))


@pytest.mark.parametrize("text", ["", " ", "\n\n", "It's we're I'LL 'd", "<|endoftext|>", "a<|startoftext|><|endoftext|> b", "<|endoftext", "x" * 5000, "ΑΣ ΑΣΑ", "ﬁ ẞ İ", "!!!??? ...", "a b　c", "١٢٣ ½ Ⅷ"])
def test_edges(both, text):
    same(both, text)


def test_on_spark(spark, both):
    _, slow = both
    texts = ["The cat's hat.", "", None, "The cat's hat.", "z" * 3000 + " <|endoftext|>"]
    rows = [(i if i != 3 else 0, t, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = bpe.encode(docs).collect()
    assert len(got) == 5
    digests = {(r.doc_id, r.ids_sha256): r for r in bpe.encode_digests(docs).collect()}
    for r in got:
        ids = hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
        assert digests[r.doc_id, ids].n_tokens == r.n_tokens == len(r.ids)
        assert digests[r.doc_id, ids].decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
        assert r.decoded == slow.decode(r.ids, skip_special_tokens=False)
    assert bpe.encode(docs.limit(0)).count() == 0


def test_pairs_are_remembered_longer_than_words(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 40)
    fast, tested = bpe.WordBpe(PLACES.path("word_bpe_49k.json")), []
    compatible = fast._compatible
    monkeypatch.setattr(fast, "_compatible", lambda a, b: tested.append((a, b)) or compatible(a, b))
    rng = random.Random(4)
    text = " ".join("".join(rng.choices("aeinrstlou", k=12)) for _ in range(400))
    first = fast.encode_parts(text)
    n = len(tested)
    assert n > 400 and fast.encode_parts(text) == first and len(tested) == n


def test_the_pattern_of_narrow_texts_is_the_vocabularys(both):
    fast, _ = both
    rng = random.Random(5)
    letters = [chr(i) for i in range(256)] + list("'''stremvld") * 4
    assert fast._narrow is not fast._words
    for _ in range(3000):
        text = "".join(rng.choices(letters, k=40)).lower()
        assert fast._narrow(text) == fast._words(text), text
