from barweave.llm import pii
from tests.llm.test_pii_secrets import frame

CARDS = ["4111111111111111", "5500005555555559", "340000000000009", "6011000990139424", "30569309025904", "3530111333300000"]
PHONES = [f"+1 555 010 {n}" for n in range(1000, 1006)]
IPS = [f"10.0.{n}.7" for n in range(6)]
EMAILS = [f"name{n}@mail.example.org" for n in range(6)]


UNSEEN = [
    ("card", "my card number", CARDS, ["4111111111111112", "4111 1111 1111 1113", "4111-1111-1111-1114"]),
    ("phone", "please call me", PHONES, ["5550102000", "(017) 555-7713", "018 555 7713"]),
    ("ip", "the host at", IPS, ["10.0.300.7"]),
    ("email", "do write to", EMAILS, ["name@localhost"]),
]
AFTER = [".", " today", ", or not", ")."]


def test_unseen_values_before_a_stop_and_with_blanks(spark):
    texts = [f"and {words} {s} again" for _, words, seeds, _ in UNSEEN for s in seeds * 6]
    start = len(texts)
    want = []
    for kind, words, _, values in UNSEEN:
        for value in values:
            for after in AFTER:
                at = len(f"and {words} ")
                texts.append(f"and {words} {value}{after}")
                want.append(f"{kind}:{at}:{at + len(value)}")
    rows = {r.doc_id: r.spans for r in pii.digests(frame(spark, texts)).collect()}
    assert [rows[start + i] for i in range(len(want))] == want


def test_a_value_counts_by_its_digits(spark):
    texts = [f"and my card number {c} again" for c in CARDS] + ["and my card number 4111 1111 1111 1112.", "it is 4111-1111-1111-1112, or 4111111111111112."]
    rows = {r.doc_id: r.spans for r in pii.digests(frame(spark, texts)).collect()}
    assert rows[7] == "card:6:25,card:30:46"
