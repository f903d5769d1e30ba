import random
import re

import pytest

tokenizers = pytest.importorskip("tokenizers")
PLACES = pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_decontaminate import brute as least_edits  # noqa: E402
from tests.llm.test_models import WORDS, brute_scores, prose  # noqa: E402
from tests.llm.test_nearcopies import brute_kept  # noqa: E402
from tests.llm.test_pii_secrets import PII, brute as base_spans  # noqa: E402

ITEM = "the quick brown fox jumps over the lazy dog and runs away from it"


def documents():
    rng = random.Random(8)
    rows = []
    for i in range(60):
        lang = rng.choice(list(WORDS))
        rows.append([i, prose(rng, WORDS[lang], rng.randrange(5, 60)) + f" {rng.randrange(10**6)}", lang])
    rows.append([60, rows[3][1], "en"])
    rows.append([61, rows[4][1].upper(), "en"])
    rows.append([62, "and this " + ITEM + " was here", "en"])
    rows.append([63, "and this " + ITEM.replace("lazy", "lozy").upper() + " was there", "en"])
    rows.append([64, "which would have been from me@example.com and 10.0.0.1 or +1 555 555 5555", "en"])
    rows += [[65, None, "en"], [66, "", "de"], [67, "123 !!", None], [68, "the and that with this " * 3000, "en"]]
    # Alike by 0.8 and more (one of the two goes), and by a little less (both stay): what two bits of a fingerprint cannot tell.
    long = prose(rng, WORDS["en"], 150).split()
    rows += [[70, " ".join(long), "en"]]
    for i, changed in ((71, (10, 50, 90)), (72, (5, 30, 60, 90, 120))):
        other = list(long)
        for at in changed:
            other[at] = f"and{i}{at}"
        rows.append([i, " ".join(other), "en"])
    return [(i, t, lang, "s", len(t or "")) for i, t, lang in rows]


def expected(rows):
    import zlib

    learned = [(i, t or "", lang) for i, t, lang, _, _ in rows if lang and zlib.crc32(str(i).encode()) % 4 != 2]
    docs = {i: t for i, t, *_ in rows if t and any(map(str.isalpha, t)) and max(brute_scores(learned, t).values()) >= 0.5}
    kept = brute_kept(list(docs.items()))
    docs = {i: t for i, t in docs.items() if i in kept}
    docs = {i: t for i, t in docs.items() if len(t) > 20000 or least_edits(" ".join(t.lower().split()), ITEM) > len(ITEM) // 10}
    for i, text in docs.items():
        out, at = "", 0
        for start, _, kind, end in base_spans(PII, text):
            out, at = out + text[at:start] + f"<{kind.upper()}>", end
        docs[i] = out + text[at:]
    slow = tokenizers.Tokenizer.from_file(PLACES.path("word_bpe_49k.json"))
    slow.no_truncation()
    return {i: slow.encode(t, add_special_tokens=False).ids for i, t in docs.items()}


def test_pipeline_against_plain_python(spark, tmp_path):
    rows = documents()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM), (2, "some other passage that is nowhere in it")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: (list(r.ids), r.n_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    want = expected(rows)
    assert got == {i: (ids, len(ids)) for i, ids in want.items()}
    assert not {60, 62, 63, 65, 66, 67, 71} & set(got) and {64, 68, 70, 72} <= set(got)


def test_stages_keep_the_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(documents()[:20], schema)
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString(), name
    assert re.fullmatch(r"[a-z_]+", name)
