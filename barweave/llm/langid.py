"""Language of a text: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of every labelled text in Spark: each task adds up its own counts by language
and bucket, and those partial counts are summed. The model is a matrix of log-probabilities with a row
for each bucket and a column for each language; its size is fixed by ``BUCKETS`` and bounded by
``MAX_LANGUAGES``, so it is broadcast. Scoring looks up the rows of a batch's n-grams and adds them up by text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codepoints import BREAK, SPACE, batches_of, codes, tables
from .common import _small_batches, drop_written, filtered, held_out, per_text, whole_text, written

ORDERS, BITS, SMOOTHING = (1, 2, 3), 14, 0.5
BUCKETS = 1 << BITS
#: More languages than this would make the model (64 kB for each) too large to broadcast; so many are gathered at a time.
MAX_LANGUAGES, GATHERED = 2048, 64
#: Code points looked at together, for one language.
AT_ONCE = 200_000
UNKNOWN = "und"


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of every n-gram of letters in lower case; runs of anything else are one space."""
    low, _, letter = tables()
    raw = codes(chr(BREAK).join([*texts, ""]))
    basic = raw < (1 << 16)
    small = np.where(basic, raw, 0)
    ends = raw == BREAK
    text = np.where(basic, np.where(letter[small], low[small], SPACE), raw)
    gap = text == SPACE
    keep = np.ones(len(text), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    text, ends = text[keep].astype(np.uint64), ends[keep]
    # A text that holds the separator itself would shift the numbers of those after it.
    if int(ends.sum()) != len(texts):
        return grams([t.replace(chr(BREAK), " ") for t in texts])
    number = np.cumsum(ends) - ends
    buckets, numbers = [], []
    for order in ORDERS:
        n = len(text) - order + 1
        if n <= 0:
            continue
        mixed, broken = np.full(n, order, np.uint64), np.zeros(n, bool)
        for i in range(order):
            mixed = (mixed ^ text[i : i + n]) * np.uint64(0x100000001B3)
            broken |= ends[i : i + n]
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        ok = ~broken if order > 1 else ~broken & (text[:n] != SPACE)
        buckets.append((mixed >> np.uint64(64 - BITS)).astype(np.int64)[ok])
        numbers.append(number[:n][ok])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(numbers)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    prior: np.ndarray
    weights: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        """Posterior of each language for each text."""
        out = np.tile(self.prior, (len(texts), 1))
        for start, stop in batches_of(texts, max(1, AT_ONCE // max(1, len(self.languages)))):
            buckets, number = grams(texts[start:stop])
            for k in range(len(self.languages)):
                out[start:stop, k] += np.bincount(number, self.weights[k][buckets], minlength=stop - start)[: stop - start]
        out -= out.max(axis=1, keepdims=True)
        np.exp(out, out=out)
        return out / out.sum(axis=1, keepdims=True)


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """A model of all rows of ``docs`` with a language; null texts count as empty. No rows: a model of no language.

    More than ``MAX_LANGUAGES`` languages are refused before any count is gathered.
    """
    _small_batches(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), whole_text(text_col).alias("text"))

    def count(batches):
        import pyarrow as pa

        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, stop in batches_of(texts, AT_ONCE):
                buckets, number = grams(texts[start:stop])
                names = sorted(set(langs[start:stop]))
                which = np.array([names.index(x) for x in langs[start:stop]], np.int64)
                flat = np.bincount(which[number] * BUCKETS + buckets, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                for k, name in enumerate(names):
                    # One place more than there are buckets: the number of texts.
                    here = sums.setdefault(name, np.zeros(BUCKETS + 1, np.int64))
                    here[:BUCKETS] += flat[k]
                    here[BUCKETS] += int((which == k).sum())
        for name, here in sums.items():
            at = np.flatnonzero(here)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(here[at])], ["lang", "bucket", "n"])

    counts = rows.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = written(counts, "grams")
    languages = sorted(r.lang for r in counts.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; so many make no model")
    total = np.zeros((len(languages), BUCKETS + 1))
    number = {x: i for i, x in enumerate(languages)}
    for start in range(0, len(languages), GATHERED):
        table = counts.where(F.col("lang").isin(languages[start : start + GATHERED])).toArrow().to_pydict()  # at most GATHERED * (BUCKETS + 1) rows
        np.add.at(total, ([number[x] for x in table["lang"]], table["bucket"]), table["n"])
    drop_written(docs.sparkSession, counts)
    seen = total[:, :BUCKETS] + SMOOTHING
    weights = np.log(seen / seen.sum(axis=1, keepdims=True)).astype(np.float32)
    prior = np.log((total[:, BUCKETS] + 1) / (total[:, BUCKETS] + 1).sum()) if languages else np.zeros(0)
    return Model(languages, prior, weights)


def _best(texts: list[str], model: Model) -> tuple[list[str], list[float]]:
    if not model.languages:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    scores = model.scores(texts)
    best = scores.argmax(axis=1)
    letters = [any(map(str.isalpha, t)) for t in texts]
    names = [model.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), letters, strict=True)]
    return names, [float(s) if ok else 0.0 for s, ok in zip(scores[np.arange(len(best)), best], letters, strict=True)]


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for every row: the likeliest language (ties: the first by name) and its posterior.

    Texts that are null or have no letter, and all texts if the model knows no language, are ``und`` with
    score 0; very long texts are read whole; other columns are not looked at. Repeated rows get the same answer each; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make(texts):
        import pyarrow as pa

        names, scores = _best(texts, sent.value)
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

    return per_text(docs, make, "lang_pred string, score double", id_col, text_col)


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text is in some language of the model with at least this score.

    Null and empty texts and texts without letters go, and so do all if the model knows no language; very long texts are
    read whole. Repeated rows are judged each by itself; other columns stay as they are; an empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep(texts):
        names, scores = _best(texts, sent.value)
        return [n != UNKNOWN and s >= least for n, s in zip(names, scores, strict=True)]

    return filtered(docs, keep)


def learn_and_identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: learned from the rows that are not held out, for all rows."""
    model = train(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
