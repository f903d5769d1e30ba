"""Quality of a text: a Bradley-Terry model of preferences, cut at a quantile of the scores.

A preference pair is a document marked good and one marked bad. The score of a document is linear in its
features, and the chance that it is preferred is the logistic function of the difference of two scores;
the weights minimise the logistic loss on feature differences. The scores of the labelled documents then
give the threshold: the quantile that separates their labels best. Published scores are moved so that
this threshold is at 0.7.

Features of every document are computed in Spark from its whole text. The fit itself takes a bounded
number of labelled rows (``MAX_LABELLED``, chosen by a hash of the id over the whole table).
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codepoints import codes, tables
from .common import held_out, per_text

#: Labelled rows and preference pairs that a fit takes at most; strength of the ridge; place of the threshold.
MAX_LABELLED, PAIRS, RIDGE, CUT = 20_000, 60_000, 1e-3, 0.7
SCRIPT_BUCKETS = 12


def features(text: str) -> np.ndarray:
    """Length, repetition, spelling and mark features; the empty text has zeros (and a 1 in the first place)."""
    raw = codes(text)
    words = text.split()
    n, m = len(raw), len(words)
    if not m:
        return np.concatenate([[1.0], np.zeros(N_FEATURES - 1)])
    low, space, letter = tables()
    small = np.minimum(raw, 0xFFFF)
    is_space, is_letter = space[small], letter[small]
    digit = (small >= 48) & (small <= 57)
    upper = is_letter & (low[small] != small)
    mark = ~(is_space | is_letter | digit)
    plain = mark & np.isin(small, (33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63))
    counts = Counter(words)
    top = [c / m for _, c in counts.most_common(3)] + [0.0] * 3
    lengths = np.fromiter(map(len, words), np.int64, m)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False)) / m
    pairs = Counter(zip(words, words[1:], strict=False))
    lines = [x for x in text.split("\n") if x.strip()]
    sentences = max(1, text.count(". ") + text.count(".\n") + text.count("! ") + text.count("? "))
    after_word = sum(not w[-1].isalnum() for w in words) / m
    marked = [w[-1] for w in words if not w[-1].isalnum()]
    caps = sum(w.isupper() and len(w) > 1 for w in words) / m
    run = np.diff(np.flatnonzero(np.concatenate([[True], raw[1:] != raw[:-1], [True]])))
    shares = np.bincount((np.minimum(raw, 0x2FF) >> 6).astype(np.int64), minlength=SCRIPT_BUCKETS)[:SCRIPT_BUCKETS] / n
    return np.array(
        [
            0.0, np.log1p(n), np.log1p(m), np.log1p(m) ** 2, lengths.mean(), lengths.std(), np.log(lengths.max()), (lengths > 15).mean(), (lengths == 1).mean(),
            is_letter.mean(), digit.mean(), np.sqrt(digit.mean()), upper.mean(), np.sqrt(upper.mean()), caps, plain.mean(), (mark & ~plain).mean(), np.sqrt((mark & ~plain).mean()),
            after_word, len(set(marked)) / 10, is_space.mean(),
            len(counts) / m, len(counts) / np.sqrt(m), *top[:3], same, np.sqrt(same), len(pairs) / m, (pairs.most_common(1)[0][1] if pairs else 1) / m,
            1 - len(set(lines)) / len(lines), np.log1p(len(lines)), np.log(n / len(lines)), np.log(m / sentences), (run > 2).mean(), np.log(run.max()),
            text.count("http") / m, text.count("!") / m, text.count("?") / m, float(text[-1:] in ".!?"), text.count("...") / m, *shares,
        ]
    )


N_FEATURES = 41 + SCRIPT_BUCKETS


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        raw = np.clip((rows - self.mean) / self.scale, -8, 8) @ self.weights
        return 1 / (1 + np.exp(-np.clip(raw - self.threshold + np.log(CUT / (1 - CUT)), -30, 30)))


def fit(rows: np.ndarray, good: np.ndarray, pairs: int = PAIRS, seed: int = 1) -> Model:
    """A model of feature rows and their labels; with labels of one kind only, every score is the threshold's."""
    mean, scale = rows.mean(axis=0), rows.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    x = np.clip((rows - mean) / scale, -8, 8)
    better, worse = np.flatnonzero(good), np.flatnonzero(~good)
    weights = np.zeros(x.shape[1])
    if not len(better) or not len(worse):
        return Model(mean, scale, weights, 0.0)
    rng = np.random.default_rng(seed)
    n = max(pairs, len(better), len(worse))
    # Every labelled row is in some pair: both sides are dealt out in turn, in random order.
    deal = lambda side: np.concatenate([rng.permutation(side) for _ in range(-(-n // len(side)))])[:n]
    d = x[deal(better)] - x[deal(worse)]
    for _ in range(40):
        p = 1 / (1 + np.exp(np.clip(d @ weights, -30, 30)))
        gradient = d.T @ p / n - RIDGE * weights
        curve = (d * (p * (1 - p))[:, None]).T @ d / n + RIDGE * np.eye(len(weights))
        step = np.linalg.solve(curve, gradient)
        weights = weights + step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    raw = x @ weights
    cuts = np.quantile(raw, np.linspace(0.005, 0.995, 199))
    right = [((raw >= t) == good).mean() for t in cuts]
    best = np.flatnonzero(np.array(right) >= max(right) - 1e-12)
    return Model(mean, scale, weights, float(cuts[best[len(best) // 2]]))


def rated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, features`` for every row."""

    def make(texts):
        import pyarrow as pa

        return [pa.array([features(t) for t in texts], pa.list_(pa.float64()))]

    return per_text(docs, make, "features array<double>", id_col, text_col)


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Model:
    """A model of the documents that ``labels`` (``doc_id``, ``quality`` 0 or 1) marks, ``most`` of them by a hash of the id.

    Labels that are null or without a document count for nothing; an id with both labels counts as both,
    and so does one with several texts, but no more than ``most`` rows are gathered.
    """
    chosen = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", (F.col("quality") == 1).alias("good")).distinct()
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "good").limit(most)
    got = rated(docs.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")).join(F.broadcast(chosen), "doc_id")
    got = got.orderBy(F.xxhash64("doc_id", "features", "good")).limit(most).select("features", "good").toArrow()  # `most` rows of fixed size
    if not got.num_rows:
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.0)
    rows = np.array(got.column("features").combine_chunks().values).reshape(-1, N_FEATURES)
    good = np.array(got.column("good").to_pylist(), bool)
    order = np.lexsort([*rows.T, good])
    return fit(rows[order], good[order])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` for every row: 0 to 1, and 1 where the score reaches the threshold.

    Null and empty texts are scored like any others, by their (zero) features; very long texts are read whole; other
    columns are not looked at. Repeated rows get the same
    score each; an empty table gives an empty result; a model without both labels scores 0.7 throughout.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make(texts):
        import pyarrow as pa

        rows = np.array([features(t) for t in texts]).reshape(-1, N_FEATURES)
        return [pa.array(sent.value.score(rows), pa.float64())]

    return per_text(docs, make, "score double", id_col, text_col).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def learn_and_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted``: learned from labelled rows that are not held out, for all rows."""
    model = train(docs, labels.where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
