"""A log-bilinear neural language model, learned by noise-contrastive estimation, beside a smoothed unigram.

Tokens are words (lower-cased A-Z) and one end for each text. All words of the training texts are counted in Spark. The
most frequent ``WORDS`` are targets of the model by themselves, all others by one of ``CLASSES`` classes of word endings, within which a
word has its smoothed share of the class's count; so every word, seen or not, has a probability, and they sum up to one.

The model (Mnih and Hinton) predicts a vector from those of the ``2`` words before and compares it with the targets' vectors. It is learned
from all training texts: every task runs stochastic gradient steps over its rows, in numpy, against noise words drawn from the unigram,
and the tasks' parameters are averaged in Spark. There are ``ROUNDS`` such rounds, each over another share of the texts.

As the two words' contributions are added before the exponential, the normalisers of *all* contexts are one matrix product
of exponentials, computed once in each worker; a token's log-probability is then a product of short vectors less an entry of that table.

Counts of the most frequent ``KNOWN`` words are sent to the tasks; other words of a text meet their counts in a join, so
that counts are exact for every word, however many there are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from zlib import crc32

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _small_batches, kind_of, whole_text, written

#: Targets by word, classes of other words (and the bytes of an ending), size of a vector.
WORDS, CLASSES, ENDING, SIZE = 2048, 64, 3, 16
#: Words whose counts are sent to tasks at most; words that a task counts before it puts them out; smoothing of counts.
KNOWN, COUNTED, SMOOTHING = 1 << 17, 1 << 18, 0.1
#: Rounds of averaging, noise words of a batch, tokens in a batch, and the rate of steps.
ROUNDS, NOISE, BATCH, RATE = 4, 64, 768, 0.1
END = b""
START = WORDS + CLASSES
TARGETS = WORDS + CLASSES


def words(text: str) -> list[bytes]:
    """The tokens of a text: its words and the end."""
    out = text.encode("utf-8", "surrogatepass").lower().split()
    out.append(END)
    return out


def class_of(word: bytes) -> int:
    return crc32(word[-ENDING:]) % CLASSES


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are not learned from: crc32 of the id as text is divisible by 10. Null ids are learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``word, class, n`` over all texts (null: only an end)."""
    _small_batches(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out() -> pa.RecordBatch:
            keys = list(seen)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([class_of(w) for w in keys], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["word", "class", "n"])

        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(words(text))
                if len(seen) > COUNTED:
                    yield out()
                    seen.clear()
        yield out()

    return docs.select(whole_text(text_col).alias("text")).mapInArrow(run, "word binary, class int, n bigint").groupBy("word", "class").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Known words, most frequent first, and their counts; totals of all tokens and of each class; the parameters."""

    joined: bytes
    known: np.ndarray
    total: int
    distinct: int
    class_total: np.ndarray
    class_distinct: np.ndarray
    params: dict[str, np.ndarray] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in self.__dataclass_fields__}

    @cached_property
    def places(self) -> dict[bytes, int]:
        """Place of each known word."""
        found = self.joined.split(b"\n") if len(self.known) else []
        return {w: i for i, w in enumerate(found)}

    @cached_property
    def targets(self) -> np.ndarray:
        """Target of each known word."""
        out = np.arange(len(self.known), dtype=np.int32)
        for w, i in self.places.items():
            if i >= WORDS:
                out[i] = WORDS + class_of(w)
        return out

    @cached_property
    def share(self) -> np.ndarray:
        """The unigram probability of each target: the noise."""
        n = np.zeros(TARGETS)
        top = self.known[:WORDS]
        n[: len(top)] = top
        n[WORDS:] = self.class_total
        n += SMOOTHING
        return n / n.sum()

    @cached_property
    def of_known(self) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the smoothed count of each known word, and of the part of it that the classes leave to the word (0 for targets)."""
        base = np.log10(self.known + SMOOTHING)
        inner = base - np.log10(self.class_size)[np.maximum(self.targets - WORDS, 0)]
        return base, np.where(self.targets < WORDS, 0.0, inner)

    @property
    def class_size(self) -> np.ndarray:
        return self.class_total + SMOOTHING * (self.class_distinct + 1)

    @property
    def size(self) -> float:
        return self.total + SMOOTHING * (self.distinct + 1)

    @cached_property
    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        """What the last word, and the one before it, add to the predicted vector."""
        p = self.params
        return p["r"] @ p["c1"], p["r"] @ p["c2"]

    @cached_property
    def normaliser(self) -> np.ndarray:
        """log of the sum of exponentials for each pair of (last word, word before)."""
        last, before = (x.astype(np.float64) for x in self.parts)
        q, b = self.params["q"].astype(np.float64), self.params["b"].astype(np.float64)
        right = before @ q.T
        right_most = right.max(axis=1)
        np.exp(right - right_most[:, None], out=right)
        out = np.empty((len(last), len(before)), np.float32)
        for at in range(0, len(last), 128):
            left = last[at : at + 128] @ q.T + b
            most = left.max(axis=1)
            np.exp(left - most[:, None], out=left)
            out[at : at + 128] = np.log(left @ right.T) + most[:, None] + right_most
        return out

    def log_probability(self, last: np.ndarray, before: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each target after its two words."""
        p, (one, two) = self.params, self.parts
        out = np.empty(len(target))
        for at in range(0, len(target), 1 << 15):
            some = slice(at, at + (1 << 15))
            a, b, t = last[some], before[some], target[some]
            out[some] = np.einsum("ij,ij->i", one[a] + two[b], p["q"][t]) + p["b"][t] - self.normaliser[a, b]
        return out

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Places (-1: not known) and targets of all tokens of all texts, the tokens of each text; of each unknown one its text and itself."""
        tokens = [words(t) for t in texts]
        get = self.places.get
        place = np.array([get(w, -1) for t in tokens for w in t], np.int32)
        n = np.array([len(t) for t in tokens], np.int64)
        target = self.targets[place] if len(self.known) else np.zeros(len(place), np.int32)
        rare = np.flatnonzero(place < 0)
        first = np.concatenate([[0], np.cumsum(n)])
        text = np.searchsorted(first, rare, "right") - 1
        unknown = [tokens[t][i] for t, i in zip(text.tolist(), (rare - first[text]).tolist(), strict=True)]
        target[rare] = [WORDS + class_of(w) for w in unknown]
        return place, target, n, text, unknown


def contexts(target: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The targets one and two before each token, within its text."""
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    last = np.concatenate([[START], target[:-1]]).astype(np.int32)
    before = np.concatenate([[START, START], target[:-2]]).astype(np.int32)[: len(target)]
    last[first] = START
    before[first] = START
    second = first[n > 1] + 1
    before[second] = START
    return last, before


def _pieces(texts: list[str], most: int = 1 << 21) -> Iterator[list[str]]:
    """Texts in order, so many at once that they have no more characters than ``most`` (or are one)."""
    out, size = [], 0
    for t in texts:
        if out and size + len(t) > most:
            yield out
            out, size = [], 0
        out.append(t)
        size += len(t)
    if out:
        yield out


def beginning(model: Model) -> dict[str, np.ndarray]:
    """Parameters before any step: small random vectors of words, none of targets, so that the model is the unigram."""
    rng = np.random.default_rng(13)
    eye = np.eye(SIZE, dtype=np.float32)
    r = rng.normal(0, 0.5, (TARGETS + 1, SIZE)).astype(np.float32)
    return {"r": r, "q": np.zeros((TARGETS, SIZE), np.float32), "b": np.log(model.share).astype(np.float32), "c1": eye.copy(), "c2": eye.copy() * 0.5}


class Steps:
    """Gradient steps of noise-contrastive estimation on copies of the parameters and of Adagrad's sums of squares."""

    def __init__(self, params: dict[str, np.ndarray], squares: dict[str, np.ndarray], share: np.ndarray, seed: tuple[int, int]):
        self.p = {k: v.copy() for k, v in params.items()}
        self.g = {k: v.copy() for k, v in squares.items()}
        self.log_noise = np.log(NOISE * share).astype(np.float32)
        self.below = np.cumsum(share)
        self.rng = np.random.default_rng(seed)
        self.tokens = 0

    def _move(self, name: str, grad: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        self.g[name][rows] += grad * grad
        self.p[name][rows] -= RATE * grad / np.sqrt(self.g[name][rows])

    def _sums(self, rows: np.ndarray, grads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(rows, kind="stable")
        ordered = rows[order]
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        return ordered[starts], np.add.reduceat(grads[order], starts, axis=0)

    def step(self, last: np.ndarray, before: np.ndarray, target: np.ndarray) -> None:
        p = self.p
        noise = np.minimum(np.searchsorted(self.below, self.rng.random(NOISE)), TARGETS - 1)
        r1, r2 = p["r"][last], p["r"][before]
        guess = r1 @ p["c1"] + r2 @ p["c2"]
        q, qn = p["q"][target], p["q"][noise]
        real = np.einsum("ij,ij->i", guess, q) + p["b"][target] - self.log_noise[target]
        fake = guess @ qn.T + (p["b"][noise] - self.log_noise[noise])
        d_real = -1 / (1 + np.exp(np.clip(real, -30, 30)))
        d_fake = 1 / (1 + np.exp(np.clip(-fake, -30, 30)))
        d_guess = d_real[:, None] * q + d_fake @ qn
        rows, grads = self._sums(np.concatenate([target, noise]), np.column_stack([np.concatenate([d_real[:, None] * guess, d_fake.T @ guess]), np.concatenate([d_real, d_fake.sum(axis=0)])]))
        ctx, d_r = self._sums(np.concatenate([last, before]), np.concatenate([d_guess @ p["c1"].T, d_guess @ p["c2"].T]))
        d_c1, d_c2 = r1.T @ d_guess, r2.T @ d_guess
        self._move("q", grads[:, :-1], rows)
        self._move("b", grads[:, -1], rows)
        self._move("r", d_r, ctx)
        self._move("c1", d_c1)
        self._move("c2", d_c2)

    def learn(self, last: np.ndarray, before: np.ndarray, target: np.ndarray) -> None:
        for at in range(0, len(target), BATCH):
            some = slice(at, at + BATCH)
            self.step(last[some], before[some], target[some])
        self.tokens += len(target)


def _flat(params: dict[str, np.ndarray]) -> np.ndarray:
    """All parameters as rows of one size."""
    b = np.zeros((-(-TARGETS // SIZE), SIZE), np.float32)
    b.ravel()[:TARGETS] = params["b"]
    return np.concatenate([params["r"], params["q"], b, params["c1"], params["c2"]])


def _unflat(rows: np.ndarray) -> dict[str, np.ndarray]:
    ends = np.cumsum([TARGETS + 1, TARGETS, -(-TARGETS // SIZE), SIZE, SIZE])
    r, q, b, c1, c2 = np.split(rows.astype(np.float32), ends[:-1])
    return {"r": r, "q": q, "b": b.ravel()[:TARGETS], "c1": c1, "c2": c2}


def _round(docs: DataFrame, model: Model, squares: dict[str, np.ndarray], k: int) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Parameters and sums of squares after one pass over ``docs``, averaged over tasks by their tokens; as they were without any row."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model, squares))
    columns = [f"{x}{i}" for x in "pg" for i in range(SIZE)]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model, squares = sent.value
        task = TaskContext.get()
        steps = Steps(model.params, squares, model.share, (k, task.partitionId() if task else 0))
        for batch in batches:
            for texts in _pieces(batch.column(0).to_pylist()):
                _, target, n, _, _ = model.encoded(texts)
                last, before = contexts(target, n)
                steps.learn(last, before, target)
        if steps.tokens:
            rows = np.column_stack([_flat(steps.p), _flat(steps.g)]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows), dtype=np.int32)), pa.array(np.full(len(rows), float(steps.tokens))), *map(pa.array, rows.T.copy())], ["at", "n", *columns])

    found = docs.mapInArrow(run, "at int, n double, " + ", ".join(f"{c} double" for c in columns))
    mean = found.groupBy("at").agg(*((F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in columns))
    table = mean.orderBy("at").toPandas()[columns].to_numpy()  # as many rows as there are vectors
    sent.destroy()
    return (_unflat(table[:, :SIZE]), _unflat(table[:, SIZE:])) if len(table) else (model.params, squares)


def _counted(found: DataFrame) -> Model:
    """The model's words and totals from written :func:`counts`; its words are the most frequent, cut between steps of an eighth in frequency."""
    step = F.floor(F.log2("n") * 6).cast("int")
    table = found.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n_words")).orderBy(F.desc("step")).collect()  # under 400 rows
    least, size = None, 0
    for row in table:
        size += row.n_words
        if size > KNOWN:
            break
        least = row.step
    top = found.where(step >= least).select("word", "n").toArrow() if least is not None else None  # at most KNOWN rows
    pairs = sorted(zip(top["n"].to_pylist(), top["word"].to_pylist(), strict=True), key=lambda p: (-p[0], p[1])) if top is not None else []
    totals = found.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    own = [w for _, w in pairs[:WORDS]]
    rest = found.where(~F.col("word").isin(own)) if own else found
    class_total, class_distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    for row in rest.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():  # a row for each class
        class_total[row["class"]], class_distinct[row["class"]] = row.n, row.v
    return Model(b"\n".join(w for _, w in pairs), np.array([n for n, _ in pairs], np.int64), totals.n or 0, totals.v, class_total, class_distinct)


def train(docs: DataFrame, found: DataFrame, text_col: str = "text") -> Model:
    """The model of all rows of ``docs``, whose :func:`counts` are ``found`` (written). Null texts are ends only. No rows: the uniform model."""
    _small_batches(docs.sparkSession)
    model = _counted(found)
    model.params = beginning(model)
    squares = {name: np.full_like(x, 1.0) for name, x in model.params.items()}
    dealt = docs.select(whole_text(text_col).alias("text"), F.pmod(F.hash("doc_id"), F.lit(ROUNDS)).alias("k"))
    for k in range(ROUNDS):
        model.params, squares = _round(dealt.where(F.col("k") == k).select("text"), model, squares, k)
        model = Model(**model.__getstate__())  # what was derived from the old parameters goes
    return model


def _scored(docs: DataFrame, model: Model, text_col: str) -> DataFrame:
    """Sums of every row over its known words, and its other words with their numbers."""
    _small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", whole_text(text_col).alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = sent.value
        base, inner = model.of_known
        class_log = np.log10(model.class_size)
        for batch in batches:
            at = 0
            for texts in _pieces(batch.column(1).to_pylist()):
                place, target, n, text, unknown = model.encoded(texts)
                last, before = contexts(target, n)
                first = np.concatenate([[0], np.cumsum(n)[:-1]])
                of_base, of_model = np.zeros(len(place)), model.log_probability(last, before, target) / np.log(10)
                seen = place >= 0
                of_base[seen] = base[place[seen]]
                of_model[seen] += inner[place[seen]]
                of_model[~seen] -= class_log[target[~seen] - WORDS]
                rare = Counter(zip(text.tolist(), unknown, strict=True))
                ends = np.concatenate([[0], np.cumsum(np.bincount(np.array([t for t, _ in rare], np.int64), minlength=len(texts)))])
                pairs = pa.StructArray.from_arrays([pa.array([w for _, w in rare], pa.binary()), pa.array(list(rare.values()), pa.int32())], ["word", "n"])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)), pa.array(n), pa.array(np.add.reduceat(seen.astype(np.int64), first)),
                        pa.array(np.add.reduceat(of_base, first)), pa.array(np.add.reduceat(of_model, first)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs),
                    ],
                    ["doc_id", "n_tokens", "n_seen", "base", "model", "rare"],
                )
                at += len(texts)

    return rows.mapInArrow(run, f"doc_id {kind_of(rows, 'doc_id')}, n_tokens bigint, n_seen bigint, base double, model double, rare array<struct<word:binary,n:int>>")


def score(docs: DataFrame, model: Model, found: DataFrame, text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every row: log10 probabilities of its whole text.

    ``base_score`` is the smoothed unigram's, ``score`` the model's. Null and empty texts are one end; rows that repeat are
    scored each; null ids keep their rows. An empty table gives an empty result; other columns are not looked at.
    """
    rows = written(_scored(docs, model, text_col).withColumn("row_", F.monotonically_increasing_id()), "scored")
    rare = rows.select("row_", F.inline("rare"))
    known = rare.join(found.select("word", F.col("n").alias("c")).hint("merge"), "word", "left")
    sums = known.groupBy("row_").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + SMOOTHING)).alias("logs"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("n_more"))
    out = rows.drop("rare").join(sums, "row_", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return out.select(
        "doc_id", "n_tokens", (F.col("n_seen") + F.coalesce("n_more", F.lit(0))).alias("n_known"), F.lit(model.total).cast("bigint").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * float(np.log10(model.size))).alias("base_score"), (F.col("model") + logs).alias("score"),
    )


def learn_and_score(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out and score all: ``doc_id, held_out`` and what :func:`score` gives."""
    train_rows = docs.where(~held_out())
    found = written(counts(train_rows), "counts")
    out = score(docs, train(train_rows, found), found)
    return out.select("doc_id", held_out().alias("held_out"), *out.columns[1:])

