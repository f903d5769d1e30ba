"""Document fingerprints: one-permutation MinHash, optimally densified, cut to low-order bits.

Every word shingle is hashed once; its high bits choose a bin and the smallest hash of a bin is kept. An
empty bin takes the value of a bin that a hash of its own number chooses, tried again until that is not
empty (optimal densification), so equal bins of two documents stay as likely as their likeness. Of each
value the low-order bits are packed. Two fingerprints then agree by chance in one of 2 ** bits bins,
which the estimate takes off.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _small_batches, kind_of, whole_text

SHINGLE, BINS, BITS = 5, 256, 4
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1), modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the base and of its inverse, kept for the longest text so far."""

    up = _powers(1 << 14, _BASE)
    down = _powers(1 << 14, _INVERSE)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.up):
            size = 1 << (n - 1).bit_length()
            cls.up, cls.down = _powers(size, _BASE), _powers(size, _INVERSE)
        return cls.up[:n], cls.down[:n]


def shingle_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """A hash of every run of ``shingle`` words (a-z for A-Z, split at ASCII white space); of all words if they are fewer."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    white = np.concatenate([[True], _WHITE[raw], [True]])
    edge = np.flatnonzero(white[1:] != white[:-1])
    starts, stops = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(1, np.uint64)
    up, down = _Powers.of(len(raw))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_LOW[raw].astype(np.uint64) + np.uint64(1)) * up)])
    words = _mix((sums[stops] - sums[starts]) * down[starts])
    size = min(shingle, len(words))
    n = len(words) - size + 1
    total = np.full(n, size, np.uint64)
    for i in range(size):
        total = (total + words[i : i + n]) * np.uint64(_BASE)
    return _mix(total)


def fingerprint(text: str, shingle: int = SHINGLE, bins: int = BINS, bits: int = BITS) -> bytes:
    """The packed low-order bits of all bins."""
    shift = np.uint64(64 - (bins - 1).bit_length())
    hashes = np.sort(shingle_hashes(text, shingle))
    at = (hashes >> shift).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    values, filled = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    values[at[first]] = hashes[first]
    filled[at[first]] = True
    source = np.arange(bins)
    empty = np.flatnonzero(~filled)
    attempt = 1
    while len(empty):
        chosen = (_mix(empty.astype(np.uint64) + np.uint64(attempt * bins)) % np.uint64(bins)).astype(np.int64)
        hit = filled[chosen]
        source[empty[hit]] = chosen[hit]
        empty = empty[~hit]
        attempt += 1
    # The bin's own number goes in, or copies of one value would agree or differ all together.
    low = _mix(values[source] + np.arange(bins, dtype=np.uint64) * np.uint64(_BASE)) & np.uint64((1 << bits) - 1)
    return np.packbits((low[:, None] >> np.arange(bits, dtype=np.uint64)[::-1] & np.uint64(1)).astype(np.uint8)).tobytes()


def likeness(a: bytes, b: bytes, bits: int = BITS) -> float:
    """Estimated share of common shingles, without what low-order bits agree by chance; 0 to 1."""
    x, y = (np.unpackbits(np.frombuffer(v, np.uint8)).reshape(-1, bits) for v in (a, b))
    same = float((x == y).all(axis=1).mean())
    chance = 0.5**bits
    return min(1.0, max(0.0, (same - chance) / (1 - chance)))


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the start of ``following``."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many of the descending ``bounds`` are above ``key``, by binary search."""
    if not bounds:
        return F.lit(0)
    limits = F.array(*map(F.lit, bounds))
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / F.lit(2)).cast("int")
        above = F.when(s["lo"] < s["hi"], F.get(limits, middle) > key)
        return F.struct(F.when(above, middle + 1).otherwise(s["lo"]).alias("lo"), F.when(above.isNull() | above, s["hi"]).otherwise(middle).alias("hi"))

    rounds = F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1))
    return F.aggregate(rounds, start, step, lambda s: s["lo"])


def in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """``bucket, last, key, doc_id, text``: rows by descending id in buckets, each bucket ended by the row that follows it.

    A bucket is a range of ids, so rows are shuffled once. The row that follows a bucket is the first of
    the next one (of the first, after the last) and has ``last`` set; there is one for each bucket.
    Null ids come after all others; equal ids in the order of their texts. Ids must be whole numbers, as
    others have no descending order to speak of.
    """
    spark = docs.sparkSession
    if kind_of(docs, id_col) not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} must be a whole number")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).withColumn("key", F.coalesce("doc_id", F.lit(-(2**63)).cast("long")))
    cuts = docs.select(F.col(id_col).cast("double").alias("x")).approxQuantile("x", [i / parts for i in range(1, parts)], 0.1 / parts) if parts > 1 else []
    rows = rows.withColumn("bucket", _bucket(F.col("key"), sorted({int(c) for c in cuts}, reverse=True)))
    heads = [(r.bucket, r.key) for r in rows.groupBy("bucket").agg(F.max("key").alias("key")).orderBy("bucket").collect()]  # one for each bucket
    if not heads:
        return rows.select("bucket", F.lit(False).alias("last"), "key", "doc_id", "text")
    before = [heads[i - 1][0] for i in range(len(heads))]
    follow = spark.createDataFrame([(key, b) for (_, key), b in zip(heads, before, strict=True)], "key long, before int")
    following = rows.join(F.broadcast(follow), "key").groupBy("before", "key").agg(F.min("text").alias("text"))
    ends = following.select(F.col("before").alias("bucket"), F.lit(True).alias("last"), "key", F.lit(None).cast("long").alias("doc_id"), "text")
    both = rows.select("bucket", F.lit(False).alias("last"), "key", "doc_id", "text").unionByName(ends)
    return both.repartitionByRange(parts, "bucket").sortWithinPartitions("bucket", "last", F.desc("key"), "text")


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """For every row its fingerprint, that of its edited text, and its likeness to that and to the next row.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. The next
    row is the one of the next lower id (see :func:`in_order`), after the last the first; the only row is
    its own next. Null counts as empty; very long texts are read whole. Texts without words all have one fingerprint, and so have any
    equal texts. An empty table gives an empty result; other columns are not looked at.
    """
    rows = in_order(docs, id_col, text_col)
    _small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
        before = None
        for batch in batches:
            out = []
            for bucket, last, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "last", "doc_id", "text")), strict=True):
                own = fingerprint(text, shingle, bins, bits)
                if before is not None:
                    old_id, old_text, old = before
                    changed = edited(old_text, text)
                    other = fingerprint(changed, shingle, bins, bits)
                    digest = hashlib.sha256(changed.encode("utf-8")).hexdigest()
                    out.append((old_id, len(old_text), digest, old.hex(), other.hex(), likeness(old, other, bits), likeness(old, own, bits)))
                before = None if last else (doc_id, text, own)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], list(names))

    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    made = rows.mapInArrow(run, schema)
    kind = kind_of(docs, id_col)
    return made if kind == "bigint" else made.withColumn("doc_id", F.col("doc_id").cast(kind))
