"""SimHash near-duplicates: 64-bit fingerprints, linked by a self-join of a binary trie.

The trie is walked in Spark. Fingerprints within ``budget`` bits agree on at least ``blocks - budget``
of ``blocks`` equal blocks, so for every choice of that many blocks a trie is rooted at their bits
(those must agree exactly) and the remaining bits follow, eight to a level. Pairs of nodes are expanded
together level by level, each carrying the bits that differ so far; a pair over the budget is dropped.
A node has at most 256 children and as many partners as there are prefixes within the budget, so no
key of any join holds more than a bounded number of rows, however large a group of copies is.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, extended, left_joined, per_text, written
from .graph import components

SHINGLE, SEED, BUDGET, BLOCKS, LEVEL = 3, 42, 2, 4, 8


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of the word shingles; 0 without words."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, only ASCII white space
    if not words:
        return 0
    parts = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return of_hashes(np.fromiter(map(xxh64_intdigest, parts, repeat(SEED)), np.uint64))


def of_hashes(hashes: np.ndarray) -> int:
    """The signed number whose bits are those that more than half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 15):
        chunk = hashes[start : start + (1 << 15)].astype(">u8")
        ones += np.unpackbits(chunk.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes)).view(">i8")[0])


def of_hashes_words(hashes: np.ndarray, words: int) -> np.ndarray:
    """A fingerprint of ``words`` signed numbers: every hash gives so many more, all by the rule of :func:`of_hashes`."""
    salts = np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ones = np.zeros(64 * words, np.int64)
    for start in range(0, len(hashes), 1 << 12):
        mixed = (hashes[start : start + (1 << 12), None] ^ salts) * np.uint64(0xD6E8FEB86659FD93)
        mixed = ((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) ^ (mixed >> np.uint64(29))
        ones += np.unpackbits(mixed.astype(">u8").view(np.uint8), axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(ones * 2 > len(hashes)).view(">i8").astype(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` for every row."""

    def make(texts):
        import pyarrow as pa

        return [pa.array([fingerprint(t, shingle) for t in texts], pa.int64())]

    return per_text(docs, make, "fp bigint", id_col, text_col)


def _bits(at: list[int], width: int) -> Column:
    """The named blocks (0: highest) of ``fp``, side by side."""
    blocks = 64 // width
    out = F.lit(0).cast("long")
    for i in at:
        part = F.shiftrightunsigned("fp", (blocks - 1 - i) * width).bitwiseAND(F.lit((1 << width) - 1))
        out = F.shiftleft(out, width).bitwiseOR(part)
    return out


def near_pairs(fps: DataFrame, budget: int = BUDGET, blocks: int = BLOCKS) -> DataFrame:
    """``a, b``: every pair of different fingerprints (a < b, as signed numbers) within ``budget`` bits.

    ``fps`` holds distinct values of ``fp``. There are at most sum(C(64, i), i <= budget) partners for each.
    """
    if 64 % blocks or blocks <= budget:
        raise ValueError("blocks must divide 64 and exceed the error budget")
    width = 64 // blocks
    roots = list(combinations(range(blocks), blocks - budget))
    rest_bits = width * budget
    tries = F.array(*(F.struct(F.lit(k).alias("trie"), _bits(list(keep), width).alias("root"), _bits([i for i in range(blocks) if i not in keep], width).alias("rest")) for k, keep in enumerate(roots)))
    rooted = fps.select("fp", F.explode(tries).alias("t")).select("t.*", "fp")
    shared = rooted.groupBy("trie", "root").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("trie", "root")
    leaves = written(rooted.join(shared, ["trie", "root"], "left_semi"), "trie")
    pairs = leaves.select("trie", "root").distinct().withColumns({"a": F.lit(0).cast("long"), "b": F.lit(0).cast("long"), "off": F.lit(0)})
    depth = 0
    while depth < rest_bits:
        step = min(LEVEL, rest_bits - depth)
        depth += step
        prefix = F.shiftrightunsigned("rest", rest_bits - depth)
        nodes = leaves.groupBy("trie", "root", prefix.alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("fp"))
        nodes = nodes.withColumn("up", F.shiftrightunsigned("node", step))
        left = nodes.select("trie", "root", F.col("up").alias("a"), F.col("node").alias("a2"), F.col("n").alias("n_a"), F.col("fp").alias("fp_a"))
        right = nodes.select("trie", "root", F.col("up").alias("b"), F.col("node").alias("b2"), F.col("fp").alias("fp_b"))
        off = F.col("off") + F.bit_count(F.col("a2").bitwiseXOR(F.col("b2")).bitwiseAND(F.lit((1 << step) - 1)))
        met = pairs.join(left, ["trie", "root", "a"]).join(right, ["trie", "root", "b"])
        met = met.where((off <= budget) & ((F.col("a2") < F.col("b2")) | ((F.col("a2") == F.col("b2")) & (F.col("n_a") > 1))))
        pairs = met.select("trie", "root", F.col("a2").alias("a"), F.col("b2").alias("b"), off.cast("int").alias("off"), "fp_a", "fp_b")
        if depth < rest_bits:
            pairs = written(pairs.drop("fp_a", "fp_b"), "nodes")
    return pairs.select(F.least("fp_a", "fp_b").alias("a"), F.greatest("fp_a", "fp_b").alias("b")).distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, fp, fingerprint, component_id, n_links``.

    Rows with the same fingerprint are linked, and so are rows whose fingerprints differ in at most
    ``budget`` bits. component_id is the smallest id that can be reached; n_links counts the other
    *fingerprints* within the budget. Null and empty texts and texts without words have fingerprint 0
    and are linked like any others; very long texts are read whole. Null ids get a component but never name one that has an id. An
    empty table gives an empty result; other columns are not looked at.
    """
    return _grouped(docs, id_col, text_col, budget).drop("root")


def _grouped(docs: DataFrame, id_col: str, text_col: str, budget: int) -> DataFrame:
    marked = written(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    links = written(near_pairs(distinct.select("fp"), budget), "links")
    roots = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("n_links"))
    joined = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").join(degree, "fp", "left")
    joined = joined.select("fp", "first", F.coalesce("root", "fp").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    joined = written(joined, "rooted")
    named = joined.where("n_links > 0").groupBy("root").agg(F.min("first").alias("component_id"))
    named = joined.join(named, "root", "left").select("fp", "root", F.coalesce("component_id", "first").alias("component_id"), "n_links")
    drop_written(docs.sparkSession, links)
    out = left_joined(marked, named, "fp")
    return out.select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links", "root")


def keep_one(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The rows of ``docs`` (columns ``doc_id``, ``text`` and any others) with one document of each group.

    The smallest doc_id of a group stays; a null id stays only in a group without any other. Rows that
    repeat an id and a fingerprint count as one. Null and empty texts and texts without words are one
    group; very long texts are taken whole. Other columns stay as they are, whatever their names; an
    empty table stays empty.
    """
    found = written(_grouped(docs, "doc_id", "text", budget), "groups")
    if not found.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count():
        return docs.join(found.where("doc_id = component_id").select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")
    ids = found.groupBy("root").agg(F.min(first).alias("first")).select("first.doc_id", "first.fp")

    def make(texts):
        import pyarrow as pa

        return pa.array([fingerprint(t) for t in texts], pa.int64())

    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "text")
    full = extended(rows, make, "fp", "bigint")
    match = full["doc_id"].eqNullSafe(ids["doc_id"]) & (full["fp"] == ids["fp"])
    return full.join(ids, match, "left_semi").dropDuplicates(["doc_id", "fp"]).select("row.*")
