"""SimHash near copies at a similarity of word shingle sets: what operator 3 is to bits, at Jaccard ``LEAST``.

Texts with one set of shingles are one node, with a SimHash of the set in ``WORDS`` words of 64 bits. As in :mod:`simhash`, pairs of
nodes meet in tries below roots that must agree exactly, their differing bits are added up, and a pair over
the budget goes. Sets that are alike by 0.8 differ in 78 of 512 bits on average and in 114 now and then, and no
choice of exact *bits* as roots finds such pairs in work that does not grow with the square of the corpus. The
roots are therefore exact least values of the set: a node hangs in ``BANDS`` tries, rooted at ``ROWS`` MinHash values each;
a pair with similarity s shares no root with chance (1 - s ** ROWS) ** BANDS, which is 3e-6 at 0.8 and less
above. Below a root the words of the fingerprints follow, ``LEVEL`` to a level, and :func:`walk` expands pairs of nodes together
level by level, as operator 3 does, each with the bits that differ so far; over the budget (sets that are alike by less
than about 0.6) it goes. What is left of the pairs is confirmed on the whole shingle sets.

Only which sets hang together is asked for, so a pair of nodes below which there is one component is not walked. In rounds, one side
of the walk is the whole trie below a root and the other the tries of a few leaves of its largest component, others in each round, which
joins large groups of copies in a number of pairs that grows with the group. What is then still apart, but below one root, may be many
texts of one family that are just not similar enough. Of them only pairs can matter that share one of
the rarest ninth of the smaller set's shingles and the rarest fifth of the larger one's: similar sets cannot lack all of these. So their
tries are rooted at such shingles and walked in the same way; where a shingle stands in the two orders bounds what can be common to both (the
prefix and the position filter of set joins, which are exact), and that prunes pairs of nodes as the budget does.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, extended, per_text, whole_text, written
from .graph import components
from .minhash import _mix, shingle_hashes
from .simhash import of_hashes_words

#: Words of a shingle, least similarity, tries and the values at the root of each, words of a fingerprint and its bits that may differ.
SHINGLE, LEAST, BANDS, ROWS, WORDS, BUDGET = 5, 0.8, 24, 4, 8, 116
#: Leader rounds (as many at any size) and leaders of each; they would end before that at so few pairs for a row of the tries.
ROUNDS, LEADERS, PAIRS = 2, 4, 0
#: Rows that are broadcast at most.
BROADCAST = 50_000
_SEEDS = _mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTORS = _mix(_SEEDS) | np.uint64(1)
_PRINT = [f"fp{i}" for i in range(WORDS)]
#: Words of a fingerprint to a level of the tries.
LEVEL = 2


def shingles(text: str) -> np.ndarray:
    """The sorted set of a text's shingle hashes."""
    return np.unique(shingle_hashes(text, SHINGLE))


def node_of(found: np.ndarray) -> int:
    """A signed number that stands for the set."""
    from xxhash import xxh3_64_intdigest

    return int(np.uint64(xxh3_64_intdigest(found.tobytes())).astype(np.int64))


def bands(found: np.ndarray) -> np.ndarray:
    """One number for each trie: equal where all least values at its root are."""
    least = np.full(BANDS * ROWS, ~np.uint64(0), np.uint64)
    for start in range(0, len(found), 1 << 12):
        values = (found[start : start + (1 << 12), None] ^ _SEEDS) * _FACTORS
        least = np.minimum(least, values.min(axis=0))
    out = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out.astype(np.int64)


def _marks(docs: DataFrame) -> DataFrame:
    """``doc_id, node, n, bands`` and the words of the fingerprint, of every row."""

    def make(rows):
        import pyarrow as pa

        sets = [shingles(t) for t in rows]
        return [
            pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()),
            pa.array([bands(s) for s in sets], pa.list_(pa.int64())), *(pa.array(w) for w in np.array([of_hashes_words(s, WORDS) for s in sets], np.int64).reshape(-1, WORDS).T),
        ]

    return per_text(docs, make, f"node bigint, n int, bands array<bigint>, {', '.join(f'{c} bigint' for c in _PRINT)}")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, shingles`` of the rows of ``docs`` whose ids are in ``wanted``."""
    ids = wanted.select(F.col("doc_id").alias("wanted_id")).distinct()
    ids = ids.hint("broadcast" if ids.count() <= BROADCAST else "shuffle_merge")
    texts = docs.select("doc_id", whole_text().alias("text"))
    texts = texts.join(ids, texts["doc_id"].eqNullSafe(ids["wanted_id"]), "left_semi")

    def make(rows):
        import pyarrow as pa

        sets = [shingles(t) for t in rows]
        return [pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))]

    return per_text(texts, make, "node bigint, shingles array<bigint>").select("node", "shingles")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b``: those of ``pairs`` whose sets are similar enough."""
    left, right = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return pairs.join(left, "a").join(right, "b").where(common >= LEAST * (F.size("set_a") + F.size("set_b") - common)).select("a", "b")


def _least_common(n: Column, share: float) -> Column:
    """The least whole number that is ``share`` of ``n`` or more."""
    return F.ceil(F.lit(share) * n - 1e-9)


def _rare(apart: DataFrame, sets: DataFrame) -> DataFrame:
    """``apart`` (``node, root, n``) with ``token, at, m, small``: the rarest shingles of each set, of which similar ones share one.

    A set that is the larger of two similar ones lacks at most a fifth of its shingles in the other; the smaller one at most
    a ninth, as both together lack as little as the union allows. So it is enough that the rarest ninth of
    the smaller (``small``) meets the rarest fifth of the larger. ``at`` is a shingle's place, from 0, among the ``m`` that the set shares with
    any other, the rarest first. A shingle that one set alone has is among its rarest, but finds no other; where such ones make
    up all of these, the set is similar to none: texts of one template that differ in more than that do not meet at all.
    """
    tokens = sets.join(apart.select("node"), "node", "left_semi").select("node", F.explode("shingles").alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n_sets")).where("n_sets > 1")
    ordered = tokens.join(shared, "token").groupBy("node").agg(F.array_sort(F.collect_set(F.struct("n_sets", "token"))).alias("tokens"))
    alone = F.col("n") - F.size("tokens")
    first = apart.join(ordered, "node")
    first = first.withColumn("left", (F.col("n") - _least_common(F.col("n"), LEAST) + 1 - alone).cast("int")).where("left > 0")
    few = F.col("n") - _least_common(F.col("n"), 2 * LEAST / (1 + LEAST)) + 1 - alone
    rare = first.select("node", "root", "n", F.size("tokens").alias("m"), few.alias("few"), F.posexplode(F.slice("tokens", F.lit(1), F.col("left"))).alias("at", "t"))
    rare = rare.select("node", "root", "n", "m", "at", F.col("t.token").alias("token"), (F.col("at") < F.col("few")).alias("small"))
    several = rare.groupBy("token").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.max("small").alias("any")).where("a < b AND any").select("token")
    return rare.join(several, "token", "left_semi")


def _prefix(depth: int) -> Column:
    """The name of a leaf's node at a depth: 0 for the root, the hash of the words so far, and at last the leaf's own number."""
    if not depth:
        return F.lit(0).cast("long")
    return F.xxhash64(*_PRINT[: depth * LEVEL]) if depth * LEVEL < WORDS else F.col("node")


def _level(leaves: DataFrame, depth: int, side: str) -> DataFrame:
    """The trie nodes one below ``depth``, with the words of that level and, over the leaves below each: components, sizes and ``top``."""
    words = _PRINT[depth * LEVEL : (depth + 1) * LEVEL]
    held = {"low": F.min("root"), "high": F.max("root"), "least": F.min("n"), "most": F.max("n"), "top": F.max("top")} | {c: F.first(c) for c in words}
    return leaves.groupBy("key", _prefix(depth).alias(side), _prefix(depth + 1).alias(f"{side}_down")).agg(*(v.alias(f"{k}_{side}") for k, v in held.items()))


def walk(left: DataFrame, right: DataFrame, ordered: bool = False) -> DataFrame:
    """``a, b``: leaves of ``left`` and ``right`` below one ``key``, of different components, that may be similar, each pair once.

    Both hold ``key, node, root, n, top`` and the fingerprint, a node once for each key; ``top`` bounds what a set can have in common with another
    that it meets below that key. From the roots on, pairs of trie nodes are expanded together level by level, each carrying the bits
    that differ so far. A pair goes if they are over the budget, if all leaves below it are of one component, or if
    none below it can have enough in common; with ``ordered``, also if no set on the left is the smaller one (of equal ones: by number).
    """
    pairs = None
    for depth in range(WORDS // LEVEL):
        a, b = _level(left, depth, "a"), _level(right, depth, "b")
        met = a.drop("a").join(b.drop("b"), "key").withColumn("off", F.lit(0)) if pairs is None else pairs.join(a, ["key", "a"]).join(b, ["key", "b"])
        words = _PRINT[depth * LEVEL : (depth + 1) * LEVEL]
        off = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in words), F.col("off"))
        several = F.least("low_a", "low_b") < F.greatest("high_a", "high_b")
        enough = F.least("top_a", "top_b") * (1 + LEAST) >= LEAST * (F.col("least_a") + F.col("least_b")) - 1e-9
        near = several & (off <= BUDGET) & enough
        if ordered:
            leaves = (depth + 1) * LEVEL >= WORDS
            near &= F.struct("least_a", "a_down") < F.struct("most_b", "b_down") if leaves else F.col("least_a") <= F.col("most_b")
        pairs = met.where(near).select("key", F.col("a_down").alias("a"), F.col("b_down").alias("b"), off.cast("int").alias("off"))
    return pairs.select("a", "b").distinct()


def _meeting(rare: DataFrame) -> DataFrame:
    """``a, b``: pairs of :func:`_rare` below a token that both have, in different components, that may be similar by their bits, sizes and the token's places.

    At the first token that two sets share, all that is common to them stands from there on. A pair that cannot be similar by
    that is not at its first token, or not similar; so similar pairs are met at their first token at least, and most of the others never.
    """
    leaves = rare.select(F.col("token").alias("key"), "node", "root", "n", (F.col("m") - F.col("at")).alias("top"), "small", *_PRINT)
    return walk(leaves.where("small"), leaves, ordered=True)


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, root`` for the nodes that are similar to another; ``nodes`` holds ``node, n, bands, doc_id`` and the fingerprint, each node once."""
    spark = docs.sparkSession
    rows = nodes.select("node", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("band")
    rows = written(rows.join(shared, "band", "left_semi").join(nodes.select("node", "n", *_PRINT), "node"), "bands")
    sets = written(_sets(docs, nodes.join(rows.select("node").distinct(), "node", "left_semi")), "sets")
    n_rows = rows.count()
    found = labels = None
    for k in range(ROUNDS + 1):
        placed = rows.withColumn("root", F.col("node")) if labels is None else rows.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
        some = F.array(*(F.max_by(F.struct("node", "n", *_PRINT), F.xxhash64("node", F.lit(k * LEADERS + i))) for i in range(LEADERS)))
        parts = placed.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n_part"), some.alias("some"))
        sizes = parts.groupBy("band").agg(
            F.sum("n_part").alias("size"), F.sum(F.col("n_part") * F.col("n_part")).alias("inner"), F.count(F.lit(1)).alias("n_roots"),
            F.max_by(F.struct("root", "some"), F.struct("n_part", F.xxhash64("root", F.lit(k)))).alias("leader"),
        )
        apart = written(sizes.where("n_roots > 1"), "apart")
        across = apart.agg(F.sum((F.col("size") * F.col("size") - F.col("inner")) / 2)).first()[0] or 0
        if not across:
            break
        last = k == ROUNDS or across <= PAIRS * n_rows
        if last:
            here = written(placed.join(apart.select("band"), "band", "left_semi").drop("band").dropDuplicates(["node"]), "here")
            rare = written(_rare(here.select("node", "root", "n"), sets).join(here.select("node", *_PRINT), "node"), "rare")
            met = _meeting(rare)
            used = [apart, here, rare]
        else:
            leaders = apart.select(F.col("band").alias("key"), F.col("leader.root").alias("root"), F.explode(F.array_distinct("leader.some")).alias("one"))
            leaders = leaders.select("key", "root", "one.*").withColumn("top", F.col("n"))
            leaves = placed.join(apart.select("band"), "band", "left_semi").withColumnRenamed("band", "key").withColumn("top", F.col("n"))
            leaves = written(leaves, "leaves")
            met = walk(leaders, leaves)
            used = [apart, leaves]
        pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        new = written(_confirmed(pairs, sets), "near")
        for df in used:
            drop_written(spark, df)
        found = new if found is None else found.unionByName(new)
        labels = components(found)
        if last:
            break
    drop_written(spark, rows)
    drop_written(spark, sets)
    return labels if labels is not None else nodes.select("node", F.col("node").alias("root")).limit(0)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (columns ``doc_id``, ``text`` and any others) with one document of each group of near copies.

    Groups are what hangs together by pairs of at least ``LEAST`` similarity. The smallest doc_id of a group
    stays; a null id stays only in a group without any other. Rows that repeat an id and a shingle set count
    as one. Null and empty texts and texts without words are copies of each other; very long texts are
    taken whole. Other columns stay as they are, whatever their names; an empty table stays empty.
    """
    spark = docs.sparkSession
    marked = written(_marks(docs), "marks")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"))
    nodes = marked.groupBy("node").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), *(F.first(c).alias(c) for c in _PRINT), first.alias("first"))
    nodes = written(nodes.select("node", "n", "bands", *_PRINT, F.col("first.doc_id").alias("doc_id")), "nodes")
    roots = links(docs, nodes)
    found = nodes.join(roots, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    ids = written(found.groupBy("root").agg(F.min(first).alias("first")).select("first.doc_id", "first.node"), "firsts")
    drop_written(spark, nodes)
    if not marked.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count():
        gone = written(marked.select("doc_id").join(ids, "doc_id", "left_anti"), "gone")
        return docs.join(gone.hint("broadcast" if gone.count() <= BROADCAST else "shuffle_merge"), "doc_id", "left_anti").select(docs.columns)

    def make(texts):
        import pyarrow as pa

        return pa.array([node_of(shingles(t)) for t in texts], pa.int64())

    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "text")
    full = extended(rows, make, "node", "bigint")
    match = full["doc_id"].eqNullSafe(ids["doc_id"]) & (full["node"] == ids["node"])
    return full.join(ids, match, "left_semi").dropDuplicates(["doc_id", "node"]).select("row.*")
