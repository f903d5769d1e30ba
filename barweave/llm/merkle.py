"""Merkle manifest of a table: every row a leaf, one binary tree for each group, one tree over the groups' roots.

Nodes are stored ``RUNG`` levels at a time. The ``2 ** RUNG`` consecutive nodes below one ancestor are one bounded
group, whose levels are hashed by array functions; of each node a row is kept with a link to that ancestor and with
the siblings on the way up to it. A proof is a climb along these rows: a recursive query starts from a hash for each
leaf (its own, or that of a changed row), follows the links, appends siblings and folds the hash, all leaves at once.
Wide rungs keep the climb at a ninth of the tree's height, so a proof is shuffled a few times only.

Leaves are numbered without a task of their own for a group: rows are dealt by range of (group, order, leaf), and a
row's place is its place in the part plus the rows of its group in the parts before.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_written, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels from a stored node to the ancestor that it links to, and the name of the tree over all groups' roots.
RUNG, TOP = 9, ""


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 bytes of the value as text, counted, a colon, and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_of(columns: dict[str, Column] | list[Column]) -> Column:
    values = columns.values() if isinstance(columns, dict) else columns
    return digest(*(field(c) for c in values))


def numbered(rows: DataFrame, tree: str, order: list[str], parts: int | None = None) -> DataFrame:
    """``rows`` with ``at``, the place from 0 within ``tree`` by ``order`` (nulls first), and ``n``, the rows of the tree.

    ``rows`` should be written, as they are read twice. ``order`` should tell rows apart, so that a key with many rows can be parted.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, tree, *order).sortWithinPartitions(tree, *order)
    dealt = written(dealt.withColumn("seq_", F.monotonically_increasing_id()).withColumn("part_", F.shiftright("seq_", 33)), "numbered")
    runs = dealt.groupBy(tree, "part_").agg(F.min("seq_").alias("first_"), F.count(F.lit(1)).alias("n_"))
    # One row for each part and tree in it.
    before = F.coalesce(F.sum("n_").over(W.partitionBy(tree).orderBy("part_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = written(runs.select(tree, "part_", (before - F.col("first_")).alias("shift_"), F.sum("n_").over(W.partitionBy(tree)).alias("n")), "runs")
    return dealt.join(runs, [tree, "part_"]).withColumn("at", F.col("seq_") + F.col("shift_")).drop("seq_", "part_", "shift_")


def _levels(digests: Column, height: Column) -> Column:
    """The levels above some consecutive nodes, themselves first; an odd last node is hashed alone."""

    def above(levels: Column, _: Column) -> Column:
        below = F.element_at(levels, -1)
        pairs = F.sequence(F.lit(0), F.shiftright(F.size(below) - 1, 1))
        return F.concat(levels, F.array(F.transform(pairs, lambda i: digest(F.get(below, i * 2), F.coalesce(F.get(below, i * 2 + 1), F.lit(""))))))

    steps = F.when(height > 0, F.sequence(F.lit(1), height)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(digests), above)


def _siblings(levels: Column, place: Column, height: Column) -> Column:
    """``array<struct<left, right>>``: what stands beside the node and its ancestors at each level ('' for nothing)."""

    def at(k: Column) -> Column:
        own = F.call_function("shiftright", place, k)
        other = F.coalesce(F.get(F.get(levels, k), own.bitwiseXOR(F.lit(1))), F.lit(""))
        right = own.bitwiseAND(F.lit(1)) == 1
        return F.struct(F.when(right, other).otherwise("").alias("left"), F.when(right, "").otherwise(other).alias("right"))

    steps = F.when(height > 0, F.sequence(F.lit(0), height - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, at)


def _rung(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """One row for each ancestor: ``tree, n, up, digest, last`` and its ``members`` with ``at, digest, siblings`` and what is carried."""
    member = F.struct("at", "digest", *carried)
    grouped = nodes.groupBy("tree", F.shiftright("at", RUNG).alias("up")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(member)).alias("m"))
    last = F.col("n") <= 1 << RUNG
    height = F.when(last, F.length(F.bin(F.col("n") - 1)) - (F.col("n") == 1).cast("int")).otherwise(RUNG).cast("int")
    grouped = grouped.select("tree", "n", "up", "m", last.alias("last"), height.alias("height"))
    grouped = grouped.withColumn("levels", _levels(F.transform("m", lambda x: x["digest"]), F.col("height")))

    def linked(x: Column, i: Column) -> Column:
        return F.struct(x["at"].alias("at"), x["digest"].alias("digest"), _siblings(F.col("levels"), i, F.col("height")).alias("siblings"), *(x[c].alias(c) for c in carried))

    top = F.get(F.element_at("levels", -1), F.lit(0))
    return grouped.select("tree", "n", "up", "last", top.alias("digest"), F.transform("m", linked).alias("members"))


def _built(leaves: DataFrame, carried: list[str]) -> list[DataFrame]:
    """The rungs of all trees, lowest first; ``leaves`` has ``tree, at, n, digest`` and what the lowest rung carries."""
    rungs = [written(_rung(leaves, carried), "rung")]
    while rungs[-1].where(~F.col("last")).limit(1).count():
        up = rungs[-1].where(~F.col("last")).select("tree", F.col("up").alias("at"), (F.shiftright(F.col("n") - 1, RUNG) + 1).alias("n"), "digest")
        rungs.append(written(_rung(up, []), "rung"))
    return rungs


@dataclass
class Manifest:
    """Stored nodes: ``lowest`` has the leaves with their payload, ``upper`` the nodes above, ``trees`` each group's root."""

    lowest: DataFrame
    upper: DataFrame
    trees: DataFrame
    root: str | None


def build(leaves: DataFrame, group: str, order: list[str], carried: list[str]) -> Manifest:
    """The manifest of ``leaves``: ``leaf``, ``group`` (null is a group of its own, the first), ``order`` and the columns ``carried`` along."""
    rows = leaves.select(field(F.col(group)).alias("tree"), F.col(group).alias("group_"), *order, F.col("leaf").alias("digest"), *carried)
    rows = rows.select(*dict.fromkeys(rows.columns)).withColumn("row_", F.monotonically_increasing_id())
    rows = written(rows, "leaves")
    places = numbered(rows, "tree", [*order, "digest", "row_"])
    rungs = _built(places, ["row_", *carried])
    groups = rows.groupBy("tree").agg(F.first("group_").alias("group_"))
    ends = [r.where("last").select("tree", "digest") for r in rungs]
    ends = _union(ends).join(groups, "tree").select(F.lit(TOP).alias("top"), F.col("tree").alias("below"), "group_", "digest")
    top = written(numbered(written(ends, "ends"), "top", ["group_"]).withColumnRenamed("top", "tree"), "top")
    above = _built(top, ["below"])
    root = above[-1].where("last").select("digest").first()
    # A tree's last rung goes on into the lowest rung of the tree over all groups: its siblings, and its link.
    link = above[0].select(F.col("up").alias("top_up"), F.col("last").alias("top_last"), F.inline("members")).select(F.col("below").alias("tree"), "top_up", "top_last", F.col("siblings").alias("top_siblings"))
    ends = F.col("last")
    target = {
        "up_tree": F.when(~ends, F.col("tree")).when(~F.col("top_last"), F.lit(TOP)),
        "up_rung": F.when(~ends, F.col("rung") + 1).when(~F.col("top_last"), F.lit(1)),
        "up_at": F.when(~ends, F.col("up")).when(~F.col("top_last"), F.col("top_up")),
    }
    nodes = []
    for k, rung in enumerate(rungs):
        linked = rung.join(link, "tree").withColumn("rung", F.lit(k)).withColumns(target)
        row = linked.select("tree", "rung", "last", "top_siblings", *target, F.inline("members"))
        nodes.append(row.withColumn("siblings", F.when(ends, F.concat("siblings", "top_siblings")).otherwise(F.col("siblings"))).drop("last", "top_siblings"))
    for k, rung in enumerate(above):
        out = F.when(~ends, F.lit(TOP)), F.lit(k + 1), F.col("up")
        nodes.append(rung.select("tree", F.lit(k).alias("rung"), *(c.alias(a) for c, a in zip(out, target, strict=True)), F.inline("members")))
    keep = ["tree", "rung", "at", "up_tree", "up_rung", "up_at", "siblings"]
    upper = written(_union([n.select(*keep) for n in nodes[1:]]), "nodes")
    trees = top.select(F.col("below").alias("tree"), F.col("digest").alias("subroot"))
    return Manifest(nodes[0], upper, trees, root.digest if root else None)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_FOLD = "aggregate({n}.siblings, {h}, (h, s) -> sha2(CAST(concat(s.left, h, s.right) AS BINARY), 256))"
_SIDE = "unhex(array_join(transform({n}.siblings, s -> concat(s.left, s.right)), ''))"


def climb(manifest: Manifest, start: DataFrame) -> DataFrame:
    """``row_, folded, proof``: for each row of ``start`` (leaves of ``manifest.lowest`` with a ``hash`` to fold) the hash at the root.

    ``proof`` holds the siblings, lowest first and left before right, as bytes. A recursive query; its rows are
    not limited in number.
    """
    spark = start.sparkSession
    names = [f"merkle_{x}_{uuid.uuid4().hex[:8]}" for x in ("start", "nodes")]
    start.createOrReplaceTempView(names[0])
    manifest.upper.createOrReplaceTempView(names[1])
    out = spark.sql(
        f"""WITH RECURSIVE climb AS (
              SELECT n.row_, n.up_tree, n.up_rung, n.up_at, {_FOLD.format(n='n', h='n.hash')} AS folded, {_SIDE.format(n='n')} AS proof FROM {names[0]} n
              UNION ALL
              SELECT c.row_, n.up_tree, n.up_rung, n.up_at, {_FOLD.format(n='n', h='c.folded')}, concat(c.proof, {_SIDE.format(n='n')})
              FROM climb c JOIN {names[1]} n ON c.up_tree = n.tree AND c.up_rung = n.rung AND c.up_at = n.at)
            SELECT * FROM climb LIMIT ALL"""
    )
    for name in names:
        spark.catalog.dropTempView(name)
    return out.where("up_tree IS NULL").select("row_", "folded", "proof")


def proofs(docs: DataFrame, changed: dict[str, Column], fields: tuple[str, ...] = FIELDS, group: str = "lang", order: str = "doc_id") -> DataFrame:
    """Of each row ``order``'s column, ``leaf, subroot, root, proof_sha256, folded_root, verified``.

    The manifest is built over the rows as they are; then each row is taken with the columns of ``changed``
    in place of its own, and its hash is folded up along the stored siblings: ``verified`` tells whether the
    root is reached. Null fields count as ``-``; null groups are a group, and a null order comes first. Rows
    that repeat an order are in the order of their leaves; rows that repeat whole are leaves each. Texts are taken whole. A
    single row is its own root, with an empty proof. An empty table gives an empty result; other columns, whatever
    their names, are not looked at.
    """
    own = {c: F.col(f"`{c}`") for c in fields}
    other = leaf_of({c: changed.get(c, own[c]) for c in fields})
    differs = F.lit(False)
    for c, value in changed.items():
        differs = differs | ~value.eqNullSafe(own[c])
    leaves = docs.select(F.col(order).alias("id_"), F.col(group).alias("in_"), leaf_of(own).alias("leaf"), F.when(differs, other).alias("changed_"))
    manifest = build(leaves, "in_", ["id_"], ["id_", "changed_"])
    start = manifest.lowest.withColumn("hash", F.coalesce("changed_", "digest"))
    folded = climb(manifest, start).select("row_", "folded", F.sha2(F.lower(F.hex("proof")).cast("binary"), 256).alias("proof_sha256"))
    folded = written(folded, "climb")
    rows = manifest.lowest.select("row_", "tree", F.col("id_").alias(order), F.col("digest").alias("leaf"))
    out = rows.join(manifest.trees, "tree").join(folded.hint("merge"), "row_")
    root = F.lit(manifest.root)
    out = out.select(order, "leaf", "subroot", root.alias("root"), "proof_sha256", F.col("folded").alias("folded_root"), (F.col("folded") == root).alias("verified"))
    drop_written(docs.sparkSession, manifest.upper)
    return out
