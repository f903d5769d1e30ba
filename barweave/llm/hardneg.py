"""Hard negatives: for each anchor and positive, the best other-label rows whose score lies in a window below the positive's.

Every anchor has a few positives, so a few overlapping windows. Their upper limits, in falling order, cut the scores into disjoint
slots: slot j holds the scores up to positive j's limit and above positive j + 1's. Whatever a window answers comes from its
own slot and those after it, so the best ``k`` of each slot are enough for all windows. Tasks keep these for the
rows that they read (a combiner), a reduction keeps the best of them, and merging slots from the last upwards
gives each positive its list: slots are disjoint and fall, so a merge is a concatenation cut at ``k``.

Scores are inner products of whole-number vectors, exact, as matrix products of a block of rows and a block of anchors. Anchors
are packed in blocks of at most ``BLOCK`` rows and each block of rows meets each block of anchors once: by
broadcast while all anchors are small, by a salted shuffle of the blocks beyond that. Neither passes the driver's Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_written, written

#: Positives of an anchor, negatives of a window, its limits as shares (of 100) of the positive's score.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Anchors in a block, rows that are multiplied at once, components in a block of rows, bytes of anchors that are broadcast at most.
BLOCK, STEP, CELLS, BROADCAST = 8192, 1024, 1 << 20, 64 << 20
#: Blocks of anchors whose best rows a task holds at once; others are put out and found again.
HELD = 16
_NONE = np.iinfo(np.int64).min


def whole_numbers(vector: Column, scale: int = 256) -> Column:
    """Components as floor(scale * x), x as double; NULL where any is null, not finite or beyond 2 ** 53."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < 2.0**53))
    return F.when(ok, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _pack(rows: DataFrame, name: str, most: int) -> DataFrame:
    """Rows ``id, label, vector`` as blocks: ``{name}_ids, _labels, _dim`` and ``_cells`` (16-, 32- or 64-bit numbers, shorter vectors end with zeros)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                lengths = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
                step = most
                dim = int(lengths[at : at + step].max(initial=0))
                while step > 1 and step * dim > CELLS:
                    step = max(1, CELLS // dim)
                    dim = int(lengths[at : at + step].max(initial=0))
                part = batch.slice(at, step)
                n = lengths[at : at + step].astype(np.int64)
                cells = np.zeros((part.num_rows, dim), np.int64)
                cells[np.arange(dim) < n[:, None]] = part.column(2).flatten().to_numpy(zero_copy_only=False)
                most_cell = int(np.abs(cells).max(initial=0))
                kind = np.int16 if most_cell < 1 << 15 else np.int32 if most_cell < 1 << 31 else np.int64
                ids, labels = (pa.array([part.column(c).to_numpy(zero_copy_only=False)], pa.list_(pa.int64())) for c in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [ids, labels, pa.array([cells.astype(kind).tobytes()], pa.binary()), pa.array([dim], pa.int32())], [f"{name}_{x}" for x in ("ids", "labels", "cells", "dim")]
                )
                at += step

    return rows.select("id", "label", "vector").mapInArrow(run, f"{name}_ids array<bigint>, {name}_labels array<bigint>, {name}_cells binary, {name}_dim int")


def _met(rows: DataFrame, anchors: DataFrame, n_bytes: int, n_blocks: int) -> DataFrame:
    """Each block of rows with each block of anchors."""
    spark = rows.sparkSession
    packed = _pack(rows, "r", 1 << 20)
    ids = F.explode(F.sequence(F.lit(0), F.lit(max(0, n_blocks - 1)))).alias("block")
    if n_bytes <= BROADCAST:
        return packed.select("*", ids).join(F.broadcast(anchors), "block")  # at most BROADCAST bytes, counted
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    left = packed.select("*", salt.alias("salt"), ids)
    right = anchors.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    return left.join(right.hint("shuffle_hash"), ["block", "salt"])


def _products(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in single or double precision where no partial sum can be rounded."""
    dim = min(rows.shape[1], anchors.shape[1])
    r, a = rows[:, :dim], anchors[:, :dim]
    bound = float(np.abs(r.astype(np.float64)).max(initial=0)) * float(np.abs(a.astype(np.float64)).max(initial=0)) * max(dim, 1)
    if bound >= 2.0**56:
        raise ValueError("inner products beyond 56 bits")
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
    return r.astype(kind) @ a.T.astype(kind)


class Best:
    """The best ``k`` rows of each slot of each anchor: higher scores first, then smaller ids."""

    def __init__(self, n_anchors: int, n_slots: int, k: int):
        self.scores = np.full((n_anchors, n_slots, k), _NONE)
        self.ids = np.zeros((n_anchors, n_slots, k), np.int64)

    def add(self, slot: int, anchors: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Offer rows to a slot; ``anchors`` are places in the block."""
        k = self.scores.shape[2]
        touched = np.unique(anchors)
        old_s, old_i = self.scores[touched, slot].ravel(), self.ids[touched, slot].ravel()
        full = old_s != _NONE
        who = np.concatenate([anchors, np.repeat(touched, k)[full]])
        s, i = np.concatenate([scores, old_s[full]]), np.concatenate([ids, old_i[full]])
        order = np.lexsort((i, -s, who))
        who, s, i = who[order], s[order], i[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        keep = place < k
        self.scores[who[keep], slot, place[keep]], self.ids[who[keep], slot, place[keep]] = s[keep], i[keep]

    def rows(self, block: int):
        import pyarrow as pa

        a, slot, place = np.nonzero(self.scores != _NONE)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(a), block, np.int32)), pa.array(a.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(self.scores[a, slot, place]), pa.array(self.ids[a, slot, place])],
            ["block", "place", "slot", "score", "id"],
        )


def _read(batch, row: int, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = (batch.column(f"{name}_{x}")[row].values.to_numpy() for x in ("ids", "labels"))
    cells, dim = batch.column(f"{name}_cells")[row].as_buffer(), batch.column(f"{name}_dim")[row].as_py()
    width = cells.size // max(1, len(ids) * dim)
    return ids, labels, np.frombuffer(cells, f"i{width or 8}").reshape(len(ids), dim)


def _best(met: DataFrame, k: int, same_label: bool) -> DataFrame:
    """``block, place, slot, score, id``: the best of each task; slots are cut by the blocks' ``limits`` (one slot without them).

    ``limits`` has, for each anchor of the block, the upper limits of its slots and, last, the least score of any window.
    """

    def step(best: Best, rows: tuple, anchors: tuple, limits: np.ndarray | None) -> None:
        ids, labels, cells = rows
        a_ids, a_labels, a_cells = anchors
        found = _products(cells, a_cells)
        fits = (labels[:, None] == a_labels) == same_label
        if same_label:
            fits &= ids[:, None] != a_ids
        for slot in range(best.scores.shape[1]):
            # What ties with the last of a full list may still come before it by its id.
            above = best.scores[:, slot, -1] - (best.scores[:, slot, -1] != _NONE)
            ok = fits
            if limits is not None:
                # The next column is the next slot's upper limit, or, at the last slot, the least score of any window.
                above = np.maximum(above, np.maximum(limits[:, slot + 1] - (slot + 2 == limits.shape[1]), limits[:, -1] - 1))
                ok = ok & (found <= limits[:, slot].astype(found.dtype))
            ok = ok & (found > above.astype(found.dtype))
            r, a = np.nonzero(ok)
            score = found[r, a].astype(np.int64)
            enters = (score > best.scores[a, slot, -1]) | (ids[r] < best.ids[a, slot, -1])
            if enters.any():
                best.add(slot, a[enters], score[enters], ids[r][enters])

    def run(batches: Iterator) -> Iterator:
        held: dict[int, Best] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                block = batch.column("block")[row].as_py()
                rows, anchors = _read(batch, row, "r"), _read(batch, row, "a")
                limits = None
                if not same_label:
                    limits = np.frombuffer(batch.column("limits")[row].as_buffer(), np.int64).reshape(len(anchors[0]), -1)
                if block not in held:
                    if len(held) >= HELD:
                        first = next(iter(held))
                        yield held.pop(first).rows(first)
                    held[block] = Best(len(anchors[0]), 1 if limits is None else limits.shape[1] - 1, k)
                for at in range(0, len(rows[0]), STEP):
                    for a in range(0, len(anchors[0]), STEP):
                        some = slice(a, a + STEP)
                        view = Best.__new__(Best)
                        view.scores, view.ids = held[block].scores[some], held[block].ids[some]
                        step(view, tuple(x[at : at + STEP] for x in rows), tuple(x[some] for x in anchors), None if limits is None else limits[some])
        for block, best in held.items():
            yield best.rows(block)

    found = met.mapInArrow(run, "block int, place int, slot int, score bigint, id bigint")
    rank = F.row_number().over(W.partitionBy("block", "place", "slot").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _limits(anchors: DataFrame, positives: DataFrame, low: int, high: int, n_positives: int) -> DataFrame:
    """Blocks of ``anchors`` with ``limits``: floor(high/100 p) of each positive in falling order, then the least ceil(low/100 p) of any.

    An anchor with fewer positives repeats its last limit (an empty slot); without any it has limits that nothing meets.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                n = len(batch.column("a_ids")[row])
                scores = np.full((n, n_positives), _NONE)
                for p in batch.column("found")[row].as_py() or []:
                    scores[p["place"], p["rank"] - 1] = p["score"]
                limits = np.full((n, n_positives + 1), _NONE + 1)
                limits[:, -1] = np.iinfo(np.int64).max
                has = scores != _NONE
                limits[:, :-1][has] = scores[has] * high // 100
                for j in range(1, n_positives):
                    limits[:, j] = np.where(has[:, j], limits[:, j], limits[:, j - 1])
                # A negative score has no window: its upper limit is below its lower one.
                asks = has & (scores >= 0)
                least = np.where(asks, -(-scores * low // 100), np.iinfo(np.int64).max)
                limits[:, -1] = least.min(axis=1)
                out.append(limits.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], [*batch.schema.names[:-1], "limits"])

    found = positives.groupBy("block").agg(F.collect_list(F.struct("place", "rank", "score")).alias("found"))  # at most BLOCK anchors' positives
    kinds = "a_ids array<bigint>, a_labels array<bigint>, a_cells binary, a_dim int"
    return anchors.join(found, "block", "left").select("block", *(k.split()[0] for k in kinds.split(", ")), "found").mapInArrow(run, f"block int, {kinds}, limits binary")


def mine(
    vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = 256,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for every anchor, positive and its negatives.

    Vectors become whole numbers by ``scale`` and are compared by inner product; higher scores come first, ties by smaller id. The
    rows for which ``anchor`` holds are anchors; the positives of one are its first ``n_positives`` other rows of the same label; of each the
    first ``n_negatives`` rows of other labels are returned whose score is between ``low`` and ``high`` hundredths of the positive's.
    Rows with a null id, label or vector, or with a null or non-finite component, take no part. Missing
    components of shorter vectors count as 0. Rows that repeat an id, label and vector count as one; a row with the
    anchor's own id is no positive of it. Anchors that repeat an id with other vectors are anchors each. An empty table gives an empty result;
    other columns are not looked at. Inner products beyond 56 bits are an error.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), whole_numbers(F.col(vector_col), scale).alias("vector"), anchor.alias("anchor"))
    rows = written(rows.dropna(subset=["id", "label", "vector"]), "vectors")
    repeated = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n_")).where("n_ > 1").select("id")
    if repeated.limit(1).count():
        rows = written(rows.dropDuplicates(["id", "label", "vector"]), "vectors")
    chosen = rows.where("anchor")
    size = chosen.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dim")).first()
    dim = max(1, size.dim or 0)
    block = max(1, min(BLOCK, CELLS // dim))
    n_blocks = -(-size.n // block)
    # A part holds its share of the rows, give or take; blocks beyond the bound are cut again when they are packed.
    packed = _pack(chosen.repartition(max(1, n_blocks)), "a", block)
    anchors = written(packed.withColumn("seq", F.monotonically_increasing_id()), "anchors")
    order = W.orderBy("seq")  # one row a block
    anchors = written(anchors.withColumn("block", F.row_number().over(order) - 1).drop("seq"), "blocks")
    n_blocks = anchors.count()
    n_bytes = size.n * (dim + 3 + n_positives) * 8
    positives = written(_best(_met(rows, anchors, n_bytes, n_blocks), n_positives, True), "positives")
    limited = written(_limits(anchors, positives, low, high, n_positives), "limits")
    slots = written(_best(_met(rows, limited, n_bytes, n_blocks), n_negatives, False), "slots")
    entry = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "id")))
    lists = slots.groupBy("block", "place", "slot").agg(entry.alias("list")).groupBy("block", "place")
    lists = lists.agg(F.map_from_entries(F.collect_list(F.struct("slot", "list"))).alias("by_slot"))
    wanted = positives.groupBy("block", "place").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "id"))).alias("wanted"))
    merged = F.lit(None)
    suffixes = []
    for j in reversed(range(n_positives)):
        own = F.coalesce(F.try_element_at("by_slot", F.lit(j)), F.array().cast("array<struct<less:bigint,id:bigint>>"))
        merged = own if not suffixes else F.slice(F.concat(own, merged), 1, n_negatives)
        suffixes.insert(0, merged)
    out = wanted.join(lists, ["block", "place"]).select("block", "place", "wanted", F.array(*suffixes).alias("suffixes"))

    def window(p: Column, suffix: Column) -> Column:
        found = F.filter(suffix, lambda n: (-n["less"] * 100 >= p["score"] * low) & (-n["less"] * 100 <= p["score"] * high))
        return F.transform(found, lambda n, i: F.struct(p["id"].alias("positive_id"), (i + 1).alias("rank"), n["id"].alias("negative_id"), p["score"].alias("positive_score"), (-n["less"]).alias("negative_score")))

    each = F.transform("wanted", lambda p: window(p, F.get(F.col("suffixes"), p["rank"] - 1)))
    out = out.select("block", "place", F.inline(F.flatten(each)))
    ids = anchors.select("block", F.posexplode("a_ids").alias("place", "anchor_id"))
    out = ids.join(out, ["block", "place"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
    drop_written(spark, limited)
    return out
