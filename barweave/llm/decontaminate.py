"""Benchmark passages in documents, found by counting q-grams in diagonal bands.

Texts are compared in lower case with white space runs as one space. An item of m characters that occurs
with at most k edits shares at least ``m + 1 - q * (k + 1)`` q-grams with the place where it occurs (the
q-gram lemma), and their diagonals (place in the document minus place in the item) lie within k of each
other. So shared q-grams are counted in bands 2k wide that start every k diagonals; a band that reaches
the bound is aligned, within the band only, and reported if the alignment stays within k edits.

The documents are never shuffled: each task holds the q-gram index of one block of the benchmark, whose
size is bounded by ``block_chars``. A larger benchmark is dealt with block by block, each over all rows.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codepoints import BREAK, batches_of, codes, tables
from .common import filtered, held, kind_of, per_text, whole_text

#: q-gram length; edits allowed for each character of an item; characters of a block of the benchmark.
Q, RATE, BLOCK_CHARS = 8, 0.1, 4_000_000
#: Characters of documents, and pairs of q-grams, that are looked at together.
AT_ONCE, PAIRS = 1_000_000, 2_000_000
#: Bits of the tables of q-grams and of the coarse count.
SLOTS, COARSE = 22, 20


def normalised(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points in lower case with runs of white space as one space, and the place of each in ``raw``."""
    low, space, _ = tables()
    basic = raw < (1 << 16)
    small = np.where(basic, raw, 0)
    out = np.where(basic, low[small], raw)
    gap = space[small] & basic
    out[gap] = 32
    keep = np.ones(len(raw), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    at = np.flatnonzero(keep)
    return out[at], at


def plain(text: str) -> np.ndarray:
    """An item as it is compared: normalised, without white space at its ends."""
    out, _ = normalised(codes(text))
    lo, hi = (int(out[:1].tolist() == [32]), len(out) - int(out[-1:].tolist() == [32]))
    return out[lo : max(lo, hi)]


def gram_slots(text: np.ndarray, q: int) -> np.ndarray:
    """Slot of the q-gram that starts at each place; a rolling polynomial by doubling."""
    if len(text) < q:
        return np.zeros(0, np.int64)
    base = 0x9E3779B97F4A7C15
    part, have, power = text.astype(np.uint64), 1, base
    total, done = None, 0
    left = q
    while left:
        if left & 1:
            if total is None:
                total, done = part, have
            else:
                n = len(text) - done - have + 1
                total = total[:n] * np.uint64(pow(base, have, 1 << 64)) + part[done : done + n]
                done += have
        left >>= 1
        if left:
            n = len(part) - have
            part = part[:n] * np.uint64(power) + part[have : have + n]
            have *= 2
            power = pow(base, have, 1 << 64)
    total = total ^ (total >> np.uint64(29))
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return (total >> np.uint64(64 - SLOTS)).astype(np.int64)


def _coarse(key: np.ndarray) -> np.ndarray:
    return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - COARSE)).astype(np.int64)


def budget(m: int, q: int = Q, rate: float = RATE) -> int:
    """Edits allowed for m characters: the rate, but few enough that the lemma asks for a shared q-gram; -1: too short."""
    return min(int(rate * m), (m - q) // q) if m >= q else -1


class Index:
    """q-grams of one block of the benchmark, by slot."""

    def __init__(self, items: list[str], q: int, rate: float):
        self.q = q
        self.items = [plain(t) for t in items]
        sizes = np.array([len(t) for t in self.items], np.int64)
        self.edits = np.array([budget(int(m), q, rate) for m in sizes], np.int64)
        self.bound = sizes + 1 - q * (self.edits + 1)
        self.step = np.maximum(self.edits, 1)
        slots = [gram_slots(t, q) for t in self.items]
        flat = np.concatenate([np.zeros(0, np.int64), *slots])
        order = np.argsort(flat, kind="stable")
        self.item = np.repeat(np.arange(len(slots)), [len(s) for s in slots])[order]
        self.at = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(s)) for s in slots)])[order]
        self.many = np.bincount(flat, minlength=1 << SLOTS).astype(np.int32)
        self.first = np.concatenate([[0], np.cumsum(self.many)])[:-1].astype(np.int64)
        self.longest = int(sizes.max(initial=0))

    def bands(self, text: np.ndarray, edges: np.ndarray) -> pd.DataFrame:
        """``doc, item, lo, near``: bands that reach the bound; lo is their first diagonal, near the commonest.

        ``edges`` holds the first place of every document in ``text``, and its end.
        """
        slots = gram_slots(text, self.q)
        places = np.flatnonzero(self.many[slots])
        n = self.many[slots[places]].astype(np.int64)
        total = np.cumsum(n)
        spare = self.longest + 1
        span = len(text) + 2 * spare + 2
        cuts = [0]
        while cuts[-1] < len(places):
            reach = (total[cuts[-1] - 1] if cuts[-1] else 0) + PAIRS
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(total, reach, "right"))))

        def pairs(start: int, stop: int) -> tuple[np.ndarray, ...]:
            many = n[start:stop]
            which = np.repeat(self.first[slots[places[start:stop]]] - np.cumsum(many) + many, many) + np.arange(many.sum())
            item = self.item[which]
            at = self.at[which]
            diagonal = np.repeat(places[start:stop], many) - at + spare
            return item, diagonal, item * span + diagonal // self.step[item], at

        # A coarse count of all pairs first: most bands are far from the bound.
        seen = np.zeros(1 << COARSE, np.int64)
        parts = [(start, stop) for start, stop in zip(cuts, cuts[1:], strict=False)]
        held = [pairs(*p) for p in parts] if len(parts) == 1 else [None] * len(parts)
        for part, made in zip(parts, held, strict=True):
            seen += np.bincount(_coarse((made or pairs(*part))[2]), minlength=1 << COARSE)
        found = []
        for part, made in zip(parts, held, strict=True):
            item, diagonal, key, at = made or pairs(*part)
            most = seen[_coarse(key)]
            most = most + np.maximum(seen[_coarse(key - 1)], seen[_coarse(key + 1)])
            keep = most >= self.bound[item]
            found.append((item[keep], diagonal[keep], key[keep], at[keep]))
        if not sum(len(f[0]) for f in found):
            return pd.DataFrame({"doc": [], "item": [], "lo": [], "near": []})
        item, diagonal, key, at = (np.concatenate([f[i] for f in found]) for i in range(4))
        # Every q-gram counts for the band that starts at its own step, and for the one that starts a step before.
        # The lemma is about places in the item, so a place that a repetitive text hits again counts once.
        hits = pd.DataFrame({"key": np.concatenate([key, key - 1]), "item": np.tile(item, 2), "diagonal": np.tile(diagonal, 2), "at": np.tile(at, 2)})
        once = hits[["key", "at"]].drop_duplicates().groupby("key").size()
        n_hits = once.reindex(hits["key"]).to_numpy()
        hits = hits[n_hits >= self.bound[hits["item"].to_numpy()]]
        if hits.empty:
            return pd.DataFrame({"doc": [], "item": [], "lo": [], "near": []})
        commonest = hits.groupby(["key", "item", "diagonal"]).size().rename("n").reset_index().sort_values(["key", "n", "diagonal"], ascending=[True, False, True]).drop_duplicates("key")
        which = commonest["item"].to_numpy()
        lo = (commonest["key"].to_numpy() - which * span) * self.step[which] - spare
        near = commonest["diagonal"].to_numpy() - spare
        # A band may reach over the border of two documents: it is looked at in both.
        size = np.array([len(t) for t in self.items], np.int64)[which]
        first = np.clip(np.searchsorted(edges, lo, "right") - 1, 0, len(edges) - 2)
        last = np.clip(np.searchsorted(edges, lo + 2 * self.step[which] + size, "right") - 1, 0, len(edges) - 2)
        out = pd.DataFrame({"doc": first, "last": last, "item": which, "lo": lo, "near": near})
        out = out.loc[np.repeat(np.arange(len(out)), last - first + 1)]
        out["doc"] += out.groupby(level=0).cumcount()
        return out.drop(columns="last").reset_index(drop=True)


def align(text: np.ndarray, item: np.ndarray, lo: int, hi: int, most: int, anchored: bool = False) -> tuple[int, int]:
    """Least edits that turn ``item`` into a piece of ``text``, and the end of that piece, within diagonals lo..hi.

    The piece may start anywhere on those diagonals; if ``anchored``, it starts at place 0. Ties: the first end.
    As soon as ``most`` edits cannot be enough, the answer is more than that.
    """
    width = hi - lo + 1
    across = np.arange(width)
    far = len(item) + width + 1
    row = across + lo if anchored else np.zeros(width, np.int64)
    start = across + lo
    row = np.where((start >= 0) & (start <= len(text)), np.abs(row), far)
    padded = np.concatenate([np.full(max(0, -lo), BREAK, np.int64), text[max(0, lo) :], np.full(max(0, len(item) + hi - len(text)) + 1, BREAK, np.int64)])
    for i, letter in enumerate(item.tolist()):
        new = row + (padded[i : i + width] != letter)
        np.minimum(new[:-1], row[1:] + 1, out=new[:-1])
        row = np.minimum.accumulate(new - across) + across
        end = across + lo + i + 1
        row = np.where((end >= 0) & (end <= len(text)), row, far)
        if i & 3 == 3 and row.min() > most:
            return most + 1, 0
    best = int(row.argmin())
    return int(row[best]), best + lo + len(item)


def matches(texts: list[str], index: Index) -> pd.DataFrame:
    """``row, item, edits, start, end``: each item in each text, at its best place (least edits, then first)."""
    out = []
    for start, stop in batches_of(texts, AT_ONCE):
        out += _matches(texts[start:stop], start, index)
    found = pd.DataFrame(out, columns=["row", "item", "edits", "start", "end"])
    return found.sort_values(["row", "item", "edits", "start"]).drop_duplicates(["row", "item"])


def _matches(texts: list[str], offset: int, index: Index) -> list[tuple]:
    joined = chr(BREAK).join([*texts, ""])
    text, at = normalised(codes(joined))
    edges = np.concatenate([[0], np.flatnonzero(text == BREAK) + 1])
    raw_edges = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    if len(edges) != len(raw_edges):  # a text that holds the separator itself: one by one, without it
        if len(texts) == 1:
            return _matches([texts[0].replace(chr(BREAK), chr(0xFFFD))], offset, index)
        return [m for i, t in enumerate(texts) for m in _matches([t], offset + i, index)]
    out, exact = [], set()
    for doc, k, lo, near in index.bands(text, edges).itertuples(index=False):
        doc, k, lo, near = int(doc), int(k), int(lo), int(near)
        item, edits = index.items[k], int(index.edits[k])
        if (doc, k) in exact:
            continue
        begin, end = int(edges[doc]), int(edges[doc + 1]) - 1
        if begin <= near and near + len(item) <= end and np.array_equal(text[near : near + len(item)], item):
            exact.add((doc, k))
            got, first, last = 0, near, near + len(item)
        else:
            left = max(begin, lo - edits)
            right = min(end, lo + 2 * int(index.step[k]) + len(item) + edits)
            if right - left < len(item) - edits:
                continue
            piece = text[left:right].astype(np.int64)
            got, stop = align(piece, item, lo - edits - left, lo + 2 * int(index.step[k]) + edits - left, edits)
            if got > edits:
                continue
            size = align(piece[:stop][::-1], item[::-1], -got, got, got, anchored=True)[1]
            first, last = left + max(0, stop - size), left + stop
        out.append((offset + doc, k, got, int(at[first] - raw_edges[doc]), int(at[last - 1] + 1 - raw_edges[doc])))
    return out


def _blocks(benchmark: DataFrame, block_chars: int):
    """The benchmark in blocks of at most ``block_chars`` characters (or one item): lists of texts and of their ids.

    Items with equal text are looked for once. The blocks pass through the driver one at a time.
    """
    rows = benchmark.select("item_id", whole_text().alias("text")).groupBy("text").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
    texts, ids, n = [], [], 0
    for row in rows.orderBy("text").toLocalIterator():
        if texts and n + len(row.text) > block_chars:
            yield texts, ids
            texts, ids, n = [], [], 0
        texts.append(row.text)
        ids.append(list(row.ids))
        n += len(row.text)
    if texts:
        yield texts, ids


def _find(batch: list[str], sent, key: str, q: int, rate: float) -> pd.DataFrame:
    return matches(batch, held(("benchmark", key, q, rate), lambda: Index(sent.value, q, rate)))


def _finder(spark, texts: list[str], q: int, rate: float):
    sent = spark.sparkContext.broadcast(texts)
    key = f"{spark.sparkContext.applicationId}-{sent._jbroadcast.id()}"
    return partial(_find, sent=sent, key=key, q=q, rate=rate)


def contamination(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id, edits, start, end``: one row for each row of ``docs`` and item that occurs in it.

    The place is the best one (least edits, then the first), in code points of the text, end exclusive.
    Null and empty texts match nothing; very long ones are searched whole; other columns are not looked at. Items of fewer than ``q`` characters after normalisation are too
    short to tell anything and match nothing; null item ids are left out. Items with equal texts each get
    a row, and so do repeated rows of ``docs``. An empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    item_kind = kind_of(benchmark, "item_id")
    found = "item bigint, edits int, start bigint, `end` bigint"
    out = None
    for texts, ids in _blocks(benchmark, block_chars):
        find = _finder(spark, texts, q, rate)

        def make(batch, find=find):
            import pyarrow as pa

            places = [[] for _ in batch]
            for m in find(batch).itertuples(index=False):
                places[m.row].append({"item": m.item, "edits": m.edits, "start": m.start, "end": m.end})
            kind = pa.list_(pa.struct([("item", pa.int64()), ("edits", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
            return [pa.array(places, kind)]

        names = spark.createDataFrame([(i, x) for i, group in enumerate(ids) for x in group], f"item bigint, item_id {item_kind}")
        part = per_text(docs, make, "found array<struct<item:bigint,edits:int,start:bigint,end:bigint>>")
        part = part.select("doc_id", F.inline("found")).join(F.broadcast(names), "item")  # at most block_chars names
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], f"doc_id {kind_of(docs, 'doc_id')}, {found}, item_id {item_kind}")
    return out.select("doc_id", "item_id", "edits", "start", "end")


def clean(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` in which no item occurs, with all their columns, whatever their names.

    Null and empty texts hold nothing and stay; very long texts are searched whole; repeated rows are judged
    each by itself. Without items all rows stay; an empty table stays empty.
    """
    out = docs
    for texts, _ in _blocks(benchmark, block_chars):

        def keep(batch, find=_finder(docs.sparkSession, texts, q, rate)):
            found = set(find(batch)["row"].tolist())
            return [i not in found for i in range(len(batch))]

        out = filtered(out, keep)
    return out
