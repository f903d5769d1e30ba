"""Places of pattern matches in a text, with built-in functions only.

Spark gives the matches of a pattern and the pieces between them, but no places; those follow from the
lengths of both. All places are in code points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements whose sum is kept, so that running totals of n values take n ** 1.5 steps at most.
BLOCK = 64
#: Characters before and after a match that are kept as its context.
CONTEXT = 256
#: Code points of the pieces that a text is cut into before spans are taken out of it.
PIECE = 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _places(lengths: Column, make: Callable[[Column, Column], Column]) -> Column:
    """``make(i, sum of the first i lengths)`` for every i; ``lengths`` must not be empty."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / F.lit(BLOCK)).cast("int")),
        lambda b: _total(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))),
    )

    def one(i: Column, sums: Column) -> Column:
        block = F.floor(i / F.lit(BLOCK)).cast("int")
        return make(i, _total(F.slice(sums, F.lit(1), block)) + _total(F.slice(lengths, block * BLOCK + 1, i - block * BLOCK)))

    return let(blocks, lambda sums: F.transform(F.sequence(F.lit(0), F.size(lengths) - 1), lambda i: one(i, sums)))


def matches(text: Column, pattern: str, likely: Column, around: bool = False) -> Column:
    """``array<struct<start, end, found>>`` of the matches of ``pattern``, leftmost first.

    With ``around`` also ``before`` and ``after``: the last and first ``CONTEXT`` characters of what stands
    between this match and its neighbours. ``likely`` is a cheap test that every text with a match passes.
    """
    kind = "array<struct<start:int,end:int,found:string" + (",before:string,after:string>>" if around else ">>")
    none = F.array().cast(kind)

    def located(s: Column) -> Column:
        lengths = F.zip_with(F.slice(s["pieces"], F.lit(1), F.size(s["found"])), s["found"], lambda p, f: F.length(p) + F.length(f))

        def span(i: Column, before: Column) -> Column:
            piece, found = s["pieces"][i], s["found"][i]
            start = before + F.length(piece)
            more = [F.right(piece, F.lit(CONTEXT)).alias("before"), F.left(s["pieces"][i + 1], F.lit(CONTEXT)).alias("after")] if around else []
            return F.struct(start.alias("start"), (start + F.length(found)).alias("end"), found.alias("found"), *more)

        return F.when(F.size(s["found"]) > 0, let(lengths, lambda n: _places(n, span))).otherwise(none)

    both = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return F.when(likely, let(both, located)).otherwise(none)


def of_kind(spans: Column, kind: str, order: int, valid: Callable[[Column], Column] | None = None, around: bool = False) -> Column:
    """``array<struct<start, kind_no, kind, end, found>>`` (and ``before, after``): spans of one kind whose text is valid."""
    if valid is not None:
        spans = F.filter(spans, lambda s: valid(s["found"]))
    more = ("before", "after") if around else ()
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("kind_no"), F.lit(kind).alias("kind"), *(s[c].alias(c) for c in ("end", "found", *more))))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def clear_of(spans: Column, others: Column, same: bool = False) -> Column:
    """Those of ``spans`` that overlap none of the sorted ``others``; with ``same``, that lie where none of them does.

    Blocks of others are looked at by their first start and last end, so that most are passed over at once.
    """
    starts = F.sequence(F.lit(0), F.floor((F.size(others) - 1) / F.lit(BLOCK)).cast("int"))

    def block(b: Column) -> Column:
        part = F.slice(others, b * BLOCK + 1, F.lit(BLOCK))
        return F.struct(part[0]["start"].alias("start"), F.array_max(F.transform(part, lambda o: o["end"])).alias("end"), part.alias("part"))

    def meets(a: Column, b: Column) -> Column:
        return (a["start"] < b["end"]) & (b["start"] < a["end"])

    def bars(o: Column, s: Column) -> Column:
        return (o["start"] == s["start"]) & (o["end"] == s["end"]) if same else meets(o, s)

    def clear(blocks: Column) -> Column:
        return F.filter(spans, lambda s: ~F.exists(blocks, lambda b: meets(b, s) & F.exists(b["part"], lambda o: bars(o, s))))

    return F.when((F.size(others) > 0) & (F.size(spans) > 0), let(F.transform(starts, block), clear)).otherwise(spans)


def _cut(pieces: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` of a text that lies in pieces of ``PIECE``; its end may be beyond the last one."""
    first, last = F.floor(start / F.lit(PIECE)).cast("int"), F.floor(end / F.lit(PIECE)).cast("int")
    one = F.substring(F.get(pieces, first), start % PIECE + 1, end - start)
    head = F.substring(F.get(pieces, first), start % PIECE + 1, F.lit(PIECE))
    middle = F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    tail = F.coalesce(F.substring(F.get(pieces, last), F.lit(1), end % PIECE), F.lit(""))
    return F.coalesce(F.when(first == last, one).otherwise(F.concat(head, middle, tail)), F.lit(""))


def masked(text: Column, spans: Column, mask: Callable[[Column], Column]) -> Column:
    """``text`` with every sorted span replaced by ``mask(kind)``; spans that overlap are replaced as one."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def replaced(pieces: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            fresh = s["start"] >= acc["at"]
            part = F.when(fresh, F.concat(_cut(pieces, acc["at"], s["start"]), mask(s["kind"]))).otherwise("")
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.array(part)).alias("out"))

        def whole(acc: Column) -> Column:
            return F.concat(F.array_join(acc["out"], ""), _cut(pieces, acc["at"], F.size(pieces) * PIECE))

        return F.aggregate(spans, start, step, whole)

    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, let(cut, replaced)).otherwise(text)
