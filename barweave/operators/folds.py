"""Folds along time: rows of one key after another, with a state that is carried from row to row.

For what cannot be said in windows, because a step depends on the outcome of the one before. Rows are
shuffled once by key and sorted within their partitions; a task reads its rows in Arrow batches and holds
one key's state, never one key's rows. A key is one order of events, so its rows are read by one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Protocol

from pyspark.sql import DataFrame


class State(Protocol):
    """The state of one key."""

    def row(self, *values) -> Iterable[tuple]:
        """The rows that this row of the key gives; ``values`` are the columns named to :func:`folded`."""

    def end(self) -> Iterable[tuple]:
        """The rows that the end of the key gives."""


def folded(rows: DataFrame, key: str, order: list[str], columns: list[str], start: Callable[[object], State], schema: str) -> DataFrame:
    """The rows that ``start(key)``'s state gives for each key, in the order of ``order``.

    A null key is a key of its own. An empty table gives an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    made = to_arrow_schema(StructType.fromDDL(schema))
    names = [key, *columns]

    def run(batches):
        import pyarrow as pa

        state, now, begun = None, None, False

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(made)], schema=made)

        for batch in batches:
            out = []
            for value, *rest in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if not begun or value != now:
                    if begun:
                        out.extend(state.end())
                    state, now, begun = start(value), value, True
                out.extend(state.row(*rest))
            yield batch_of(out)
        if begun:
            yield batch_of(list(state.end()))

    slim = rows.select(*dict.fromkeys([key, *order, *columns]))
    return slim.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
