"""Ordered folds: state that is carried along the rows of a key, in bounded memory."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame


def ordered_fold(rows: DataFrame, key: str, order: list[str], start: Callable, step: Callable, out: str) -> DataFrame:
    """``rows`` with the results of ``step(state, *other columns)``, called for the rows of each key in order; ``step`` gives the next state and a result, ``start()`` the first state.

    Rows are dealt by key and sorted; a worker reads them batch by batch and holds one state, so a key with any number of rows needs no more memory.
    """
    name, kind = out.split()
    columns = rows.columns
    at = columns.index(key)

    def run(batches):
        held, state = None, None
        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is None or held[0] != row[at]:
                    held, state = (row[at],), start()
                state, result = step(state, *row)
                found.append(result)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, {"boolean": pa.bool_(), "string": pa.string()}[kind])], names=[*columns, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, f"{fields}, {out}")
