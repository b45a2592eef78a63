"""Folds over ordered sequences: what a row gives depends on all rows before it.

Rows are exchanged by their key, where they are not yet, and sorted within their partition. A worker reads them in Arrow
batches and carries from batch to batch the state of the sequence that is open, so its memory follows neither the length of a
sequence nor their number, and the results of all sequences of a batch leave as one batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


class Fold(Protocol):
    """The state of one sequence. Both give the columns of the rows that are finished (equally long), or nothing."""

    def feed(self, order: np.ndarray, values: list[np.ndarray]) -> list | None: ...

    def end(self) -> list | None: ...


def folded(rows: DataFrame, key: str, order: str, values: list[str], start: Callable[[], Fold], schema: str) -> DataFrame:
    """key and the columns of schema that the folds give, one fold for each key over its rows by `order`.

    start makes the fold of a key. Rows of a null key are a sequence like others; no rows give no rows."""
    kind = dict(rows.dtypes)[key]
    full = f"{key} {kind}, {schema}"
    fields = to_arrow_schema(StructType.fromDDL(full))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current, last = None, None, len(values) + 2
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0)
            place = names.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            at, each = batch.column(1).to_numpy(zero_copy_only=False), [batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, last)]
            edges = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(place)]
            out = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                name = names[a]
                if state is None or not name.equals(current):
                    out.append((current, state.end() if state else None))
                    state, current = start(), name
                out.append((current, state.feed(at[a:b], [v[a:b] for v in each])))
            yield from _rows(out, fields)
        if state:
            yield from _rows([(current, state.end())], fields)

    # the window asks for the distribution and the order, and so costs an exchange only where rows are not dealt by key yet
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.select(key, order, *values, place.alias("_place")).mapInArrow(run, full)


def _rows(found: list, fields: pa.Schema) -> Iterator[pa.RecordBatch]:
    found = [(name, columns) for name, columns in found if columns is not None and len(columns[0])]
    if found:
        names = pa.array([name.as_py() for name, _ in found], fields.field(0).type).take(pa.array(np.repeat(np.arange(len(found)), [len(c[0]) for _, c in found])))
        parts = [[c[i] for _, c in found] for i in range(len(fields) - 1)]
        columns = [np.concatenate(p) if isinstance(p[0], np.ndarray) else [v for x in p for v in x] for p in parts]
        yield pa.record_batch([names, *(pa.array(c, f.type) for c, f in zip(columns, list(fields)[1:], strict=True))], schema=fields)
