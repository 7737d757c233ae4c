"""Groups of neighbouring equal keys in the sorted batches of one task."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def runs_of(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of rows that agree in the first ``keys`` columns (whole numbers, sorted together)."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        columns = [np.asarray(table.column(i).combine_chunks()) for i in range(keys)]
        change = np.zeros(table.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = np.concatenate([[0], np.flatnonzero(change) + 1])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield table.slice(a, b - a)
        held = table.slice(int(cuts[-1]))
    if held is not None and held.num_rows:
        yield held


def single_column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return column.chunk(0) if column.num_chunks == 1 else column.combine_chunks()
