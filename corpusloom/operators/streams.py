"""Sorted rows in tasks as tables of whole groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def starts(columns: list[pa.Array]) -> np.ndarray:
    """Where the key in ``columns`` of equal length, none empty, becomes another."""
    new = np.zeros(len(columns[0]) - 1, bool)
    for c in columns:
        values = c.to_numpy(zero_copy_only=False)
        new |= values[1:] != values[:-1]
    return np.append(0, np.flatnonzero(new) + 1)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables, and where their groups start, of batches sorted by their first ``keys`` columns. No group goes on in the next table.

    A task holds a batch and the group that goes on behind it.
    """
    held: list[pa.RecordBatch] = []

    def made(parts: list[pa.RecordBatch]) -> tuple[pa.Table, list[int]]:
        table = pa.Table.from_batches(parts).combine_chunks()
        return table, starts([table.column(k).combine_chunks() for k in range(keys)]).tolist()

    for batch in batches:
        if not batch.num_rows:
            continue
        last = int(starts([batch.column(k) for k in range(keys)])[-1])
        goes_on = held and all(held[0].column(k)[0] == batch.column(k)[0] for k in range(keys))
        if last or (held and not goes_on):
            done = [*held, batch.slice(0, last)]
            if any(b.num_rows for b in done):
                yield made(done)
            held = []
        held.append(batch.slice(last))
    if held:
        yield made(held)
