"""Groups of rows in sorted Arrow streams, without one call per group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches, key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by the integer column ``key``: tables of whole groups, and the groups' bounds.
    A group that a batch cuts waits for its end."""
    held: list[pa.RecordBatch] = []
    for batch in _with_end(batches):
        if batch is not None:
            held.append(batch)
        if not held:
            continue
        table = pa.Table.from_batches(held)
        if not table.num_rows:
            continue
        keys = table.column(key).to_numpy()
        cut = len(keys) if batch is None else int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield table.slice(0, cut), np.concatenate(([0], np.flatnonzero(np.diff(keys[:cut])) + 1, [cut]))
            held = table.slice(cut).to_batches()


def _with_end(batches):
    yield from batches
    yield None
