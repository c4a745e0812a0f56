"""Small helpers around ``mapInArrow``: bounded slices of a batch, groups of a sorted partition."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def bounded(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose texts in ``column`` hold about ``max_bytes`` at most (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < batch.num_rows:
            base = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, base + max_bytes, side="right")))
            yield batch.slice(start, end - start)
            start = end


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 50_000, low_bits: int = 0, most: int | None = None) -> Iterator[pa.Table]:
    """Tables of whole groups from a partition that is sorted by ``key``.

    A table holds many groups; a group is only as large as the rows that share its
    key, but for its ``low_bits`` lowest bits.  Without ``most`` a table never holds a
    part of a group; with it, a group of at least so many rows comes in parts, each a
    table of its own but for the last, which is followed by other groups.
    """
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        whole = pa.Table.from_batches(held)
        keys = whole.column(key).to_numpy() >> low_bits
        changes = np.flatnonzero(keys[1:] != keys[:-1])
        if len(changes):
            cut = int(changes[-1]) + 1
            yield whole.slice(0, cut)
            held = whole.slice(cut).to_batches()
            count = whole.num_rows - cut
        elif most is not None and count >= most:
            yield whole
            held, count = [], 0
    if count:
        yield pa.Table.from_batches(held)


def emit(schema: pa.Schema, max_rows: int = 100_000, **columns) -> Iterator[pa.RecordBatch]:
    """Record batches of ``schema`` from arrays of equal length."""
    arrays = [pa.array(columns[f.name], type=f.type) for f in schema]
    table = pa.Table.from_arrays(arrays, schema=schema)
    yield from table.to_batches(max_chunksize=max_rows)


Mapper = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
