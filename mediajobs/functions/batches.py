"""Arrow batches in pieces: a batch holds up to 10,000 rows of any size, what Python makes of them at a time doesn't."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Rows of a piece at most, and its bytes about.
PIECE_ROWS, PIECE_BYTES = 256, 4 << 20


def pieces(batch):
    """Slices (without copies) of an Arrow batch or array, in order."""
    n = max(1, min(PIECE_ROWS, PIECE_BYTES * len(batch) // max(1, batch.nbytes)))
    for at in range(0, len(batch), n):
        yield batch.slice(at, n)


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows as tuples; only one row's values are Python objects."""
    for b in batches:
        for i in range(b.num_rows):
            yield tuple(c[i].as_py() for c in b.columns)


def batched(rows: Iterable[tuple], schema: pa.Schema, size_of) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about PIECE_BYTES by ``size_of`` a row, of PIECE_ROWS rows at most."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += size_of(row)
        if size > PIECE_BYTES or len(held) == PIECE_ROWS:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
