"""Arrow batches in small pieces, so that what a task holds as Python objects does not grow with its rows."""

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Rows of a piece, and about so many bytes of contents in a batch that is made.
ROWS, BYTES = 200, 4 << 20


def pieces(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)


def gathered(rows: Iterable[tuple[dict, int]], schema: pa.Schema, most_bytes: int = BYTES, most_rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """rows: each with its bytes. Batches that are closed at either bound."""
    held, size = [], 0
    for row, n in rows:
        held.append(row)
        size += n
        if size >= most_bytes or len(held) >= most_rows:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)
