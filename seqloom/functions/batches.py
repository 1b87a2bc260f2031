"""Arrow batches of bounded rows and bytes, whatever the session's settings are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa

Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

#: Bytes of a piece that a kernel sees; a single row of more is a piece of its own.
BYTES = 8 << 20


def pieces(batch: pa.RecordBatch, rows: int, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in order, cut into pieces of at most ``rows`` rows and about ``size`` bytes; an empty batch as it is."""
    if batch.num_rows <= 1 or batch.num_rows <= rows and batch.nbytes <= size:
        yield batch
        return
    half = -(-batch.num_rows // (2 * rows)) * rows if batch.num_rows > rows else batch.num_rows // 2
    yield from pieces(batch.slice(0, half), rows, size)
    yield from pieces(batch.slice(half), rows, size)


def bounded(kernel: Kernel, rows: int, size: int = BYTES) -> Kernel:
    """The kernel over pieces of its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return kernel(piece for batch in batches for piece in pieces(batch, rows, size))

    return run
