"""Arrow batches cut by the bytes of their texts, so that what Python makes of one piece has a bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text at which a piece ends.
PIECE_BYTES = 2_000_000


def give_back() -> None:
    """Returns memory that is free in this process to the system.

    A Python worker outlives its task, and allocators keep what is freed; so idle workers would hold what their largest task took.
    """
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()  # the C library's


def pieces(batches: Iterator[pa.RecordBatch], column: int, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of all batches, in order, in pieces whose texts hold `size` bytes and one text more at most; no piece is empty."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        block = (np.cumsum(lengths) - lengths) // size  # where in the batch's text a row starts
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if batch.num_rows else []
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(int(a), int(b - a))
    batch = None
    give_back()


def slices(texts: list[str], chars: int) -> Iterator[slice]:
    """Cuts a list where its texts exceed `chars` characters together."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= chars:
            yield slice(at, i + 1)
            at, held = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))
