"""Small helpers for operators that work on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows of about most_bytes of a string or binary column; a longer row stands alone."""
    if not batch.num_rows:
        return
    values = batch.column(column)
    kind = values.type
    if pa.types.is_string_view(kind) or pa.types.is_binary_view(kind):
        values = values.cast(pa.large_binary())
        kind = values.type
    wide = pa.types.is_large_string(kind) or pa.types.is_large_binary(kind)
    offsets = np.frombuffer(values.buffers()[1], np.int64 if wide else np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + most_bytes, "right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def hash01(hashes: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit hashes as numbers in (0, 1)."""
    return ((hashes >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
