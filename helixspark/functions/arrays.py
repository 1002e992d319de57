"""Arrow columns of strings as one numpy array of bytes with offsets, so that a batch is handled at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows one after another, and where each row begins (and the last ends); null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def rows_of(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType, valid: np.ndarray | None = None) -> pa.Array:
    """The reverse of joined(), as strings or binaries; rows that are not ``valid`` are null."""
    wide = pa.large_binary() if pa.types.is_binary(kind) else pa.large_string()
    mask = None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    out = pa.Array.from_buffers(wide, len(offsets) - 1, [mask, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])
    return out.cast(kind)


def pieces(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """data[start[i] : start[i] + length[i]] one after another, and their offsets."""
    offsets = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
    return data[np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])], offsets


def parts(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts with about ``size`` bytes of a string column, a row each at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    edges = [0, *(np.flatnonzero(np.diff(np.cumsum(lengths, dtype=np.int64) // size)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)
