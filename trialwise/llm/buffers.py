"""Arrow UTF-8 buffers as numpy arrays: all texts of a batch at once, without a Python string each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once, and bytes copied at once: bounds what is in memory, not what is done.
CHUNK, WINDOW = 4_000_000, 1 << 20


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column without nulls, one text after another, and where texts start and end (one more number than texts)."""
    column = column.cast(pa.large_string())
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1] if ends else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.empty(0, np.uint8)
    return data, ends - ends[0]


def strings(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """What utf8() gives, as a string column."""
    if len(data) >= 1 << 31:
        raise ValueError("a slice of texts is beyond 2 GB")
    return pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends, np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def slices(batch: pa.RecordBatch, text: str):
    """The batch in slices of about CHUNK bytes of text; a longer text is a slice of its own."""
    sizes = utf8(batch.column(text))[1][1:]
    start = done = 0
    while start < len(sizes):
        end = max(start + 1, int(np.searchsorted(sizes, done + CHUNK, "right")))
        yield batch.slice(start, end - start)
        start, done = end, int(sizes[end - 1])


def gather(source: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Stretches of source, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    out = np.empty(total, source.dtype)
    for a in range(0, total, WINDOW):
        b = min(a + WINDOW, total)
        i, j = np.searchsorted(ends, a, "right"), np.searchsorted(ends, b, "left") + 1
        begin = ends[i:j] - lengths[i:j]
        low, high = np.maximum(begin, a), np.minimum(ends[i:j], b)
        out[a:b] = source[np.repeat(starts[i:j] - begin + a, high - low) + np.arange(b - a)]
    return out
