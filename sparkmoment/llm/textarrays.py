"""Texts of an Arrow batch as flat numpy arrays of code points, and back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Code points worked on at once: the temporary arrays stay within a core's cache and a few MB.
BLOCK = 1 << 19


def text_buffers(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the n + 1 byte offsets; null rows are empty."""
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    if a.null_count:
        a = a.fill_null("")
    kind = np.int64 if pa.types.is_large_string(a.type) else np.int32
    _, offsets, data = a.buffers()
    off = np.frombuffer(offsets, kind, len(a) + 1 + a.offset)[a.offset :].astype(np.int64) if len(a) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def code_points(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows in one uint32 array and the n + 1 offsets of the rows in it.

    Null rows are empty. Bytes that are no UTF-8 become U+FFFD.
    """
    raw, off = text_buffers(a)
    try:
        cps = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:
        rows = [raw[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace") for i in range(len(off) - 1)]
        cps = np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32)
        return cps, np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    before = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=before[1:])
    return cps, before[off]


def to_strings(cps: np.ndarray, off: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """Arrow strings from code points and row offsets; rows that aren't ``valid`` are null."""
    data = cps.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)
    at = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(width, out=at[1:])
    mask = None if valid is None or valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    kind, np_kind = (pa.string(), np.int32) if len(data) < 2**31 else (pa.large_string(), np.int64)
    return pa.Array.from_buffers(kind, len(off) - 1, [mask, pa.py_buffer(at[off].astype(np_kind).tobytes()), pa.py_buffer(data)])


def blocks(batch: pa.RecordBatch, text: str, size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Slices of the batch of about ``size`` bytes of text each; one longer text is a slice of its own."""
    if not batch.num_rows:
        return
    _, off = text_buffers(batch.column(batch.schema.get_field_index(text)))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... counts[0]-1, 0, 1, ... counts[1]-1, ..."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)


def mix(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit hash of uint64 values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
