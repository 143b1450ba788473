"""Arrow text as flat numpy arrays of code points, and back.

Every function works on a whole Arrow batch at once: one flat ``uint32``
array of code points, and ``int64`` offsets that say where each text starts.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Characters of text handled at once in a worker; bounds its memory.
SLICE_BYTES = 1 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds at most ``most`` bytes, one text at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        array = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(np.nan_to_num(pc.binary_length(array).to_numpy(zero_copy_only=False).astype("f8")))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def decode(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points and offsets of a string array; a null counts as empty."""
    if array.null_count:
        array = array.fill_null("")
    array = array.cast(pa.large_string())
    if not len(array):
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, array.offset * 8)
    data = array.buffers()[2]
    raw = memoryview(data)[int(offsets[0]) : int(offsets[-1])] if data is not None else b""
    flat = np.frombuffer(str(raw, "utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    octets = np.frombuffer(raw, np.uint8)
    starts = np.concatenate([[0], np.cumsum((octets & 0xC0) != 0x80)])
    return flat, starts[offsets - offsets[0]].astype(np.int64)


def encode(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The inverse of :func:`decode`."""
    text = flat.astype("<u4").tobytes().decode("utf-32-le", "replace").encode("utf-8")
    width = 1 + (flat > 0x7F).astype(np.int64) + (flat > 0x7FF) + (flat > 0xFFFF)
    ends = np.concatenate([[0], np.cumsum(width)])[offsets]
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(text)).cast(pa.string())


def owners(offsets: np.ndarray) -> np.ndarray:
    """For each code point, the row it belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BASE = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, base, U64)
    down = np.full(n, pow(base, -1, 1 << 64), U64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


@lru_cache(maxsize=2)
def _mixed(which: int) -> np.ndarray:
    """The scrambled value of every code point."""
    return mix(np.arange(0x110001, dtype=U64) + U64(0x1234567 + which))


def segment_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit polynomial hash of each segment ``values[start:end]``, equal for equal content anywhere."""
    n = 1 << max(16, int(len(values) + 1).bit_length())
    up, down = _powers(_BASE[which], n)
    sums = np.zeros(len(values) + 1, U64)
    if values.dtype == np.uint32 and len(values) and values.max() <= 0x110000:
        mixed = _mixed(which)[values]
    else:
        mixed = mix(values.astype(U64) + U64(0x1234567 + which))
    mixed *= up[: len(values)]
    np.cumsum(mixed, out=sums[1:])
    whole = (sums[ends] - sums[starts]) * down[starts]
    return mix(whole + mix((ends - starts).astype(U64)))


@lru_cache(maxsize=1)
def alnum_table() -> tuple[np.ndarray, np.ndarray]:
    """Which code points are letters or digits, and the lower case of each."""
    keep = np.zeros(0x110000, bool)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if unicodedata.category(s)[0] in "LN":
            keep[c] = True
            low = s.lower()
            if len(low) == 1:
                lower[c] = ord(low)
    return keep, lower


def words(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and owners of the maximal runs of letters and digits."""
    keep = alnum_table()[0][flat]
    if not len(flat):
        z = np.zeros(0, np.int64)
        return z, z, z
    first = np.zeros(len(flat) + 1, bool)
    first[offsets] = True
    before = np.concatenate([[False], keep[:-1]])
    after = np.concatenate([keep[1:], [False]])
    starts = np.flatnonzero(keep & (~before | first[:-1]))
    ends = np.flatnonzero(keep & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def shingles(array: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words, the row of each, and the words in each row."""
    flat, offsets = decode(array)
    starts, ends, row = words(flat, offsets)
    count = np.bincount(row, minlength=len(array))
    h = segment_hash(alnum_table()[1][flat], starts, ends)
    if len(h) < n:
        return np.zeros(0, U64), np.zeros(0, np.int64), count
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = mix(out * U64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    same = row[: len(out)] == row[n - 1 :]
    return out[same], row[: len(out)][same], count
