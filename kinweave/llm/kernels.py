"""Vectorised byte kernels shared by the text operators.

Everything here works on one *chunk*: the UTF-8 bytes of some whole texts laid
end to end in a ``uint8`` array, plus the ``n + 1`` offsets of the texts in it.
A chunk holds about ``CHUNK_BYTES`` of text (one longer text is a chunk of its
own), so memory follows the chunk size and not the Arrow batch.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

#: Bytes that separate words: space and 0x09-0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def tidy() -> None:
    """Gives memory that a finished task has freed back to the system: workers live on beside the next stage's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random odd multiplier for each byte value, and the base of the rolling sum.
BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
BASE = 0xD1342543DE82EF95
BASE_INV = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** [0..n)`` modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        p = np.full(1 << max(n, 2).bit_length() if n < 1024 else n + n // 8, base, dtype=np.uint64)
        p[0] = 1
        have = _powers[base] = np.multiply.accumulate(p)
    return have[:n]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without a copy; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(column: pa.Array, chunk_bytes: int = CHUNK_BYTES):
    """Yield (first row, last row, bytes, offsets) of runs of whole texts."""
    data, off = column_bytes(column)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + chunk_bytes, side="right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Rolling sums: entry i covers ``data[:i]``."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODE[data] * powers(BASE, len(data)), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each ``data[start:end]``, whatever its place."""
    return mix64((sums[end] - sums[start]) * powers(BASE_INV, len(sums))[start] + (end - start).astype(np.uint64))


def gram_hashes(sums: np.ndarray, width: int) -> np.ndarray:
    """span_hashes of every ``data[i : i + width]``, read in order instead of gathered."""
    n = max(0, len(sums) - width)
    x = sums[width:] - sums[:n]
    x *= powers(BASE_INV, len(sums))[:n]
    x += np.uint64(width)
    return mix64(x)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a chunk, and how many words lie before each text."""
    n = len(data)
    if n == 0:
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(off), np.int64)
    solid = ~SPACE[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[off] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | cut[1:n]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | cut[1:n]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, off)
