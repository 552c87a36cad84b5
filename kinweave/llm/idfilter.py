"""A membership filter of fixed size for a set of 64-bit numbers of any size.

Partial bitmaps are built where the numbers are and united, a few at a time. A
member always passes; others pass rarely while there are far fewer numbers than
bits, and more and more often beyond that. What follows must drop them, so the
filter saves work and never decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kinweave.llm.kernels import mix64

BITS = 1 << 23
#: Largest filter: 32 MB.
MOST_BITS = 1 << 28
PARTS = 8


def bits_for(members: int) -> int:
    """A power of two of about sixteen bits a member, within the limits."""
    return min(MOST_BITS, max(BITS, 1 << (16 * max(members, 1) - 1).bit_length()))


def _slots(ids: np.ndarray, bits: int) -> np.ndarray:
    h = mix64(ids.astype(np.int64, copy=False).view(np.uint64))
    step = (h >> np.uint64(33)) | np.uint64(1)
    return np.stack([(h + np.uint64(k) * step) & np.uint64(bits - 1) for k in range(3)]).astype(np.int64)


def build(ids: DataFrame, bits: int = BITS) -> bytes:
    """Packed bitmap of the one long column of ``ids``; the driver holds one partial bitmap at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits, bool)
        for b in batches:
            own[_slots(b.column(0).drop_null().to_numpy(), bits)] = True
        yield pa.record_batch({"bits": pa.array([np.packbits(own).tobytes()], pa.binary())})

    total = np.zeros(bits // 8, np.uint8)
    for row in ids.repartition(PARTS).mapInArrow(run, "bits binary").toLocalIterator():
        total |= np.frombuffer(bytes(row["bits"]), np.uint8)
    return total.tobytes()


def member(bitmap: bytes, ids: np.ndarray) -> np.ndarray:
    bits = np.frombuffer(bitmap, np.uint8)
    slots = _slots(ids, len(bits) * 8)
    return ((bits[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1).all(axis=0)


def passes(bitmap: bytes, ids: pa.Array) -> np.ndarray:
    """Which ids may be members; null never is."""
    return member(bitmap, ids.fill_null(0).to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(zero_copy_only=False)
