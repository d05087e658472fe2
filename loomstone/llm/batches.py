"""Arrow batches in slices of bounded bytes, so that a worker never holds a batch's texts as Python objects at once."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a slice; a longer text is a slice of its own.
SLICE = 1 << 20


def give_back() -> None:
    """Free memory of this worker, which waits for further tasks, back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # of glibc only
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], *columns: str, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, in slices of about ``size`` bytes of the named columns."""
    for batch in batches:
        total = np.zeros(batch.num_rows, np.int64)
        for c in columns:
            total += pc.fill_null(pc.binary_length(batch.column(c).cast(pa.binary())), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(total + 1)
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
    give_back()


def fresh(columns: list[str], name: str) -> str:
    """``name``, with underscores before it as long as a column has it (whatever its case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def without(columns: list[str], made: list[str]) -> list[str]:
    """The columns whose names no made column has (whatever their case)."""
    names = {m.lower() for m in made}
    return [c for c in columns if c.lower() not in names]
