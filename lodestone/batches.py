"""What Python functions over Arrow batches share: small slices at a time, and memory given back."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

#: Rows of a batch that are Python objects at a time.
SLICE = 200


def give_back() -> None:
    """Returns freed memory to the system: Python workers live on, and so would hold what their largest task took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, which returns freed memory when a task's batches are through."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def by_slices(f: Callable[[pa.Array], pa.Array], rows: int = SLICE):
    """f over arrays as a function for arrow_udf, which works on few rows at a time and passes their results on before it takes more."""

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for whole in arrays:
            for begin in range(0, len(whole), rows):
                yield f(whole.slice(begin, rows))
            del whole
            give_back()

    return run
