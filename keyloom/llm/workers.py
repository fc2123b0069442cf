"""What a Python worker does with memory that its task no longer needs.

Spark keeps workers between tasks, beside the executor's JVM and within the same limit. Freed memory
stays with Arrow's and the C library's allocators unless they are asked to return it.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _run_frugally(run: Run, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    try:
        yield from run(batches)
    finally:
        give_back()


def frugal(run: Run) -> Run:
    """run for mapInArrow, with freed memory returned at the end of each task."""
    return partial(_run_frugally, run)
