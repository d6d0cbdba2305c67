"""Memory of Python workers, which Spark keeps for later tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa


def give_back() -> None:
    """Return what this process has freed to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        # Another C library keeps its own house.
        pass


def lean(factory: Callable) -> Callable:
    """For makers of Arrow task functions: a worker that has ended its task holds no freed memory until the next one.

    Spark keeps workers for later stages, and several stand idle beside those at work.
    """

    @wraps(factory)
    def make(*args: object, **options: object) -> Callable:
        run = factory(*args, **options)

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            try:
                yield from run(batches)
            finally:
                give_back()

        return task

    return make
