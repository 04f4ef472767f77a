"""Scratch tables and partition counts, from the library; memory of Python workers."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import pyarrow as pa

from ..scratch import Scratch, partitions, shared_dir


def released(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after each, what its buffers have taken goes back to the system, as a worker outlives its tasks."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL(None).malloc_trim(0)


__all__ = ["Scratch", "partitions", "released", "shared_dir"]
