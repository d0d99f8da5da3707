"""Memory of Python workers. Spark hands a worker from task to task, and with it whatever the last task left there."""

from __future__ import annotations

import ctypes

import pyarrow as pa

_TABLES: dict = {}
try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def shared(key: str, make):
    """The table of this worker process for a key; it outlives the task. One at a time."""
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = make()
    return _TABLES[key]


def release() -> None:
    """Give back to the system what allocators hold in reserve."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def lean(batches, tables: bool = False):
    """The batches; memory that the work on each has freed goes back to the system before the next. Unless the task
    uses shared() tables, those of earlier tasks go first."""
    if not tables:
        _TABLES.clear()
    for batch in batches:
        yield batch
        release()
