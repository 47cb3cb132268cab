"""Memory of the Python workers, which serve the tasks of one operator after the other."""

from __future__ import annotations

import ctypes
import gc
import sys

import pyarrow as pa


def make_room() -> None:
    """For a task that needs memory: let go of the vocabularies and word caches that tasks of other
    operators left in this worker (they are read again when asked for), and give freed memory back."""
    words = sys.modules.get("weir.llm.words")
    if words is not None:
        words._LOADED.clear()
    give_back()


def give_back() -> None:
    """Hand freed memory to the system, so that the worker's next tasks and its neighbours can have it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):              # another C library: it has its own ways
        pass
