"""What a Python worker keeps between tasks: one large object at a time, so stages that follow each other don't add up."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa

_held: dict[Hashable, Any] = {}


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """The worker's object of that key, made if it isn't the one kept; the one kept before goes."""
    if key not in _held:
        clear()
        _held[key] = make()
    return _held[key]


def clear() -> None:
    """Forgets what is kept, and gives its memory back."""
    if _held:
        _held.clear()
        gc.collect()
    trim()


def trim() -> None:
    """Gives free memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass
