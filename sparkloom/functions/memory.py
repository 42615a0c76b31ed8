"""Memory of Python workers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa


def give_back() -> None:
    """Return freed memory to the system: Arrow's pool and the C library keep it else, in workers that stand idle as well."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable, sides: int = 1) -> Callable:
    """run, a function of one group (or of the two sides of a cogroup), after which memory is given back."""

    def one(t: pa.Table) -> pa.Table:
        try:
            return run(t)
        finally:
            give_back()

    def two(a: pa.Table, b: pa.Table) -> pa.Table:
        try:
            return run(a, b)
        finally:
            give_back()

    return one if sides == 1 else two
