"""Workers give memory back when a task ends, so that one stage's peak is not held through the next."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator


def returned() -> None:
    """Unused memory of Arrow and of the C library to the system."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        # another C library, which has no such call
        return


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for ``mapInArrow`` that returns unused memory when its input ends."""

    @functools.wraps(run)
    def out(batches: Iterator) -> Iterator:
        yield from run(batches)
        returned()

    return out
