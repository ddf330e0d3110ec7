"""Column names that clash with none of an input's."""

from __future__ import annotations

from collections.abc import Iterable


def free_name(wanted: str, taken: Iterable[str]) -> str:
    """``wanted``, or where a column of that name is there in any case, ``wanted_2`` and so on."""
    held = {name.lower() for name in taken}
    name, n = wanted, 1
    while name.lower() in held:
        n += 1
        name = f"{wanted}_{n}"
    return name
