"""What a Python worker remembers: one operator's tables at a time.

Workers outlive a stage, and the next operator's tasks would add their tables to those of the one before.
"""

from __future__ import annotations

from collections.abc import Callable

_holder: Callable[[], None] | None = None


def holds(forget: Callable[[], None]) -> None:
    """Say that the caller's tables are in use; those of another user are forgotten first, by its own `forget`."""
    global _holder
    if _holder != forget:
        if _holder is not None:
            _holder()
        _holder = forget
