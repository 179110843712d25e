"""What a Python worker remembers from task to task: one thing at a time, so that the stages of a pipeline don't add up."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa

_held: dict[tuple, Any] = {}


def held(key: tuple, make: Callable[[], Any]) -> Any:
    """What was made under ``key``; whatever was held under another is let go."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def released() -> None:
    """Lets go of what is held, and of what Arrow keeps of earlier batches: for stages that hold nothing, before their own work."""
    _held.clear()
    pa.default_memory_pool().release_unused()
