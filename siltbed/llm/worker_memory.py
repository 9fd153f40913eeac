"""What a Python worker keeps from one task to the next.

Functions of this package travel to workers by value, so their own globals (and ``functools`` caches, which would travel
by name) don't outlive a task. A module made in the worker does.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Hashable
from types import ModuleType
from typing import Any

NAME = "_worker_memory"


def memory(name: str) -> dict:
    """A dictionary of this name, the same for all tasks of the worker."""
    module = sys.modules.setdefault(NAME, ModuleType(NAME))
    return module.__dict__.setdefault(name, {})


def remembered(name: str, key: Hashable, make: Callable[[], Any], most: int = 4) -> Any:
    """The value of a key, made once by each worker; of a name at most so many are kept."""
    known = memory(name)
    if key not in known:
        if len(known) >= most:
            known.clear()
        known[key] = make()
    return known[key]
