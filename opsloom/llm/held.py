"""What a Python worker keeps between its tasks: one thing at a time.

Spark reuses workers, so a table that one stage lays out would stay in memory through all stages
after it.  A stage that asks for something else, or for nothing, lets the last thing go first.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

_kept: list = []


def held(key: object, build: Callable[[], Any]) -> Any:
    """The thing of that key (compared by identity or equality), built if the worker holds another one or none."""
    if not _kept or not (_kept[0] is key or (type(_kept[0]) is type(key) and isinstance(key, str) and _kept[0] == key)):
        drop()
        _kept[:] = [key, build()]
    return _kept[1]


def drop() -> None:
    """Let go of what is kept."""
    _kept.clear()
