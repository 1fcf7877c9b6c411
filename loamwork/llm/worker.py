"""What a Python worker keeps from one task to the next: one object at most, and only as long as the same operator runs."""

from __future__ import annotations

from collections.abc import Callable

_KEPT: list[tuple[object, object]] = []


def kept(key: object, make: Callable[[], object]) -> object:
    """The worker's object for this key, made now if it has another one or none."""
    if not _KEPT or _KEPT[0][0] != key:
        _KEPT[:] = [(key, make())]
    return _KEPT[0][1]


def free() -> None:
    """Other operators call this first: a reused worker gives back what the one before it remembered."""
    _KEPT.clear()
