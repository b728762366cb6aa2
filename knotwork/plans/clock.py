"""One deadline for everything a kernel does.

A kernel's search runs inside ``deadline``; loops anywhere below it ask ``late`` and stop with what they
have (a packing or a clustering is valid at any time), or ``check`` where nothing partial is of use.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

#: The moment of the deadline. A kernel has one thread, and a list goes to executors by value with the functions.
_UNTIL: list[float | None] = [None]


class OutOfTime(Exception):
    """The deadline has passed."""


@contextmanager
def deadline(seconds: float | None) -> Iterator[None]:
    """Limit what runs inside to some seconds, or to what an outer deadline leaves."""
    outer = _UNTIL[0]
    own = None if seconds is None else time.monotonic() + seconds
    _UNTIL[0] = outer if own is None else own if outer is None else min(own, outer)
    try:
        yield
    finally:
        _UNTIL[0] = outer


def late() -> bool:
    """Whether the deadline has passed."""
    return _UNTIL[0] is not None and time.monotonic() > _UNTIL[0]


def check() -> None:
    """Raise ``OutOfTime`` once the deadline has passed."""
    if late():
        raise OutOfTime
