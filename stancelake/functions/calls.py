"""Calls of services from within tasks: in batches, and again after a while where a service is busy."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from typing import TypeVar

from stancelake import errors

T = TypeVar("T")

#: Tries, seconds before the second one (each wait is twice the one before), and answers that are worth another.
TRIES, FIRST_WAIT, BUSY = 6, 2.0, frozenset({429, 500, 502, 503, 504})


def again(call: Callable[[], T], status: Callable[[Exception], int | None], tries: int = TRIES, first_wait: float = FIRST_WAIT, wait: Callable[[float], None] = time.sleep) -> T:
    """What the call gives. An error whose status is of BUSY is tried again, all others go on as they are."""
    for n in range(tries):
        try:
            return call()
        except Exception as error:
            if status(error) not in BUSY:
                raise
            if n == tries - 1:
                raise errors.ScorerFailed(f"still busy after {tries} tries") from error
        wait(first_wait * 2**n)
    raise errors.ScorerFailed("no tries")


def in_batches(values: Sequence, call: Callable[[Sequence], Sequence], size: int = 100) -> list:
    """The call's answers for all values, `size` at a time; other numbers of answers than values are an error."""
    out: list = []
    for at in range(0, len(values), size):
        part = values[at : at + size]
        got = call(part)
        if len(got) != len(part):
            raise errors.ScorerFailed(f"{len(got)} answers for {len(part)} values")
        out.extend(got)
    return out
