"""Models in tasks: made once for each Python worker, asked batch by batch."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable
from typing import Any

#: This process's models, by the number of what makes them.
_MADE: dict[str, Any] = {}


class PerWorker:
    """A function that a factory makes in each worker when it is first called there; all later batches and tasks use it.

    What the factory makes is closed when the worker ends, if it has a close().
    """

    def __init__(self, make: Callable[[], Callable]) -> None:
        self.make, self.key = make, uuid.uuid4().hex

    def __call__(self, *arguments):
        if self.key not in _MADE:
            made = _MADE[self.key] = self.make()
            if hasattr(made, "close"):
                atexit.register(made.close)
        return _MADE[self.key](*arguments)


def each_alone(model: Callable[[list], list], batch: list) -> list:
    """What the model gives for a batch; if it fails on it as a whole, for each item alone, its error in place of a failed one."""
    if not batch:
        return []
    try:
        found = list(model(batch))
        if len(found) != len(batch):
            raise RuntimeError(f"the model gave {len(found)} answers for {len(batch)} items")
        return found
    except Exception as e:
        return [e] if len(batch) == 1 else [x for item in batch for x in each_alone(model, [item])]
