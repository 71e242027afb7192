"""Progress of long steps: a factory of context managers that yield a tick(completed) callback."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager
from typing import Protocol, TextIO

from pyspark.sql import SparkSession


class Counter(Protocol):
    """What tasks tell how many rows they have done: an accumulator, or nothing."""

    def add(self, term: int) -> None: ...


class _NoCount:
    def add(self, term: int) -> None:
        pass


NO_COUNT = _NoCount()

Progress = Callable[[str, int], AbstractContextManager[Callable[[int], None]]]


@contextmanager
def no_progress(label: str, total: int) -> Iterator[Callable[[int], None]]:
    """Shows nothing."""
    yield lambda completed: None


@contextmanager
def ticking(spark: SparkSession, tick: Callable[[int], None], every: float = 0.5) -> Iterator[Counter]:
    """A counter for tasks: while the step runs, a thread of the driver tells tick() how much is done as tasks end.

    A task that runs again counts again, so a tick may pass the total.
    """
    done, over, told = spark.sparkContext.accumulator(0), threading.Event(), 0

    def watch() -> None:
        nonlocal told
        while not over.wait(every):
            if done.value != told:
                told = done.value
                tick(told)

    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    try:
        yield done
    finally:
        over.set()
        thread.join()
        if done.value != told:
            tick(done.value)


def job_progress(spark: SparkSession, stream: TextIO | None = None) -> Progress:
    """Names the jobs of a step after it, so that Spark's own pages show how far it is, and writes lines to a stream."""
    context = spark.sparkContext

    @contextmanager
    def step(label: str, total: int) -> Iterator[Callable[[int], None]]:
        before = context.getLocalProperty("spark.job.description")
        of = f" of {total}" if total else ""
        context.setJobDescription(label)

        def tick(completed: int) -> None:
            context.setJobDescription(f"{label} ({completed}{of})")
            if stream is not None:
                print(f"{label} {completed}{of}", file=stream, flush=True)

        try:
            yield tick
        finally:
            context.setLocalProperty("spark.job.description", before)

    return step
