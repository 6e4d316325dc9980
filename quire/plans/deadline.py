"""Time limits on jobs, pages and recognitions."""

from __future__ import annotations

import signal
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import TypeVar

from pyspark.sql import SparkSession

Result = TypeVar("Result")


def within(spark: SparkSession, seconds: float, action: Callable[[], Result]) -> Result:
    """Run ``action``; its Spark jobs are cancelled when ``seconds`` pass, which raises TimeoutError."""
    context, tag, late = spark.sparkContext, f"quire-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    context.addJobTag(tag)
    timer.start()
    try:
        return action()
    except Exception as failure:
        if late.is_set():
            raise TimeoutError(f"not done within {seconds} s") from failure
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)


@contextmanager
def time_limit(seconds: float | None, code: str) -> Iterator[None]:
    """Raise TimeoutError with ``code`` in the block once ``seconds`` pass.

    For single pages or recognitions inside a Python worker, whose functions run on its main
    thread; elsewhere, or without a limit, nothing is limited.
    """
    if not seconds or threading.current_thread() is not threading.main_thread():
        yield
        return

    def late(*_: object) -> None:
        raise TimeoutError(f"{code}: not done within {seconds} s")

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)
