"""Memory limits of workers: set on a session, watched in a worker, told apart afterwards."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quire.options import MEMORY_KILLS


def worker_settings(memory_cap_bytes: int) -> dict[str, str]:
    """Session settings that cap a Python worker's memory and its threads (X2, X4); 0 leaves memory alone."""
    out = {"spark.executorEnv.OMP_NUM_THREADS": "1", "spark.executorEnv.OPENBLAS_NUM_THREADS": "1", "spark.python.worker.reuse": "true"}
    return out | ({"spark.executor.pyspark.memory": f"{max(1, memory_cap_bytes >> 20)}m"} if memory_cap_bytes else {})


def with_worker_settings(builder: SparkSession.Builder, memory_cap_bytes: int = 0) -> SparkSession.Builder:
    """The session builder with ``worker_settings``; local workers inherit the driver's threads."""
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):
        os.environ.setdefault(name, "1")
    for key, value in worker_settings(memory_cap_bytes).items():
        builder = builder.config(key, value)
    return builder


def worker_count(setting: Column, pages: Column, cpus: Column) -> Column:
    """``options.worker_count`` over columns: 0 means one less than the processors; never more than pages, never below 1."""
    wanted = F.when(setting == 0, F.greatest(F.lit(1), cpus - 1)).otherwise(setting)
    return F.greatest(F.lit(1), F.least(wanted, F.greatest(F.lit(1), pages)))


def resident_bytes() -> int:
    """Memory that this process holds; 0 where the system doesn't say."""
    try:
        with open("/proc/self/statm") as stat:
            return int(stat.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")
    except OSError:
        return 0


def watched(function: Callable[[Iterable[Any]], Iterator[Any]], cap_bytes: int) -> Callable[[Iterable[Any]], Iterator[Any]]:
    """An Arrow function that stops with E-MEM-CAP once its worker holds more than ``cap_bytes`` after a batch.

    The check stands between batches, so what a batch holds is let go first; 0 switches it off.
    """

    def run(batches: Iterable[Any]) -> Iterator[Any]:
        for done in function(batches):
            yield done
            held = resident_bytes()
            if cap_bytes and held > cap_bytes:
                raise MemoryError(f"E-MEM-CAP: worker holds {held} bytes of {cap_bytes}")

    return run


def tidy(function: Callable[[Iterable[Any]], Iterator[Any]]) -> Callable[[Iterable[Any]], Iterator[Any]]:
    """An Arrow function whose worker gives freed memory back to the system when a task ends, as workers outlive tasks."""

    def run(batches: Iterable[Any]) -> Iterator[Any]:
        try:
            yield from function(batches)
        finally:
            release()

    return run


def release() -> None:
    """Give freed memory back to the system, as far as its libraries allow."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def death_code(exit_code: Column, cap_exceeded: Column) -> Column:
    """The error code of a worker that ended: its memory, its own failure, or none."""
    killed = F.coalesce(cap_exceeded, F.lit(False)) | F.coalesce(exit_code.isin(*MEMORY_KILLS), F.lit(False))
    return F.when(killed, "E-MEM-CAP").when(exit_code != 0, "E-ENGINE-ERROR")
