"""Concurrent Spark jobs from one driver."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

A, B = TypeVar("A"), TypeVar("B")


def side_by_side(spark: SparkSession, work: Callable[[A], B], items: Sequence[A], threads: int = 6) -> list[B]:
    """Run independent fits as concurrent Spark jobs; results keep the order of ``items``."""
    if len(items) <= 1 or threads <= 1:
        return [work(i) for i in items]
    pool = ThreadPool(min(threads, len(items)))
    try:
        return pool.map(inheritable_thread_target(spark)(work), items, chunksize=1)
    finally:
        pool.close()
