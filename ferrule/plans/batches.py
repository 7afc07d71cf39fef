"""Bound the Arrow batches in which whole texts travel between Spark and its Python workers.

Spark fills a batch up to ten thousand rows.  Of whole texts that is tens of
MB, held by the JVM outside its heap and by the worker, often twice while a
buffer grows or rows are copied, and neither gives all of it back.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MOST_BYTES = 4 << 20
_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
_UNITS = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def _bytes(value: str) -> int:
    number = value.strip().lower().removesuffix("b")
    return int(number[:-1]) * _UNITS[number[-1]] if number[-1:] in _UNITS else int(number)


def bound_batches(spark: SparkSession, most: int = MOST_BYTES) -> None:
    """Hold the session's batches to ``most`` bytes and a row; a smaller bound of its own stays.

    It holds from now on, as a frame is planned only when it is written.  No row is lost or cut, batches are only more."""
    if _bytes(spark.conf.get(_KEY)) > most:
        spark.conf.set(_KEY, str(most))


def in_small_batches(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``f(spark, ...)``, with the session's batches bounded first."""

    @functools.wraps(f)
    def run(spark: SparkSession, *args, **options) -> DataFrame:
        bound_batches(spark)
        return f(spark, *args, **options)

    return run
