"""The size of the Arrow batches that Python workers are sent."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, most: int = 8 << 20) -> Iterator[None]:
    """Within, jobs that start send batches of about ``most`` bytes at most; the session's setting comes back after."""
    before = spark.conf.get(_KEY, None)
    spark.conf.set(_KEY, str(most))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_KEY)
        else:
            spark.conf.set(_KEY, before)
