"""Batches of whole texts that Spark hands to Python."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows of a batch at most. Spark's own bound counts rows too, and 10,000 texts of some hundred
#: kilobytes would fill an executor outside its heap.
TEXTS = 1000


def bound_batches(spark: SparkSession, rows: int = TEXTS) -> None:
    """Lower the session's bound on the rows of a batch; it is never raised."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))


def release() -> None:
    """Give memory that a task no longer uses back to the system; a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def _find_trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # not glibc
        return None


_trim = _find_trim()
