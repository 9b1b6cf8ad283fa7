"""Texts in pieces of bounded size on their way to Python and inside it."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Setting that bounds the bytes of a batch for Python, and the value used where the session has no bound of its own.
SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"
#: Bytes of a slice of a batch that is unpacked at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20


def bounded(spark: SparkSession) -> None:
    """Bound the batches of the session, which by default hold ten thousand rows of any length."""
    if spark.conf.get(SETTING, None) in (None, "-1", "2147483647", "2147483647b", "9223372036854775807", "9223372036854775807b"):
        spark.conf.set(SETTING, BATCH_BYTES)


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE_BYTES, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows and about ``size`` bytes."""
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * size // max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def fresh(name: str, columns: list[str]) -> str:
    """``name``, or the first of ``name1, name2 ..`` that is no column, in either case of letters."""
    taken, k, own = {c.lower() for c in columns}, 0, name
    while own.lower() in taken:
        k += 1
        own = f"{name}{k}"
    return own


def released() -> None:
    """Give memory that a finished task held back to the system, since the worker stays and other stages run in it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of most systems has it
    if trim:
        trim(0)
