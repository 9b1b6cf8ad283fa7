"""A filter of fixed size that says which rows can have a partner, before they are shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierflow.llm.batches import fresh

#: Bits of a filter, and the parts in which it is put together. Fixed: 4 MB are broadcast whatever the tables.
BITS, PARTS = 1 << 25, 64


def filter_of(keys: DataFrame, hashed: Column) -> np.ndarray:
    """One bit for each hash of ``keys``, as 64-bit words."""
    size = BITS // PARTS

    def fill(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for batch in batches:
            bits[batch.column(1).to_numpy() & (size - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

    parts = keys.select(hashed.bitwiseAND(BITS - 1).alias("bit")).select(F.expr(f"cast(bit div {size} as int)").alias("part"), "bit")
    out = np.zeros((PARTS, size // 8), np.uint8)
    for row in parts.groupBy("part").applyInArrow(fill, "part int, bits binary").collect():  # PARTS rows of fixed size
        out[row.part] = np.frombuffer(row.bits, np.uint8)
    return out.reshape(-1).view(np.uint64)


def contained(bits: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Whether the filter may hold keys with these hashes (modulo ``BITS``)."""
    return ((bits[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1)).astype(bool)


def possible(rows: DataFrame, column: str, bits: np.ndarray, want: bool = True) -> DataFrame:
    """The rows whose key may be in the filter (some others as well), or with ``want`` false those whose key is not."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.uint64)
            yield batch.filter(pa.array(contained(shared.value, low) == want)).select(range(batch.num_columns - 1))

    return rows.withColumn(fresh("bit", rows.columns), F.xxhash64(column).bitwiseAND(BITS - 1)).mapInArrow(run, rows.schema)
