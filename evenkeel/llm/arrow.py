"""Arrow batches for the operators that run Python: bounded batches, whole texts."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Texts of a slice are worked on together; a longer text makes a slice of its own.
SLICE_BYTES = 2 << 20


def bounded_batches(spark: SparkSession, rows: int = 2000, size: int = 32 << 20) -> None:
    """Keep Arrow batches within a few tens of MB, whatever the length of the rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def trim() -> None:
    """Give memory that is free back to the system: a worker lives on after its task, beside the others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_libc(), "malloc_trim", None)
    if trim is not None:
        trim(0)


@functools.cache
def _libc() -> ctypes.CDLL | None:
    try:
        return ctypes.CDLL(None)
    except OSError:  # a system without it
        return None


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, giving free memory back at the end of each task."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return whole


def text_array(column: pa.Array) -> pa.Array:
    """The column as 64-bit-offset strings, nulls as empty."""
    return column.cast(pa.large_string()).fill_null("")


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES, raw: bool = False) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive slices of about ``most`` bytes of text (``raw``: a column with 64-bit offsets), at least one row each."""
    if batch.num_rows == 0:
        return
    column = batch.column(text) if raw else text_array(batch.column(text))
    at = np.concatenate([[0], np.cumsum(lengths(column))])
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(at, at[start] + most, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after the other, and the n + 1 offsets."""
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lengths(texts: pa.Array) -> np.ndarray:
    return np.diff(buffers(texts)[1])
