"""Small helpers the operators share: table reads, scratch tables, Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.session import materialize, scratch_path, ship_package

__all__ = [
    "Text", "doc_slices", "few", "give_back", "materialize", "pick", "scratch_path", "ship_package", "table", "text_slices",
]

#: ASCII white space of the contracts: space, tab, \n, \v, \f, \r.
WHITE = r"[\x20\x09-\x0D]+"

#: Text bytes handled by one numpy pass; bounds a worker's memory (a longer document is a pass of its own).
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of one or two numbers (some 20 MB as a hash table, which the driver builds) that may be broadcast; more go through a shuffled join.
BROADCAST_ROWS = 250_000


def few(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df``, of one or two numbers a row, marked for broadcast when its checked number of rows (or a bound on it) allows."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def pick(df: DataFrame, name: str) -> Column:
    """A column by its exact name, also when the name holds dots."""
    return F.col("`" + name.replace("`", "``") + "`")


class Text:
    """The texts of one slice of an Arrow batch as one byte buffer.

    ``data`` holds the texts end to end, ``offsets[i]:offsets[i + 1]`` is text i
    (null texts are empty), ``first`` the row of the batch that text 0 comes from.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def raw(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def _string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte buffer and int64 offsets of a string column; nulls have no bytes."""
    if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type)):
        col = col.cast(pa.string())
    wide = pa.types.is_large_string(col.type)
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def text_slices(col: pa.Array, most: int = SLICE_BYTES) -> Iterator[Text]:
    """Consecutive runs of a string column's texts, each of about ``most`` bytes; whole texts only."""
    raw, offsets = _string_buffers(col)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(max(to, at + 1), n)
        lo, hi = offsets[at], offsets[to]
        yield Text(raw[lo:hi], offsets[at : to + 1] - lo, at)
        at = to


def doc_slices(batches: Iterator[pa.RecordBatch], text_col: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, Text]]:
    """Slices of Arrow batches (whole rows) with their texts, each of about ``most`` text bytes."""
    for batch in batches:
        for t in text_slices(batch.column(batch.schema.get_field_index(text_col)), most):
            yield batch.slice(t.first, len(t)), t


def give_back() -> None:
    """At a task's end: memory that a reused worker has freed but still holds goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass
