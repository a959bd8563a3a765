"""What the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..shared import cut, ship  # noqa: F401



_CACHES: dict = {}


def cache(name: str, held, clear) -> None:
    """Name what a module keeps in a Python worker: ``held()`` tells whether there is anything."""
    _CACHES[name] = (held, clear)


def claim(name: str) -> None:
    """Free what other operators have kept in this worker, which Spark uses again and again."""
    freed = False
    for other, (held, clear) in _CACHES.items():
        if other != name and held():
            clear()
            freed = True
    if freed:
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not every C library has it
            ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> list[bytes]:
    """Cells of a string column as UTF-8 bytes; a null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    """Cells of a string column; a null is empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``column`` holds about ``most`` bytes, one row at least."""
    for b in batches:
        size = np.zeros(b.num_rows + 1, np.int64)
        c = b.column(b.schema.get_field_index(column))
        if b.num_rows:
            np.cumsum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False), out=size[1:])
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(size, size[at] + most, "right")) - 1)
            yield b.slice(at, to - at)
            at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
