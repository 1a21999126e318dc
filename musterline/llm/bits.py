"""Bit tables built by Spark: which of a number of cells the keys of a column fall into.

A task that holds such a table can drop rows that cannot match anything before they are
shuffled. A set bit proves nothing, so a join or an exact check always follows; a table
that fills up drops less and changes no result. The size is BITS, or `room(count)`: 16 bits
a key, at most LARGEST (128 MB), so a table never outgrows a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from musterline.llm.words import mixed

BITS = 1 << 24
LARGEST = 1 << 30
_SLICES = 8
_SCHEMA = "slice int, bits binary"


def room(count: int) -> int:
    """Bits for that many keys: a power of two, 16 a key or more where that may be held."""
    return min(LARGEST, max(1 << 16, 1 << (16 * count).bit_length()))


def cells(keys: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The cell of each 64-bit key: the top bits once they are mixed, as keys may be the least of many hashes."""
    return (mixed(keys.view(np.uint64)) >> np.uint64(65 - bits.bit_length())).astype(np.int64)


def _mark(bits: int) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(bits, bool)
        for batch in batches:
            table[cells(np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)), bits)] = True
        if table.any():
            packed = [np.packbits(x).tobytes() for x in np.split(table, _SLICES)]
            yield pa.record_batch([pa.array(range(_SLICES), pa.int32()), pa.array(packed, pa.binary())], names=["slice", "bits"])

    return task


def _either(bits: int) -> Callable:
    def group(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(bits // _SLICES // 8, np.uint8)
        for batch in batches:
            for x in batch.column("bits"):
                total |= np.frombuffer(x.as_buffer(), np.uint8)
        yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slice", "bits"])

    return group


def bit_table(keys: DataFrame, bits: int = BITS) -> np.ndarray:
    """That many booleans, packed, from the one column of longs."""
    rows = keys.dropna().mapInArrow(_mark(bits), _SCHEMA).groupBy("slice").applyInArrow(_either(bits), _SCHEMA).collect()
    packed = np.zeros((_SLICES, bits // _SLICES // 8), np.uint8)
    for r in rows:
        packed[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    return packed.reshape(-1)


def member(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key's bit is set in a packed table."""
    at = cells(keys, 8 * len(table))
    return (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).view(bool)
