"""Texts of an Arrow batch as one flat byte array: word boundaries and word hashes without a loop over words.

A word is a run of ASCII letters, digits, ``_`` or bytes of non-ASCII code points, lower-cased.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Functions of this folder travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLICE_BYTES = 1 << 20
BATCH_ROWS = 500
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
MIX = np.uint64(0xBF58476D1CE4E5B9)
BYTE_VALUES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
WORD_BYTE = np.array([b >= 128 or chr(b).isalnum() or b == 95 for b in range(256)])


class Words(NamedTuple):
    """Words of all rows in reading order. ``start`` and ``end`` count bytes of ``data``."""
    hash: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray


def powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base & 0xFFFFFFFFFFFFFFFF, np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and the n + 1 offsets of the rows; a null row is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset: column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    values = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return values[offsets[0]: offsets[-1]], offsets - offsets[0]


def words(column: pa.Array) -> Words:
    """Lower-cased words of each row with 64-bit hashes; equal words have equal hashes in every task."""
    data, offsets = flat(pc.utf8_lower(column.cast(pa.large_string())))
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none.astype(np.uint64), none, none, none)
    inside = WORD_BYTE[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[edges]
    stops[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    hashes = np.empty(len(start), np.uint64)
    step = min(len(data), SLICE_BYTES)
    up, down = powers(BASE, step), powers(INVERSE, step)
    first = 0
    while first < len(start):
        origin = start[first]
        last = max(int(np.searchsorted(end, origin + step, "right")), first + 1)
        length = end[last - 1] - origin
        if length > len(up):  # one word longer than a slice
            up, down = powers(BASE, length), powers(INVERSE, length)
        total = np.zeros(length + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data[origin: origin + length]] * up[:length], out=total[1:])
        s, e = start[first:last] - origin, end[first:last] - origin
        hashes[first:last] = (total[e] - total[s]) * down[s]
        first = last
    return Words(mixed(hashes), np.searchsorted(offsets, start, "right") - 1, start, end)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text, one row at least, so memory follows the longest text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, first = np.cumsum(sizes, dtype=np.int64), 0
        while first < len(sizes):
            before = total[first - 1] if first else 0
            last = max(int(np.searchsorted(total, before + most, "right")), first + 1)
            yield batch.slice(first, last - first)
            first = last
        del batch
        pa.default_memory_pool().release_unused()  # idle workers share an executor's memory with busy ones


def arrow_map(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` in batches of at most ``BATCH_ROWS`` rows, so that a worker and the writer that feeds it hold few texts at
    once. The bound is a session setting, read when the job runs; it stays set, and a smaller one is kept."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCH_SETTING)) <= BATCH_ROWS:
        conf.set(BATCH_SETTING, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def held_out(id_column: str, modulus: int, remainder: int) -> Column:
    """Whether a row belongs to the fold that no label may be learnt from; rows without an id do."""
    return F.coalesce(F.crc32(F.col(f"`{id_column}`").cast("string")) % modulus == remainder, F.lit(True))


def unused(df: DataFrame, name: str) -> str:
    """``name``, longer by as many marks as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def type_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()
