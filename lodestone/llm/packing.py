"""Harmonic packing of tokenised documents into fixed-size training sequences.

A piece of length n belongs to class k when capacity / (k + 1) < n <= capacity / k, and a bin of class k is
closed when it holds exactly k pieces. Every partition fills bins of its own, so packing needs no shuffle and
a lost task is simply run again. Documents are cut where that makes bins exact: whole sequences first, then at
capacity / 2, / 4, ... down to ``smallest``; only the last few ids keep their own length. Bins that are still
open when the partition ends are laid end to end, cut at the capacity, the last of them at powers of two, which
need no padding. A partition holds at most one open bin per class in memory.

Null text counts as empty: such a document is the separator alone. Repeated rows are packed as often as they
occur. An empty table gives no rows. Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import base64
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame

from lodestone.llm.text import arrow_map, slices, text_or_empty, type_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

COLUMNS = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


def encoder(vocabulary: str, pattern: str, added: dict[str, int]) -> Callable[[str], list[int]]:
    """Byte-level BPE over a file of ranks. Added tokens within a text get their own ids; without any, they are ordinary text."""
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
    return lambda text: coder.encode(text, allowed_special="all")


def cuts(n: int, capacity: int, smallest: int) -> list[int]:
    """Lengths of the pieces of a document of n ids."""
    lengths = [capacity] * (n // capacity)
    rest, size = n % capacity, capacity // 2
    while size >= smallest:
        if rest >= size:
            lengths.append(size)
            rest -= size
        size //= 2
    return lengths + [rest] * (rest > 0)


class Bins:
    """Open bins of one partition, one per class."""

    def __init__(self, capacity: int, smallest: int, partition: int):
        self.capacity, self.smallest = capacity, smallest
        self.open: dict[int, list[tuple]] = {}
        self.sequence = partition << 36
        self.rows: list[tuple] = []

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), ids.tobytes(), total, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def add(self, doc, ids: np.ndarray) -> None:
        start = 0
        for length in cuts(len(ids), self.capacity, self.smallest):
            kind = self.capacity // length
            waiting = self.open.setdefault(kind, [])
            waiting.append((doc, start, ids[start: start + length], len(ids)))
            start += length
            if len(waiting) == kind:
                self.close(self.open.pop(kind))

    def finish(self) -> None:
        """Lay the pieces of open bins end to end and cut them into sequences without padding."""
        left = [piece for kind in sorted(self.open) for piece in self.open[kind]]
        self.open = {}
        total = sum(len(ids) for _, _, ids, _ in left)
        while left:
            room = self.capacity if total >= self.capacity else 1 << (total.bit_length() - 1)
            total -= room
            inside = []
            while room:
                doc, start, ids, n = left[0]
                inside.append((doc, start, ids[:room], n))
                if len(ids) > room:
                    left[0] = (doc, start + room, ids[room:], n)
                else:
                    left.pop(0)
                room -= len(inside[-1][2])
            self.close(inside)

    def drain(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(docs: DataFrame, vocabulary: str, pattern: str, capacity: int = 1024, smallest: int = 64, separator: int = 0,
         id_column: str = "doc_id", text_column: str = "text", added: dict[str, int] | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset.

    ``capacity`` and ``smallest`` are powers of two; ``vocabulary`` is a rank file present on every executor;
    ``added`` are the ids of tokens that are recognised whole.
    """
    if capacity & (capacity - 1) or smallest & (smallest - 1) or not 0 < smallest <= capacity:
        raise ValueError("capacity and smallest must be powers of two, smallest at most capacity")
    kind = type_of(docs, id_column)
    rows = docs.select(docs[f"`{id_column}`"].alias("doc_id"), text_or_empty(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, pattern, added or {})
        bins = Bins(capacity, smallest, TaskContext.get().partitionId())
        types = None

        def out() -> pa.RecordBatch:
            columns = list(zip(*bins.drain())) or [()] * len(COLUMNS)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], COLUMNS)

        for batch in slices(batches, "text"):
            types = (batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                bins.add(doc, np.array(encode(text) + [separator], "<u4"))
            yield out()
        if types:
            bins.finish()
            yield out()

    return arrow_map(rows, run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
