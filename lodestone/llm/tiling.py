"""Benchmark decontamination by greedy string tiling.

Texts and test items are sequences of lower-cased words. Seeds, the hashes of ``least`` consecutive words of the items,
find the documents and items worth comparing. Each such pair is tiled with running Karp-Rabin: the longest
common runs of unmarked words are marked again and again until none of ``least`` words is left, so passages count
wherever and in whatever order they occur. An item is leaked into a document when its tiles cover at least
``coverage`` of its words. An item of fewer than ``least`` words is no evidence and matches nothing.

Items are broadcast in blocks whose bytes are bounded by ``block_bytes``; each block is compared with all
documents in one pass without a shuffle, so a task holds one block and one batch of documents.

Null or wordless texts and items match nothing. Repeated documents or items are reported as often as they occur. An empty
table gives no rows. Other columns are not read by ``leaks`` and kept by ``decontaminate``.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.text import arrow_map, mixed, slices, text_or_empty, type_of, words

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STEP = 0x100000001B3


class Items(NamedTuple):
    """A block of test items: ids, word hashes per item, and sorted seeds with the items that hold them."""
    ids: list
    tokens: list[np.ndarray]
    seed: np.ndarray
    owner: np.ndarray


class Tile(NamedTuple):
    item_at: int
    doc_at: int
    length: int


def window_hashes(tokens: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``width`` words."""
    n = len(tokens) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = total * np.uint64(STEP) + tokens[k: k + n]
    return mixed(total)


def seeds_of(ids: list, tokens: list[np.ndarray], least: int) -> Items:
    seeds = [window_hashes(t, least) for t in tokens]
    seed = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds]).astype(np.int64)
    order = np.argsort(seed, kind="stable")
    return Items(ids, tokens, seed[order], owner[order])


def matches_of(pattern: list[int], text: list[int], free_p: list[bool], free_t: list[bool], size: int) -> list[Tile]:
    """Maximal common runs of at least ``size`` unmarked words; windows of ``size`` are found by their hashes."""
    def windows(tokens: list[int], free: list[bool]) -> Iterator[tuple[int, int]]:
        top, value, run = pow(STEP, size, 1 << 64), 0, 0
        for i, token in enumerate(tokens):
            if not free[i]:
                value = run = 0
                continue
            value = (value * STEP + token) & 0xFFFFFFFFFFFFFFFF
            run += 1
            if run > size:
                value = (value - top * tokens[i - size]) & 0xFFFFFFFFFFFFFFFF
            if run >= size:
                yield i - size + 1, value

    table = defaultdict(list)
    for at, value in windows(text, free_t):
        table[value].append(at)
    found, done = [], set()
    for p, value in windows(pattern, free_p):
        for t in table.get(value, ()):
            if (p - 1, t - 1) in done:  # lies within a longer run seen already
                done.add((p, t))
                continue
            n = 0
            while p + n < len(pattern) and t + n < len(text) and free_p[p + n] and free_t[t + n] and pattern[p + n] == text[t + n]:
                n += 1
            if n >= size:
                found.append(Tile(p, t, n))
                done.add((p, t))
    return found


def greedy_tiles(pattern: list[int], text: list[int], least: int, start: int = 32) -> list[Tile]:
    """Running Karp-Rabin greedy string tiling: non-overlapping tiles, longest first."""
    free_p, free_t, tiles = [True] * len(pattern), [True] * len(text), []
    size = max(least, min(start, len(pattern), len(text)))
    while True:
        found = matches_of(pattern, text, free_p, free_t, size)
        longest = max((m.length for m in found), default=0)
        if longest > 2 * size:
            size = longest
            continue
        again = False
        for tile in sorted(found, key=lambda m: (-m.length, m.item_at, m.doc_at)):
            inside = range(tile.length)
            if all(free_p[tile.item_at + k] for k in inside) and all(free_t[tile.doc_at + k] for k in inside):
                for k in inside:
                    free_p[tile.item_at + k] = free_t[tile.doc_at + k] = False
                tiles.append(tile)
            else:
                again = True  # partly covered now; what is left of it may still be long enough
        if again:
            continue
        if size == least:
            return tiles
        size = max(least, size // 2)


def near_seeds(hits: np.ndarray, width: int, n: int) -> np.ndarray:
    """Word positions covered by a window that starts at a hit; only they can belong to a tile."""
    level = np.zeros(n + 1, np.int64)
    np.add.at(level, hits, 1)
    np.add.at(level, np.minimum(hits + width, n), -1)
    return np.flatnonzero(np.cumsum(level[:-1]) > 0)


def compare(tokens: np.ndarray, items: Items, least: int) -> Iterator[tuple[int, list[Tile]]]:
    """(item number, tiles) for each item of the block that shares a seed with the document."""
    hits = defaultdict(list)
    hashes = window_hashes(tokens, least)
    left, right = np.searchsorted(items.seed, hashes, "left"), np.searchsorted(items.seed, hashes, "right")
    for at in np.flatnonzero(right > left).tolist():
        for owner in set(items.owner[left[at]: right[at]].tolist()):
            hits[owner].append(at)
    for owner, starts in hits.items():
        pattern = items.tokens[owner]
        place = near_seeds(np.array(starts), least, len(tokens))
        # A break between stretches must not join them: a word of its own stands there.
        text, where = [], []
        for k, position in enumerate(place.tolist()):
            if k and position != where[-1] + 1:
                text.append(-1)
                where.append(-1)
            text.append(int(tokens[position]))
            where.append(position)
        tiles = greedy_tiles([int(t) for t in pattern], text, least)
        yield owner, [Tile(t.item_at, where[t.doc_at], t.length) for t in tiles]


def item_blocks(benchmark: DataFrame, least: int, block_bytes: int, id_column: str, text_column: str) -> Iterator[Items]:
    """Blocks of items, each of about ``block_bytes`` at most; one block is on the driver at a time."""
    items = benchmark.select(benchmark[f"`{id_column}`"].alias("item_id"), text_or_empty(text_column).alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = -(-total // block_bytes)
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k) if blocks > 1 else items
        got = part.toArrow().combine_chunks()
        text = got.column("text").combine_chunks() if got.num_rows else pa.array([], pa.string())
        found = words(text)
        ends = np.searchsorted(found.row, np.arange(len(text) + 1))
        yield seeds_of(got.column("item_id").to_pylist(), [found.hash[a:b] for a, b in zip(ends, ends[1:])], least)


def leaked(batch: pa.RecordBatch, text_column: str, items: Items, least: int, coverage: float) -> Iterator[tuple[int, int, list[Tile]]]:
    """(row, item number, tiles) of each leak in a batch."""
    found = words(batch.column(text_column))
    ends = np.searchsorted(found.row, np.arange(batch.num_rows + 1))
    # One look at all windows of the batch leaves the few documents with a seed; windows across rows do no harm here.
    hashes = window_hashes(found.hash, least)
    likely = set()
    if len(items.seed) and len(hashes):
        at = np.minimum(np.searchsorted(items.seed, hashes), len(items.seed) - 1)
        likely.update(found.row[np.flatnonzero(items.seed[at] == hashes)].tolist())
    for row in sorted(likely):
        for owner, tiles in compare(found.hash[ends[row]: ends[row + 1]], items, least):
            if sum(t.length for t in tiles) >= coverage * len(items.tokens[owner]):
                yield row, owner, tiles


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = 5, coverage: float = 0.5, block_bytes: int = 8 << 20, id_column: str = "doc_id",
          text_column: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per leaked item and document: doc_id, item_id, item_words, matched_words, coverage, and the tiles as
    array of struct(item_at, doc_at, length), positions counted in words."""
    rows = docs.select(docs[f"`{id_column}`"].alias("doc_id"), text_or_empty(text_column).alias("text"))
    schema = (f"doc_id {type_of(docs, id_column)}, item_id {type_of(benchmark, item_id)}, item_words long, matched_words long, "
              "coverage double, tiles array<struct<item_at:long,doc_at:long,length:long>>")
    spark, out = docs.sparkSession, docs.sparkSession.createDataFrame([], schema)
    for block in item_blocks(benchmark, least, block_bytes, item_id, item_text):
        items = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            known = items.value
            for batch in slices(batches, "text"):
                hits = list(leaked(batch, "text", known, least, coverage))
                sizes = [len(known.tokens[owner]) for _, owner, _ in hits]
                matched = [sum(t.length for t in tiles) for _, _, tiles in hits]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(pa.array([row for row, _, _ in hits], pa.int64())),
                    pa.array([known.ids[owner] for _, owner, _ in hits], pa.infer_type(known.ids)),
                    pa.array(sizes, pa.int64()), pa.array(matched, pa.int64()),
                    pa.array([m / n for m, n in zip(matched, sizes)], pa.float64()),
                    pa.array([[t._asdict() for t in sorted(tiles)] for _, _, tiles in hits],
                             pa.list_(pa.struct([(name, pa.int64()) for name in Tile._fields])))],
                    ["doc_id", "item_id", "item_words", "matched_words", "coverage", "tiles"])

        out = out.unionByName(arrow_map(rows, run, schema))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = 5, coverage: float = 0.5, block_bytes: int = 8 << 20,
                  text_column: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that no item of ``benchmark`` leaked into, all columns kept."""
    schema, spark = docs.schema, docs.sparkSession
    for block in item_blocks(benchmark, least, block_bytes, item_id, item_text):
        items = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, text_column):
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, _, _ in leaked(batch, text_column, items.value, least, coverage)]] = False
                yield batch.filter(pa.array(keep))

        docs = arrow_map(docs, run, schema)
    return docs
