"""Byte-level BPE by a global shuffle of distinct words.

Encoding. A task cuts its documents into pre-tokens and has, per block of documents, the distinct words of the block in the order of a
hash and one code per position. The words are dealt by ranges of the hash; all equal words of the table meet in one range, each is
encoded once there, and the ids go back to the blocks they came from. A block then puts the ids in the order of its positions. A word is
sent once per block, so no word is a hot key, and words travel as compressed lists, not as rows, because a row per word and block took
more than four times the input. The number of ranges follows the bytes of all texts, so a range has a bound.

The documents are read twice, for the words and for the positions, as writing the positions down took as much disk as shuffling them.
Both readings must give the same rows in the same order, as a scan of files does; a block whose readings differ raises an error, and
``cut_lineage`` gives a frame that qualifies.

Decoding. Per batch of documents, the distinct ids are exploded with their positions and joined with the table of token bytes, which is
bounded by the vocabulary and broadcast, so nothing is shuffled; the same task puts the bytes back by position.

A null text is empty and has no ids. Repeated rows and null document ids are kept, one result row per input row. An empty table gives
no rows. Other columns are not read, whatever their names. A document is in one block, so the longest text bounds the memory of a task.
A document with an id outside the vocabulary decodes to null.
"""

from __future__ import annotations

import base64
import sys
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.llm.text import arrow_map, slices, text_or_empty, type_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_BYTES = 8 << 20
RANGE_BYTES = 32 << 20
LONG_TEXT = 1 << 24
MOST_VOCABULARY_BYTES = 64 << 20


def ranks_of(vocabulary: str) -> dict[bytes, int]:
    with open(vocabulary, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def stand_ins() -> dict[int, int]:
    """Code points whose letter or number class differs between the two regular-expression libraries, which follow different versions
    of Unicode, each with a code point that the matcher of this module reads as the BPE library reads the original."""
    import regex
    import tiktoken

    single = {bytes([b]): b for b in range(256)}
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))

    def theirs(kind: str) -> set[str]:
        split = tiktoken.Encoding(kind, pat_str=rf"\p{{{kind}}}", mergeable_ranks=single, special_tokens={})
        return set(bytes(split.encode_ordinary(every)).decode())

    letters, numbers = theirs("L"), theirs("N")
    our_letters, our_numbers = set(regex.findall(r"\p{L}", every)), set(regex.findall(r"\p{N}", every))
    odd = (letters ^ our_letters) | (numbers ^ our_numbers)
    return {ord(c): ord("a") if c in letters else ord("1") if c in numbers else ord("!") for c in odd}


class Splitter:
    """Matches of a pre-token pattern, as the BPE library would find them."""

    def __init__(self, pattern: str, replace: dict[int, int]):
        import regex

        self.pattern, self.replace = regex.compile(pattern), replace
        self.odd = frozenset(map(chr, replace))

    def __call__(self, text: str) -> Iterator[str]:
        if not text.isascii() and not self.odd.isdisjoint(text):
            return (text[m.start(): m.end()] for m in self.pattern.finditer(text.translate(self.replace)))
        if len(text) > LONG_TEXT:
            return (m.group() for m in self.pattern.finditer(text))
        return self.pattern.findall(text)


def binary_rows(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Rows of a flat byte array, given where each ends."""
    offsets = np.concatenate([np.zeros(1, np.int64), ends]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def gathered(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For entries laid out at ``starts`` with ``sizes``: indices that read the entries ``codes`` one after another, and where each ends."""
    lengths = sizes[codes]
    ends = np.cumsum(lengths, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    picks = np.repeat(starts[codes] - (ends - lengths), lengths)
    picks += np.arange(total)
    return picks, ends


def squeezed(values: np.ndarray | bytes) -> bytes:
    """Compressed bytes, or compressed 32-bit integers, by byte plane, as the upper planes are nearly constant."""
    if isinstance(values, np.ndarray):
        values = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.Codec("zstd", compression_level=1).compress(values, asbytes=True)


def spread(data: bytes, size: int) -> bytes:
    return pa.Codec("zstd").decompress(data, size, asbytes=True)


def numbers(data: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(spread(data, 4 * n), np.uint8).reshape(4, n).T).view("<u4").ravel()


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words))


def cut(data: bytes, sizes: np.ndarray) -> list[bytes]:
    ends = np.cumsum(sizes, dtype=np.int64).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


class Block:
    """Documents of one block: positions per document, distinct words in the order of their hash, and the words of the positions."""

    def __init__(self, number: int, rows: list[tuple], split: Splitter):
        index: dict[str, int] = defaultdict(count().__next__)
        coded = [np.fromiter(map(index.__getitem__, split(text)), "<u4") for _, text in rows]
        words = [w.encode() for w in index]
        self.number, self.docs, self.counts = number, [d for d, _ in rows], [len(c) for c in coded]
        self.order = np.argsort(hashes(words), kind="stable")
        self.words = [words[i] for i in self.order]
        self.flat = np.concatenate(coded)
        self.stamp = zlib.crc32(np.array(self.counts).tobytes(), zlib.crc32(b"".join(self.words)))

    def positions(self) -> list:
        """The block's row: codes are frequency ranks of words, ``places`` the place of a word in hash order by that rank."""
        place, rank = np.empty(len(self.order), "<u4"), np.empty(len(self.order), "<u4")
        place[self.order] = np.arange(len(self.order))
        frequent = np.argsort(-np.bincount(self.flat, minlength=len(self.order)), kind="stable")
        rank[frequent] = np.arange(len(self.order))
        return [self.number, self.stamp, self.docs, self.counts, len(self.flat), squeezed(rank[self.flat]), squeezed(place[frequent])]

    def parts(self, ranges: int) -> list[tuple]:
        """The words by range of their hash: range, block, stamp, place of the first word, and the words."""
        owners, first = np.unique(hashes(self.words).astype(np.int64) * ranges >> 32, return_index=True)
        out = []
        for r, a, b in zip(owners.tolist(), first.tolist(), [*first[1:].tolist(), len(self.words)]):
            some = self.words[a:b]
            data = b"".join(some)
            out.append((r, self.number, self.stamp, a, b - a, len(data), squeezed(np.fromiter(map(len, some), "<u4", b - a)), squeezed(data)))
        return out


def blocks(batches: Iterator[pa.RecordBatch], pattern: str, replace: dict[int, int], block_bytes: int) -> Iterator[Block]:
    split = Splitter(pattern, replace)
    following = count(TaskContext.get().partitionId() << 32)
    waiting: list[tuple] = []
    held = 0
    for batch in slices(batches, "text"):
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            waiting.append((doc, text))
            held += len(text)
            if held >= block_bytes:
                block = Block(next(following), waiting, split)
                waiting, held = [], 0
                yield block
                del block  # the next one is built without it
    if waiting:
        yield Block(next(following), waiting, split)


def positions_of(docs: DataFrame, pattern: str, block_bytes: int) -> DataFrame:
    """One row per block: ``block, stamp, docs, counts, n_codes, codes, places``, the last two compressed."""
    kind, replace = type_of(docs, "doc_id"), stand_ins()
    key = to_arrow_type(docs.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.list_(key), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary()]
        for block in blocks(batches, pattern, replace, block_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(block.positions(), kinds)],
                                             ["block", "stamp", "docs", "counts", "n_codes", "codes", "places"])
            del block

    return arrow_map(docs, run, f"block long, stamp long, docs array<{kind}>, counts array<long>, n_codes long, codes binary, places binary")


def parts_of(docs: DataFrame, pattern: str, block_bytes: int, ranges: int) -> DataFrame:
    """The distinct words of each block by range of their hash: ``range, home, stamp, first, n_words, word_bytes, sizes, words``."""
    replace = stand_ins()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 6 + [pa.binary()] * 2
        for block in blocks(batches, pattern, replace, block_bytes):
            columns = zip(*block.parts(ranges)) if block.words else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             ["range", "home", "stamp", "first", "n_words", "word_bytes", "sizes", "words"])
            del block, columns

    return arrow_map(docs, run, "range long, home long, stamp long, first long, n_words long, word_bytes long, sizes binary, words binary")


def encode_parts(parts: DataFrame, vocabulary: str) -> DataFrame:
    """``home, stamp, first, n_words, n_ids, sizes, ids`` per part: ids per word and the ids. Each distinct word of a range is encoded once, whole."""

    coders: list[Callable] = []  # one per task, for all its ranges

    def run(table: pa.Table) -> pa.Table:
        import tiktoken

        if not coders:
            coders.append(tiktoken.Encoding("ranks", pat_str=r"(?s:.+)", mergeable_ranks=ranks_of(vocabulary), special_tokens={}).encode_ordinary)
        whole = coders[0]
        known: dict[bytes, bytes] = {}
        out = []
        for row in table.to_pylist():
            ids = []
            for word in cut(spread(row["words"], row["word_bytes"]), numbers(row["sizes"], row["n_words"])):
                coded = known.get(word)
                if coded is None:
                    coded = known[word] = np.array(whole(word.decode()), "<u4").tobytes()
                ids.append(coded)
            data = b"".join(ids)
            out.append((row["home"], row["stamp"], row["first"], len(ids), len(data) // 4, squeezed(np.fromiter(map(len, ids), "<u4", len(ids)) // 4), squeezed(np.frombuffer(data, "<u4"))))
        columns = zip(*out)
        return pa.table([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 5 + [pa.binary()] * 2)],
                        ["home", "stamp", "first", "n_words", "n_ids", "sizes", "ids"])

    return parts.groupBy("range").applyInArrow(run, "home long, stamp long, first long, n_words long, n_ids long, sizes binary, ids binary")


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_column: str = "doc_id", text_column: str = "text",
           block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``doc_id, ids``: ids as little-endian unsigned 32-bit integers. ``vocabulary`` is a rank file present on every executor.

    ``range_bytes`` of text, on average, stand behind the words that one task encodes at a time.
    """
    kind = type_of(docs, id_column)
    rows = docs.select(docs[f"`{id_column}`"].alias("doc_id"), text_or_empty(text_column).alias("text"))
    ranges = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // range_bytes))
    resolved = encode_parts(parts_of(rows, pattern, block_bytes, ranges), vocabulary)

    def reassemble(left: pa.Table, right: pa.Table) -> pa.Table:
        head = left.to_pylist()[0]
        parts = sorted(right.to_pylist(), key=lambda p: p["first"])
        sizes = np.concatenate([np.zeros(0, np.int64), *[numbers(p["sizes"], p["n_words"]) for p in parts]]).astype(np.int64)
        flat = np.concatenate([np.zeros(0, "<u4"), *[numbers(p["ids"], p["n_ids"]) for p in parts]])
        if any(p["stamp"] != head["stamp"] for p in parts) or (head["n_codes"] and not parts):
            raise ValueError("two readings of the documents differ: write them down first")
        picks, ends = gathered(numbers(head["places"], len(sizes))[numbers(head["codes"], head["n_codes"])], np.cumsum(sizes) - sizes, sizes)
        doc_ends = np.concatenate([np.zeros(1, np.int64), ends])[np.cumsum(head["counts"])]
        return pa.table({"doc_id": left.column("docs").combine_chunks().flatten(), "ids": binary_rows(flat[picks].view(np.uint8), 4 * doc_ends)})

    return (positions_of(rows, pattern, block_bytes).groupBy("block").cogroup(resolved.groupBy("home"))
            .applyInArrow(reassemble, f"doc_id {kind}, ids binary"))


def token_bytes(spark, vocabulary: str) -> DataFrame:
    """The table ``token, bytes`` of a vocabulary; its size is checked, as it is broadcast."""
    ranks = ranks_of(vocabulary)
    if sum(map(len, ranks)) + 8 * len(ranks) > MOST_VOCABULARY_BYTES:
        raise ValueError("the vocabulary is too large to be broadcast")
    return spark.createDataFrame(pa.table({"token": pa.array(list(ranks.values()), pa.int64()), "bytes": pa.array(list(ranks), pa.binary())}))


def decode(coded: DataFrame, vocabulary: str, id_column: str = "doc_id", ids_column: str = "ids", batch_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, ids, decoded`` for rows of little-endian unsigned 32-bit ids; null ids are empty."""
    kind = type_of(coded, id_column)
    rows = coded.select(coded[f"`{id_column}`"].alias("doc_id"), F.coalesce(F.col(f"`{ids_column}`"), F.lit(b"")).alias("ids"))
    header = f"batch long, token long, places binary, docs array<{kind}>, sources array<binary>"

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["batch", "token", "places", "docs", "sources"]
        for number, batch in enumerate(slices(batches, "ids", batch_bytes)):
            docs, sources = batch.column("doc_id"), batch.column("ids")
            flat = np.frombuffer(b"".join(sources.to_pylist()), "<u4")
            order = np.argsort(flat, kind="stable").astype("<u4")
            tokens, first = np.unique(flat[order], return_index=True)
            whole = [pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), a) for a in (docs, sources.cast(pa.binary()))]
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([None], pa.int64()), pa.array([None], pa.binary()), *whole], names)
            ends = 4 * np.append(first[1:], len(order)).astype(np.int64)[: len(tokens)]
            none = [pa.nulls(len(tokens), a.type) for a in whole]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(tokens), number)), pa.array(tokens.astype(np.int64)),
                                              binary_rows(order.view(np.uint8), ends), *none], names)

    def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: dict[int, tuple] = {}
        parts: dict[int, list] = defaultdict(list)
        have: dict[int, int] = defaultdict(int)

        def done(number: int) -> pa.RecordBatch:
            docs, sources, n, lengths = heads.pop(number)
            entries = parts.pop(number, [])
            have.pop(number, None)
            codes = np.zeros(n, np.int64)
            for code, (places, _) in enumerate(entries):
                codes[np.frombuffer(places, "<u4")] = code
            sizes = np.array([len(b or b"") for _, b in entries], np.int64)
            known = np.array([b is not None for _, b in entries], bool)
            flat = np.frombuffer(b"".join(b or b"" for _, b in entries), np.uint8)
            picks, ends = gathered(codes, np.cumsum(sizes) - sizes, sizes)
            last = np.cumsum(lengths)
            values = binary_rows(flat[picks], np.concatenate([np.zeros(1, np.int64), ends])[last])
            if not known.all():
                strange = np.concatenate([np.zeros(1, np.int64), np.cumsum(~known[codes])])
                values = pc.if_else(pa.array(strange[last] == strange[last - lengths]), values, pa.scalar(None, pa.binary()))
            return pa.RecordBatch.from_arrays([docs, sources, values], ["doc_id", "ids", "decoded"])

        for batch in batches:
            numbers = batch.column("batch").to_pylist()
            for row, (number, token, places, found) in enumerate(zip(numbers, *(batch.column(c).to_pylist() for c in ("token", "places", "bytes")))):
                if token is None:
                    docs, sources = batch.column("docs").slice(row, 1).flatten(), batch.column("sources").slice(row, 1).flatten()
                    lengths = pc.binary_length(sources).to_numpy(zero_copy_only=False).astype(np.int64) // 4
                    heads[number] = (docs, sources, int(lengths.sum()), lengths)
                else:
                    parts[number].append((places, found))
                    have[number] += len(places) // 4
                if number in heads and have[number] == heads[number][2]:
                    yield done(number)

    exploded = arrow_map(rows, explode, header)
    met = exploded.join(F.broadcast(token_bytes(coded.sparkSession, vocabulary)), "token", "left")
    return met.mapInArrow(reassemble, f"doc_id {kind}, ids binary, decoded binary")
