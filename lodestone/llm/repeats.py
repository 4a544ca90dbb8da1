"""Removal of repeated byte strings by blockwise suffix comparison with a difference cover.

A byte goes when some string of ``width`` bytes that covers it also starts anywhere else. Sorting all suffixes to that
depth would move every byte of the corpus many times, so suffixes are compared in four rounds:

1. Cover sample. D is a difference cover modulo v: for any two offsets some shift below v takes both into D. So two
   equal strings share a pair of sampled suffixes at equal distance from their starts, and equal to depth
   width - v + 1. Only sampled suffixes, |D| of v, are named (hashed to that depth) and compared.
2. Whole strings at sampled offsets whose name repeats. Inside a long match the cover has a pair every v < width bytes, so
   these strings cover it but for its ends.
3. Names around bytes still uncovered are marked; all groups that hold a marked name learn of it.
4. Whole strings at any offset that hold a marked name, which every repeated string with an uncovered byte does.

A round compares one bucket of suffixes at a time: suffixes are dealt by name, each group of documents sends the sorted
distinct names of a bucket once, however often they occur, and gets back those that occur elsewhere. A bucket is a task of
its own; long ties never touch the text again, because names of cover samples stand for it. Names of whole
strings are 64 bits over a random polynomial. Memory is bounded by a group of documents (``group_bytes``) and by a bucket.

Documents are grouped as the input splits have them, into a bucketed table, so that the rounds scan texts where they are and
only names are shuffled. The table, named repeats_ and a random number, stays in the warehouse: the result reads it.
Null text counts as empty. Rows with equal text are repeats of each other; rows of equal or null id stay separate rows. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.text import BASE, BYTE_VALUES, INVERSE, mixed, powers, text_or_empty, type_of
from lodestone.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIECE = 1 << 20
ROUNDS = 4
MOST_BUCKETS = 1 << 15
# Fixed value: a perfect difference set modulo 133; every difference but zero occurs exactly once.
PERFECT = {133: [0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109]}


def difference_cover(v: int) -> np.ndarray:
    """Residues such that every difference modulo v is one of theirs: a perfect set, or a ruler of small and large steps."""
    if v in PERFECT:
        return np.array(PERFECT[v])
    root = int(np.ceil(np.sqrt(v)))
    small, large = range(root), range(root, v + root, root)
    cover = sorted({r % v for r in [*small, *large]})
    chosen = list(cover)
    for r in reversed(cover):  # drop residues the others make up for
        rest = [x for x in chosen if x != r]
        if len({(a - b) % v for a in rest for b in rest}) == v:
            chosen = rest
    return np.array(chosen)


def prefix_sums(data: np.ndarray, up: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=total[1:])
    return total


class Text:
    """Hashes of substrings of one document, made piece by piece so that a long text needs no more memory."""

    def __init__(self, data: np.ndarray, width: int, up: np.ndarray, down: np.ndarray):
        self.data, self.width, self.up, self.down = data, width, up, down

    def hashes(self, at: np.ndarray, depth: int) -> np.ndarray:
        """64-bit hashes of data[i: i + depth] for sorted positions."""
        out = np.empty(len(at), np.uint64)
        for a in range(0, max(len(self.data), 1), PIECE):
            first, last = np.searchsorted(at, [a, a + PIECE])
            if first < last:
                total = prefix_sums(self.data[a: a + PIECE + depth], self.up)
                s = at[first:last] - a
                out[first:last] = (total[s + depth] - total[s]) * self.down[s]
        return mixed(out)


def sampled(n: int, depth: int, cover: np.ndarray, v: int) -> np.ndarray:
    """Offsets of the cover sample that have ``depth`` bytes after them."""
    starts = (np.arange(0, n, v)[:, None] + cover[None, :]).ravel()
    return starts[starts <= n - depth]


def spread(covered: np.ndarray, starts: np.ndarray, width: int) -> None:
    """Mark the bytes of strings that begin at ``starts``."""
    level = np.zeros(len(covered) + 1, np.int32)
    np.add.at(level, starts, 1)
    np.add.at(level, starts + width, -1)
    covered |= np.cumsum(level[:-1]) > 0


class Rounds:
    """What a group of documents asks in each round, given the answers of earlier rounds."""

    def __init__(self, width: int, v: int):
        self.width, self.v, self.cover = width, v, difference_cover(v)
        self.depth = width - v + 1
        self.up = self.down = np.zeros(0, np.uint64)

    def text(self, value: bytes) -> Text:
        if not len(self.up):  # made where they are used: they are long, the job is not
            self.up, self.down = powers(BASE, PIECE + self.width + 1), powers(INVERSE, PIECE + self.width + 1)
        return Text(np.frombuffer(value, np.uint8), self.width, self.up, self.down)

    def names(self, t: Text) -> tuple[np.ndarray, np.ndarray]:
        at = sampled(len(t.data), self.depth, self.cover, self.v) if len(t.data) >= self.width else np.zeros(0, np.int64)
        return at, t.hashes(at, self.depth) & np.uint64(0xFFFFFFFFFF)

    def state(self, t: Text, answers: list[np.ndarray], asked: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(names to send in round ``asked``, their weights, covered bytes so far). A weight sum over 1 marks a name."""
        at, name = self.names(t)
        n, covered = len(t.data), np.zeros(len(t.data), bool)
        if asked == 0:
            return name, np.ones(len(name), np.int8), covered
        keep = found_in(name, answers[0])
        at, name = at[keep], name[keep]
        if not len(at):
            return name, np.zeros(0, np.int8), covered
        whole = at[at <= n - self.width]
        hashes = t.hashes(whole, self.width)
        if asked == 1:
            return hashes, np.ones(len(hashes), np.int8), covered
        spread(covered, whole[found_in(hashes, answers[1])], self.width)
        if asked == 2:
            # A name matters where a string that could hold it still has an uncovered byte.
            gaps = np.concatenate([[0], np.cumsum(~covered)])
            low, high = np.maximum(at - self.v + 1, 0), np.minimum(at + self.width, n)
            return name, np.where(gaps[high] > gaps[low], 2, 0).astype(np.int8), covered
        near = np.zeros(n + 1, np.int32)
        at = at[found_in(name, answers[2])]
        np.add.at(near, np.maximum(at - self.v + 1, 0), 1)
        np.add.at(near, at + 1, -1)
        starts = np.flatnonzero((np.cumsum(near[:-1]) > 0)[: n - self.width + 1])
        hashes = t.hashes(starts, self.width)
        if asked > 3:
            spread(covered, starts[found_in(hashes, answers[3])], self.width)
        return hashes, np.ones(len(hashes), np.int8), covered


def found_in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values occur in a sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


def answers_of(replies: pd.DataFrame, rounds: int, buckets: int) -> list[np.ndarray]:
    def of(k: int) -> np.ndarray:
        rows = replies[replies["round"] == k]
        return np.sort(np.concatenate([np.zeros(0, np.uint64), *[expand(x, b, buckets) for x, b in zip(rows["names"], rows["bucket"])]]))

    return [of(k) for k in range(rounds)]


def asker(rounds: Rounds, asked: int, buckets: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Documents and answers of a group to one row per bucket: sorted distinct names, and those that repeat within the group."""
    def ask(docs: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        answers, waiting, size = answers_of(replies, asked, buckets), [], 0
        columns = ["round", "bucket", "grp", "names", "often"]
        if not len(docs):
            return pd.DataFrame(columns=columns)

        def squeeze(parts: tuple[np.ndarray, ...], counts: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
            values, count = np.concatenate(parts), np.concatenate(counts)
            order = np.argsort(values, kind="stable")
            values, count = values[order], count[order]
            fresh = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
            return values[fresh], np.minimum(np.add.reduceat(count, fresh), 2).astype(np.int8) if len(fresh) else count

        kept, nothing = [], (np.zeros(0, np.uint64), np.zeros(0, np.int8))
        for value in docs["data"]:
            name, weight, _ = rounds.state(rounds.text(value), answers, asked)
            waiting.append((name, weight))
            size += len(name)
            if size > 1 << 20:
                kept.append(squeeze(*zip(*waiting)))
                waiting, size = [], 0
        names, count = squeeze(*zip(nothing, *kept, *waiting))
        where = (names % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        cut = np.searchsorted(where[order], np.arange(buckets + 1))
        group, rows = docs["grp"].iloc[0], []
        for b in range(buckets):
            pick = order[cut[b]: cut[b + 1]]
            if len(pick):
                rows.append((asked, b, group, compact(names[pick], buckets), np.packbits(count[pick] > 1).tobytes()))
        return pd.DataFrame(rows, columns=columns)

    return ask


def compact(names: np.ndarray, buckets: int) -> bytes:
    """Sorted distinct names of one bucket: what the bucket does not say already, as steps from name to name, with the bytes
    of equal weight side by side, of which the high ones are few and compress well."""
    steps = names // np.uint64(buckets)
    first, steps = steps[0], np.diff(steps)
    planes = steps.astype("<u8").view(np.uint8).reshape(-1, 8).T
    width = int(steps.max()).bit_length() // 8 + 1 if len(steps) else 0
    return bytes([width]) + int(first).to_bytes(8, "little") + planes[:min(width, 8)].tobytes()


def expand(blob: bytes, bucket: int, buckets: int) -> np.ndarray:
    width = min(blob[0], 8)
    planes = np.frombuffer(blob, np.uint8, offset=9).reshape(width, -1) if width else np.zeros((0, 0), np.uint8)
    steps = np.zeros((planes.shape[1] + 1, 8), np.uint8)
    steps[1:, :width] = planes.T
    steps[0] = np.frombuffer(blob, np.uint8, 8, 1)
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64) * np.uint64(buckets) + np.uint64(bucket)


def replier(buckets: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Names of one bucket, from all groups, to each group's names that occur elsewhere or often; in the round of
    interest, to each group's names that some group marked."""
    def reply(asks: pd.DataFrame) -> pd.DataFrame:
        asked, bucket = int(asks["round"].iloc[0]), int(asks["bucket"].iloc[0])
        parts = [expand(x, bucket, buckets) for x in asks["names"]]
        flags = [np.unpackbits(np.frombuffer(o, np.uint8), count=len(p)).astype(bool) for o, p in zip(asks["often"], parts)]
        every = np.sort(np.concatenate(parts)) if asked != 2 else np.zeros(0, np.uint64)
        repeated = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *[p[f] for p, f in zip(parts, flags)]]))
        rows = [(g, asked, bucket, p[found_in(p, repeated)]) for g, p in zip(asks["grp"], parts)]
        return pd.DataFrame([(g, a, b, compact(n, buckets)) for g, a, b, n in rows if len(n)], columns=["grp", "round", "bucket", "names"])

    return reply


def answered(rounds: Rounds, buckets: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Documents and all answers of a group to (doc_id, n_bytes, spans, kept)."""
    def finish(docs: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        answers, rows = answers_of(replies, ROUNDS, buckets), []
        for doc, value in zip(docs["doc_id"], docs["data"]):
            t = rounds.text(value)
            _, _, covered = rounds.state(t, answers, ROUNDS)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
            spans = [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])]
            rows.append((doc, len(t.data), spans, t.data[~covered].tobytes()))
        return pd.DataFrame(rows, columns=["doc_id", "n_bytes", "spans", "kept"])

    return finish


def remove_repeats(docs: DataFrame, width: int = 200, modulus: int = 133, group_bytes: int = 16 << 20, id_column: str = "doc_id",
                   text_column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans array of struct(start, end), kept binary) per row; spans are the removed byte ranges."""
    if not 1 <= modulus < width:
        raise ValueError("modulus must be below width")
    spark, kind = docs.sparkSession, type_of(docs, id_column)
    rows = docs.select(docs[f"`{id_column}`"].cast("string").alias("doc_id"), text_or_empty(text_column).cast("binary").alias("data"))
    total = rows.agg(F.sum(F.octet_length("data") + 64)).first()[0] or 0
    # Documents stay where their input split has them; a split too large for a group is dealt over several by hash.
    splits = rows.rdd.getNumPartitions()
    share = max(1, -(-int(total) // max(splits, 1) // group_bytes))
    groups = max(splits * share, 1)
    buckets = min(groups, MOST_BUCKETS)  # beyond, larger groups keep the names of a group and bucket many
    group = F.spark_partition_id() * share + F.pmod(F.xxhash64("data", "doc_id"), F.lit(share)).cast("int")
    name = f"repeats_{uuid.uuid4().hex}"
    rows.withColumn("grp", group).write.bucketBy(min(groups, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))), "grp").option("compression", "zstd").saveAsTable(name)
    texts = spark.table(name)
    rounds = Rounds(width, modulus)
    replies = spark.createDataFrame([], "grp int, round int, bucket int, names binary")
    for asked in range(ROUNDS):
        asks = texts.groupBy("grp").cogroup(replies.groupBy("grp")).applyInPandas(asker(rounds, asked, buckets), "round int, bucket int, grp int, names binary, often binary")
        replies = replies.unionByName(cut_lineage(asks.groupBy("bucket").applyInPandas(replier(buckets), "grp int, round int, bucket int, names binary")))

    found = texts.groupBy("grp").cogroup(replies.groupBy("grp")).applyInPandas(
        answered(rounds, buckets), "doc_id string, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))  # as text on the way: pandas has no whole numbers with nulls
