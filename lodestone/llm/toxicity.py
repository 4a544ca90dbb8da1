"""Toxicity by class-conditional Kneser-Ney word models over shared backoff counts.

Class models are absolutely discounted word counts (modified Kneser-Ney discounts) that back off, with one weight for
both classes, to a shared distribution over continuation counts: the number of distinct preceding words, pooled over
classes. So a word that neither class has seen says nothing, and a rare one little. A text's score comes from the
log-likelihood ratio per word: its mean, the mean of its clear part, and the mean of its highest twentieth, so it does
not depend on length. A logistic function over these, fitted on labelled rows the counts did not use, makes it a probability.

Counts cover every labelled row that may be learnt from and grow with them; exact copies count once. Words are hashed to
2**WORD_BITS cells and contexts to 2**16, so tables have a fixed bound and are summed block by block in Spark. Only the
calibration uses a bounded sample: at most ``sample`` rows.

Null text counts as empty; a text without words has the score of a neutral one. Of contradicting labels of an id the larger
counts; rows without id or label are not learnt from. Without usable labels of both classes every score is 0.5. Repeated
rows are scored each; an empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.text import Words, arrow_map, slices, text_or_empty, words

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORD_BITS = 21
CELL_BITS = 14  # cells per block
CONTEXT_BITS = 16
CLEAR = 1.0


class Model(NamedTuple):
    """Log-likelihood ratio per word cell, and the weights of constant, mean, clear part and top twentieth."""
    ratio: np.ndarray
    weights: np.ndarray


def cells(found: Words) -> np.ndarray:
    return (found.hash >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def continuations(found: Words) -> np.ndarray:
    """Cell and hashed preceding word of every word, as one number; the first word of a text follows nothing."""
    before = np.zeros(len(found.hash), np.int64)
    before[1:] = np.where(found.row[1:] == found.row[:-1], (found.hash[:-1] & np.uint64((1 << CONTEXT_BITS) - 1)).astype(np.int64), 0)
    return cells(found) << CONTEXT_BITS | before


def merged(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and their summed counts."""
    keys, where = np.unique(values, return_inverse=True)
    return keys, np.bincount(where, counts, minlength=len(keys)).astype(np.int64)


def block_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, label) of a partition to one row per block of cells: sparse counts by class, and distinct continuations."""
    tally = {0: np.zeros(1 << WORD_BITS, np.int64), 1: np.zeros(1 << WORD_BITS, np.int64)}
    pairs, waiting = np.zeros(0, np.int64), []
    for batch in slices(batches, "text"):
        found = words(batch.column("text"))
        label = batch.column("label").to_numpy()[found.row]
        for kind in (0, 1):
            tally[kind] += np.bincount(cells(found)[label == kind], minlength=1 << WORD_BITS)
        waiting.append(np.unique(continuations(found)))
        if sum(map(len, waiting)) > 1 << 21:
            pairs, waiting = np.unique(np.concatenate([pairs, *waiting])), []
    pairs = np.unique(np.concatenate([pairs, *waiting]))
    if not len(pairs):
        return
    size = 1 << CELL_BITS
    cut = np.searchsorted(pairs >> CONTEXT_BITS, np.arange(0, (1 << WORD_BITS) + 1, size))
    rows = {"block": [], "seen": [], "ordinary": [], "toxic": [], "pairs": []}
    for block in range(1 << (WORD_BITS - CELL_BITS)):
        at = slice(block * size, (block + 1) * size)
        seen = np.flatnonzero(tally[0][at] + tally[1][at])
        if len(seen):
            rows["block"].append(block)
            rows["seen"].append(seen.astype("<u2").tobytes())
            rows["ordinary"].append(tally[0][at][seen].astype("<u4").tobytes())
            rows["toxic"].append(tally[1][at][seen].astype("<u4").tobytes())
            rows["pairs"].append((pairs[cut[block]: cut[block + 1]] & ((1 << (CELL_BITS + CONTEXT_BITS)) - 1)).astype("<u4").tobytes())
    yield pa.RecordBatch.from_pydict(rows)


def add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one block each, lists of every partition's tables, to (cell, ordinary, toxic, contexts)."""
    for batch in batches:
        for row in batch.to_pylist():
            size = 1 << CELL_BITS
            tally, pairs = {"ordinary": np.zeros(size), "toxic": np.zeros(size)}, np.zeros(0, np.uint32)
            for part in row["parts"]:
                seen = np.frombuffer(part["seen"], "<u2")
                for kind, total in tally.items():
                    total[seen] += np.frombuffer(part[kind], "<u4")
                pairs = np.union1d(pairs, np.frombuffer(part["pairs"], "<u4"))
            distinct = np.bincount(pairs >> CONTEXT_BITS, minlength=size)
            full = float(1 << CONTEXT_BITS)
            contexts = -full * np.log1p(-np.minimum(distinct, full - 1) / full)  # corrects for contexts of one hash
            cell = np.flatnonzero(tally["ordinary"] + tally["toxic"])
            yield pa.RecordBatch.from_arrays([pa.array(cell + row["block"] * size), pa.array(tally["ordinary"][cell]), pa.array(tally["toxic"][cell]),
                                              pa.array(contexts[cell])], ["cell", "ordinary", "toxic", "contexts"])


def discounts(count: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discount of every count."""
    n = [max(int(np.sum(np.round(count) == k)), 1) for k in range(1, 5)]
    y = n[0] / (n[0] + 2 * n[1])
    step = np.clip([0, 1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]], 0, [0, 0.95, 1.9, 2.8])
    return np.minimum(step[np.clip(np.round(count), 0, 3).astype(int)], count)


def ratios(cell: np.ndarray, ordinary: np.ndarray, toxic: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """log P(word | toxic) - log P(word | ordinary) for all cells."""
    spare = discounts(contexts)
    shared = (contexts - spare) / contexts.sum() + spare.sum() / contexts.sum() / (len(cell) + 1)
    freed = [discounts(c) for c in (toxic, ordinary)]
    shares = [f.sum() / c.sum() for f, c in zip(freed, (toxic, ordinary))]
    weight = float(np.clip(np.sqrt(shares[0] * shares[1]), 1e-3, 0.5))
    own = [(c - f) / c.sum() * (1 - weight) / max(1 - share, 1e-9) for c, f, share in zip((toxic, ordinary), freed, shares)]
    out = np.zeros(1 << WORD_BITS, np.float32)
    out[cell] = np.log(own[0] + weight * shared) - np.log(own[1] + weight * shared)
    return out


def evidence(texts: pa.Array, ratio: np.ndarray) -> np.ndarray:
    """Per text: constant, mean ratio, mean clear part, mean of the highest twentieth of its words, one at least."""
    found = words(texts)
    n, value = len(texts), ratio[cells(found)].astype(float)
    size = np.bincount(found.row, minlength=n)
    order = np.lexsort((-value, found.row))
    rank = np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size)
    top = rank < np.maximum(size // 20, 1)[found.row]
    some = np.maximum(size, 1)
    mean = np.bincount(found.row, value, minlength=n) / some
    clear = np.bincount(found.row, np.maximum(value - CLEAR, 0), minlength=n) / some
    high = np.bincount(found.row[top], value[order][top], minlength=n) / np.maximum(size // 20, 1)
    return np.stack([np.ones(n), mean, 10 * clear, high], axis=1)


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def calibrated(x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; toxic rows weigh by the root of the class ratio."""
    weight = np.where(label == 1, np.sqrt((label == 0).sum() / (label == 1).sum()), 1.0)
    theta, ridge = np.zeros(x.shape[1]), np.diag([1e-6] + [1e-2] * (x.shape[1] - 1))
    for _ in range(30):
        p = logistic(x @ theta)
        gradient = x.T @ (weight * (label - p)) - ridge @ theta
        theta = theta + np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, gradient)
    return theta


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = 20000, id_column: str = "doc_id",
        text_column: str = "text") -> Model | None:
    """``labels`` holds only rows that may be learnt from; an eighth of them, by hash of the id, is for calibration."""
    spark = docs.sparkSession
    known = labels.select(F.col(f"`{id_column}`").alias("_id"), F.col(f"`{label}`").cast("int").alias("label")).where(
        "_id is not null and label in (0, 1)").groupBy("_id").agg(F.max("label").alias("label"))
    rows = docs.select(docs[f"`{id_column}`"].alias("doc_id"), text_or_empty(text_column).alias("text"))
    apart = F.pmod(F.xxhash64("_id"), F.lit(8)) == 0
    # Distinct texts are chosen over ids and hashes, so texts move once, for the rows that count.
    chosen = rows.select("doc_id", F.xxhash64("text").alias("h")).join(known.where(~apart), F.col("doc_id") == F.col("_id")).groupBy("h", "label").agg(
        F.min("_id").alias("_id")).select("_id", "label")
    train = rows.join(chosen, F.col("doc_id") == F.col("_id")).select("text", "label")
    blocks = arrow_map(train, block_counts, "block long, seen binary, ordinary binary, toxic binary, pairs binary")
    parts = blocks.groupBy("block").agg(F.collect_list(F.struct("seen", "ordinary", "toxic", "pairs")).alias("parts"))
    table = parts.mapInArrow(add_blocks, "cell long, ordinary double, toxic double, contexts double").toArrow()
    cell, ordinary, toxic, contexts = (table.column(i).to_numpy() for i in range(4))
    if not (ordinary.sum() and toxic.sum()):
        return None
    ratio = ratios(cell, ordinary, toxic, contexts)
    shared = spark.sparkContext.broadcast(ratio)
    few = known.where(apart).orderBy(F.xxhash64("_id", F.lit(1)), "_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = evidence(batch.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("label"), *[pa.array(x[:, k]) for k in range(4)]], ["label", "a", "b", "c", "d"])

    got = rows.join(F.broadcast(few), F.col("doc_id") == F.col("_id")).select("text", "label")
    got = arrow_map(got, run, "label int, a double, b double, c double, d double").toArrow()
    truth = got.column("label").to_numpy().astype(float)
    if not 0 < truth.sum() < len(truth):
        return Model(ratio, np.array([-2.0, 1.0, 0.0, 1.0]))
    return Model(ratio, calibrated(np.stack([got.column(k).to_numpy() for k in range(1, 5)], axis=1), truth))


def score(docs: DataFrame, model: Model | None, text_column: str = "text", score_column: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` with a score between 0 and 1 in ``score_column``, replaced where it exists."""
    docs = docs.drop(score_column)
    if model is None:
        return docs.withColumn(score_column, F.lit(0.5))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in slices(batches, text_column):
            yield batch.append_column(score_column, pa.array(logistic(evidence(batch.column(text_column), known.ratio) @ known.weights)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return arrow_map(docs, run, f"{schema}, `{score_column}` double")
