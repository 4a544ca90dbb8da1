"""Text quality by a factorisation machine over hashed words, structure statistics and text metadata.

Score: w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j, with the pair sum from the identity
1/2 sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2), so a text costs time linear in its words.

The machine is fitted on at most ``sample`` labelled rows, those with the smallest hash of their id; that bound is the
parameter, everything else reads all rows and whole texts. Fitting reduces a text to a few hundred numbers in
Spark and minimises log loss over the bounded sample. Standardisation of the statistics comes from the sample.

Null text counts as empty and has a score like any text. Of contradicting labels of an id the larger counts; rows without
an id or label are never learnt from. Without usable labels of both classes every score is 0.5. Repeated rows are scored each. An empty
table gives no rows. The scored columns are only id and text, so other columns may have any name.
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

from lodestone.llm.text import arrow_map, flat, slices, text_or_empty, words

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATISTICS = 16


class Machine(NamedTuple):
    """Weights. The statistics come first, hashed words after them; the last row belongs to the constant."""
    linear: np.ndarray
    factors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray


class Sparse(NamedTuple):
    """Features of a batch: statistics per row, and word features as (row, column, value) sorted by row."""
    dense: np.ndarray
    row: np.ndarray
    column: np.ndarray
    value: np.ndarray


def classes_of_bytes() -> np.ndarray:
    """Byte class: 0 other, 1 lower case, 2 upper case, 3 digit, 4 space, 5 line end, 6 sentence mark, 7 other ASCII mark,
    8 first byte of a longer code point, 9 a further byte."""
    def kind(b: int) -> int:
        c = chr(b)
        return (9 if 128 <= b < 192 else 8 if b >= 192 else 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit()
                else 5 if c == "\n" else 4 if c.isspace() else 6 if c in ".,;:?!" else 7 if b > 32 else 0)
    return np.array([kind(b) for b in range(256)], np.uint8)


def features(texts: pa.Array, buckets: int) -> Sparse:
    data, offsets = flat(texts)
    n, sizes = len(texts), np.diff(offsets)
    row_of = np.repeat(np.arange(n), sizes)
    kinds = classes_of_bytes()[data]
    counts = np.bincount(row_of * 10 + kinds, minlength=10 * n).reshape(n, 10).astype(float)
    found = words(texts)
    per_row = np.bincount(found.row, minlength=n).astype(float)
    key = np.stack([found.row.astype(np.uint64), found.hash])
    order = np.lexsort((key[1], key[0]))
    row, code = found.row[order], found.hash[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
    at = np.flatnonzero(fresh)
    times = np.diff(np.append(at, len(row)))
    row, code = row[at], code[at]
    distinct = np.bincount(row, minlength=n).astype(float)
    most = np.zeros(n)
    np.maximum.at(most, row, times)
    # Repeats in a line: neighbouring equal words.
    same = np.zeros(n)
    if len(found.row) > 1:
        twice = (found.hash[1:] == found.hash[:-1]) & (found.row[1:] == found.row[:-1])
        same = np.bincount(found.row[1:][twice], minlength=n).astype(float)
    length = (found.end - found.start).astype(float)
    total = np.bincount(found.row, length, minlength=n)
    square = np.bincount(found.row, length ** 2, minlength=n)
    chars = np.maximum(counts[:, :9].sum(axis=1), 1)
    letters = np.maximum(counts[:, 1] + counts[:, 2] + counts[:, 8], 1)
    tokens = np.maximum(per_row, 1)
    mean = total / tokens
    dense = np.stack([
        np.log1p(chars), np.log1p(per_row), counts[:, 2] / letters, counts[:, 3] / chars, counts[:, 4] / chars,
        np.log1p(counts[:, 5]), counts[:, 6] / tokens, counts[:, 7] / tokens, counts[:, 8] / chars, distinct / tokens,
        most / tokens, same / tokens, mean, np.sqrt(np.maximum(square / tokens - mean ** 2, 0)),
        counts[:, 5] / tokens, counts[:, 0] / chars], axis=1)
    value = np.sqrt(times) / np.sqrt(np.maximum(per_row[row], 1))
    return Sparse(dense, row, (code % np.uint64(buckets)).astype(np.int64) + STATISTICS, value)


def raw_score(x: Sparse, m: Machine) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score before the logistic function, the factor sums per row, and the standardised statistics."""
    n = len(x.dense)
    dense = np.clip((x.dense - m.centre) / m.scale, -6, 6)
    linear = m.linear[-1] + dense @ m.linear[:STATISTICS] + np.bincount(x.row, x.value * m.linear[x.column], minlength=n)
    k = m.factors.shape[1]
    sums, squares = dense @ m.factors[:STATISTICS], dense ** 2 @ m.factors[:STATISTICS] ** 2
    for f in range(k):
        part = x.value * m.factors[x.column, f]
        sums[:, f] += np.bincount(x.row, part, minlength=n)
        squares[:, f] += np.bincount(x.row, part ** 2, minlength=n)
    return linear + 0.5 * (sums ** 2 - squares).sum(axis=1), sums, dense


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(x: Sparse, label: np.ndarray, buckets: int, rank: int, epochs: int, rate: float = 0.05, decay: float = 1e-4) -> Machine:
    """Adam over mini-batches with class-balanced log loss; the same sample in the same order gives the same weights."""
    random = np.random.default_rng(7)
    size = STATISTICS + buckets + 1
    centre, scale = x.dense.mean(axis=0), x.dense.std(axis=0) + 1e-6
    m = Machine(np.zeros(size), random.normal(0, 0.01, (size, rank)), centre, scale)
    share = np.clip(label.mean(), 1e-6, 1 - 1e-6)
    weight = np.where(label == 1, 0.5 / share, 0.5 / (1 - share))
    theta = np.concatenate([m.linear[:, None], m.factors], axis=1)
    first, second, step = np.zeros_like(theta), np.zeros_like(theta), 0
    begins = np.searchsorted(x.row, np.arange(len(label) + 1))
    for _ in range(epochs):
        order = random.permutation(len(label))
        for lot in np.array_split(order, max(1, len(label) // 512)):
            take = np.concatenate([np.arange(begins[r], begins[r + 1]) for r in lot]) if len(lot) else np.zeros(0, np.int64)
            local = Sparse(x.dense[lot], np.repeat(np.arange(len(lot)), begins[lot + 1] - begins[lot]), x.column[take], x.value[take])
            m = Machine(theta[:, 0], theta[:, 1:], centre, scale)
            z, sums, dense = raw_score(local, m)
            slope = weight[lot] * (logistic(z) - label[lot]) / len(lot)
            gradient = decay * theta
            gradient[-1, 0] += slope.sum()
            gradient[:STATISTICS, 0] += dense.T @ slope
            gradient[:STATISTICS, 1:] += dense.T @ (slope[:, None] * sums) - (dense ** 2).T @ slope[:, None] * m.factors[:STATISTICS]
            push = slope[local.row] * local.value
            gradient[:, 0] += np.bincount(local.column, push, minlength=size)
            for f in range(rank):
                inner = push * (sums[local.row, f] - local.value * m.factors[local.column, f])
                gradient[:, f + 1] += np.bincount(local.column, inner, minlength=size)
            step += 1
            first += 0.1 * (gradient - first)
            second += 0.001 * (gradient ** 2 - second)
            theta = theta - rate * first / (1 - 0.9 ** step) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return Machine(theta[:, 0], theta[:, 1:], centre, scale)


def sample_rows(docs: DataFrame, labels: DataFrame, label: str, sample: int, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, text, label) of the bounded sample. The ids are bounded by ``sample``, so joining them moves no text."""
    known = labels.select(F.col(f"`{id_column}`").alias("_id"), F.col(f"`{label}`").cast("int").alias("_label")).where(
        "_id is not null and _label is not null")
    chosen = known.groupBy("_id").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(docs[f"`{id_column}`"].alias("doc_id"), text_or_empty(text_column).alias("text"))
    return rows.join(F.broadcast(chosen), rows.doc_id == F.col("_id")).select("doc_id", "text", F.col("_label").alias("label"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 6000, buckets: int = 1 << 13, rank: int = 4,
        epochs: int = 12, id_column: str = "doc_id", text_column: str = "text") -> Machine | None:
    """Fit on at most ``sample`` labelled rows. ``labels`` holds only rows that may be learnt from."""
    rows = sample_rows(docs, labels, label, sample, id_column, text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = features(batch.column("text"), buckets)
            begins = np.searchsorted(x.row, np.arange(batch.num_rows + 1))
            column, value = x.column.astype("<u2"), x.value.astype("<f4")
            yield pa.RecordBatch.from_arrays([
                batch.column("label"), pa.array(np.asarray(batch.column("doc_id").cast(pa.string()).to_pylist(), object), pa.string()),
                pa.array([d.astype("<f4").tobytes() for d in x.dense], pa.binary()),
                pa.array([column[a:b].tobytes() for a, b in zip(begins, begins[1:])], pa.binary()),
                pa.array([value[a:b].tobytes() for a, b in zip(begins, begins[1:])], pa.binary())], ["label", "id", "dense", "columns", "values"])

    if buckets + STATISTICS > 1 << 16:
        raise ValueError("at most 2**16 feature columns")
    got = arrow_map(rows, run, "label int, id string, dense binary, columns binary, values binary").toArrow().sort_by("id")
    label_of = got.column("label").to_numpy().astype(float)
    if not 0 < label_of.sum() < len(label_of):
        return None
    columns = [np.frombuffer(c, "<u2") for c in got.column("columns").to_pylist()]
    x = Sparse(np.stack([np.frombuffer(d, "<f4") for d in got.column("dense").to_pylist()]).astype(float),
               np.repeat(np.arange(len(columns)), [len(c) for c in columns]), np.concatenate(columns).astype(np.int64),
               np.concatenate([np.frombuffer(v, "<f4") for v in got.column("values").to_pylist()]).astype(float))
    return train(x, label_of, buckets, rank, epochs)


def score(docs: DataFrame, machine: Machine | None, text_column: str = "text", score_column: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` with a score between 0 and 1 in ``score_column``, replaced where it exists."""
    docs = docs.drop(score_column)
    if machine is None:
        return docs.withColumn(score_column, F.lit(0.5))
    model = docs.sparkSession.sparkContext.broadcast(machine)
    buckets = len(machine.linear) - STATISTICS - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_column):
            z, _, _ = raw_score(features(batch.column(text_column), buckets), model.value)
            yield batch.append_column(score_column, pa.array(logistic(z)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return arrow_map(docs, run, f"{schema}, `{score_column}` double")
