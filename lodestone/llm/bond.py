"""Hard negatives by a vertical scan: vectors are stored by dimension and read in the order of an anchor's largest components.

Rows become integer vectors. Tasks lay their rows out in tiles, one column per dimension with its smallest and largest value. For an
anchor and a tile, columns are read in descending magnitude of the anchor's components. What the unread dimensions can still add lies
between sums of smallest and largest contributions, so after each step a bitmap keeps the candidates whose score may still count: for
positives, those that can reach the last of the best; for negatives, those that can fall into a positive's window and reach the last
place there. Columns are then read at the remaining candidates only, until their scores are exact.

Tiles and groups of anchors are of bounded size. Each pair of them is one group of a join on (anchor group, tile bucket), so no side is
broadcast or held whole, and the best rows per anchor are limited before they are shuffled.

Rows with a null label, a null vector, or a null or non-finite component take no part. A row whose id is the anchor's is never its
positive or negative; repeated rows count as often as they occur; equal anchors are one anchor. A null id comes last among ties and is no
anchor. Vectors of different length are compared as if the shorter ended in zeros. Integer scores are exact; a score that
does not fit 64 bits raises an error. An empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.text import arrow_map
from lodestone.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TILE_ROWS = 8192
GROUP_ANCHORS = 1024
STEP = 4  # dimensions between two looks at the bounds
MOST = (1 << 63) - 1


def integer_vectors(rows: DataFrame, id_column: str, vector_column: str, label_column: str, scale: int = 256,
                    relabel: Column | None = None) -> DataFrame:
    """``id, label, vector`` of the rows that take part; components are floor(scale * x)."""
    vector = F.col(f"`{vector_column}`")
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    label = F.col(f"`{label_column}`")
    return (rows.where(label.isNotNull() & vector.isNotNull() & whole)
            .select(F.col(f"`{id_column}`").cast("long").alias("id"), (label if relabel is None else relabel).cast("long").alias("label"),
                    F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("vector")))


def matrix(vectors: list[list[int]], dims: int) -> np.ndarray:
    """One row per dimension; shorter vectors end in zeros."""
    columns = np.zeros((dims, len(vectors)), np.int64)
    for i, v in enumerate(vectors):
        columns[: len(v), i] = v
    return columns


def tiles_of(rows: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``tile, dims, width, ids, labels, columns``: rows of a task in columnar tiles, in the narrowest integers that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []

        def tile() -> pa.RecordBatch:
            ids, labels, vectors = zip(*held)
            dims = max(map(len, vectors))
            columns = matrix(vectors, dims)
            largest = max(int(columns.max(initial=0)), -int(columns.min(initial=0)))
            width = next(w for w in (2, 4, 8) if w == 8 or largest < 1 << (8 * w - 1))
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([dims]), pa.array([width]), pa.array([ids], pa.list_(pa.int64())), pa.array([labels], pa.list_(pa.int64())),
                 pa.array([columns.astype(f"<i{width}").tobytes()])], ["tile", "dims", "width", "ids", "labels", "columns"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("id", "label", "vector"))):
                held.append(row)
                if len(held) == tile_rows:
                    yield tile()
                    held, number = [], number + 1
        if held:
            yield tile()

    return arrow_map(rows, run, "tile long, dims long, width long, ids array<long>, labels array<long>, columns binary")


class Tile:
    """Columns of a tile and the range of each."""

    def __init__(self, row: dict):
        self.ids = np.array([MOST if i is None else i for i in row["ids"]], np.int64)
        self.null = np.array([i is None for i in row["ids"]], bool)
        self.labels = np.array(row["labels"], np.int64)
        self.columns = np.frombuffer(row["columns"], f"<i{row['width']}").reshape(row["dims"], len(self.ids)).astype(np.int64)
        self.low, self.high = (self.columns.min(1), self.columns.max(1)) if len(self.columns) else (np.zeros(0, np.int64),) * 2


def scan(tile: Tile, anchor: np.ndarray, alive: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``alive`` that ``keep`` leaves over, with exact scores.

    ``keep(rows, at_least, at_most)`` says which rows can still count, given the range each score lies in.
    """
    dims = min(len(anchor), len(tile.columns))
    q = anchor[:dims]
    big = dims * int(np.abs(q).max(initial=0)) * max(-int(tile.low[:dims].min(initial=0)), int(tile.high[:dims].max(initial=0))) >= 1 << 61
    if big:
        q = q.astype(object)
    order = np.argsort(-np.abs(q), kind="stable")
    ends = np.stack([q * side[:dims].astype(q.dtype) for side in (tile.low, tile.high)])[:, order]
    # What the dimensions from the d-th of the order on can still add, at least and at most.
    least, most = (np.append(np.cumsum(side[::-1])[::-1], 0) for side in (ends.min(0), ends.max(0)))
    rows = np.flatnonzero(alive)
    scores = np.zeros(len(rows), object if big else np.int64)
    for first in range(0, dims, STEP):
        for d in order[first: first + STEP]:
            column = tile.columns[d] if len(rows) == len(tile.ids) else tile.columns[d][rows]
            scores = scores + q[d] * (column.astype(object) if big else column)
        done = min(first + STEP, dims)
        stay = keep(rows, scores + least[done], scores + most[done])
        if not stay.all():
            rows, scores = rows[stay], scores[stay]
        if not len(rows):
            break
    return rows, scores


def best_rows(tile: Tile, rows: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
    """Places of the first ``n``: higher scores first, then smaller ids, null ids last."""
    if len(rows) > n:
        last = np.partition(scores, len(scores) - n)[len(scores) - n]
        places = np.flatnonzero(scores >= last)
    else:
        places = np.arange(len(rows))
    return places[np.lexsort((tile.null[rows[places]], tile.ids[rows[places]], -scores[places]))][:n]


def positives_in(tile: Tile, anchor: dict, n: int) -> list[tuple]:
    """The tile's first ``n`` rows of the anchor's label: (id, score)."""
    others = (tile.labels == anchor["label"]) & ((tile.ids != anchor["id"]) | tile.null)

    def keep(rows: np.ndarray, at_least: np.ndarray, at_most: np.ndarray) -> np.ndarray:
        if len(rows) <= n:
            return np.ones(len(rows), bool)
        return at_most >= np.partition(at_least, len(rows) - n)[len(rows) - n]

    rows, scores = scan(tile, np.array(anchor["vector"], np.int64), others, keep)
    return [(None if tile.null[rows[i]] else int(tile.ids[rows[i]]), int(scores[i])) for i in best_rows(tile, rows, scores, n)]


def negatives_in(tile: Tile, anchor: dict, n: int, lowest: int, highest: int) -> list[tuple]:
    """For each positive of the anchor, the tile's first ``n`` rows of another label within the window: (place of the positive, id, score)."""
    others = (tile.labels != anchor["label"]) & ((tile.ids != anchor["id"]) | tile.null)
    # lowest * p <= 100 * s <= highest * p, in whole numbers
    windows = [(-(-lowest * p["score"] // 100), highest * p["score"] // 100) for p in anchor["positives"]]

    def keep(rows: np.ndarray, at_least: np.ndarray, at_most: np.ndarray) -> np.ndarray:
        stay = np.zeros(len(rows), bool)
        for low, high in windows:
            possible = (at_most >= low) & (at_least <= high)
            sure = at_least[(at_least >= low) & (at_most <= high)]
            if len(sure) > n:
                possible &= at_most >= np.partition(sure, len(sure) - n)[len(sure) - n]
            stay |= possible
        return stay

    if all(low > high for low, high in windows):
        return []
    rows, scores = scan(tile, np.array(anchor["vector"], np.int64), others, keep)
    found = []
    for place, (low, high) in enumerate(windows):
        inside = np.flatnonzero((scores >= low) & (scores <= high))
        for i in best_rows(tile, rows[inside], scores[inside], n):
            row = rows[inside[i]]
            found.append((place, None if tile.null[row] else int(tile.ids[row]), int(scores[inside[i]])))
    return found


def _meet(anchors: DataFrame, tiles: DataFrame, group_anchors: int) -> tuple[DataFrame, DataFrame]:
    """Groups of anchors and tiles, keyed so that each pair of a group and a bucket of tiles meets once."""
    groups = max(1, -(-anchors.count() // group_anchors))
    buckets = max(1, tiles.count())
    left = (anchors.withColumn("grp", F.pmod(F.xxhash64("number"), F.lit(groups)))
            .withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))))
    right = (tiles.withColumn("bucket_", F.pmod(F.xxhash64("tile"), F.lit(buckets)).cast("int"))
             .withColumn("grp_", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))))
    return left, right


def hard_negatives(rows: DataFrame, anchor: Column, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
                   relabel: Column | None = None, n_positives: int = 5, n_negatives: int = 10, lowest: int = 30, highest: int = 90,
                   scale: int = 256, tile_rows: int = TILE_ROWS, group_anchors: int = GROUP_ANCHORS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchor`` marks the anchors among the rows (a condition on ``id``, the id as long). A negative's score lies between ``lowest`` and
    ``highest`` percent of the positive's.
    """
    points = integer_vectors(rows, id_column, vector_column, label_column, scale, relabel)
    tiles = cut_lineage(tiles_of(points, tile_rows))
    anchors = cut_lineage(points.where(F.col("id").isNotNull() & anchor).distinct().withColumn("number", F.monotonically_increasing_id()))

    def positives(some: pa.Table, there: pa.Table) -> pa.Table:
        out: list[tuple] = []
        queries = some.to_pylist()
        for row in there.to_pylist():
            tile = Tile(row)
            for a in queries:
                out += [(a["number"], i, s) for i, s in positives_in(tile, a, n_positives)]
        numbers, ids, scores = zip(*out) if out else ((), (), ())
        return pa.table({"number": pa.array(numbers, pa.int64()), "id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.int64())})

    left, right = _meet(anchors, tiles, group_anchors)
    found = left.groupBy("grp", "bucket").cogroup(right.groupBy("grp_", "bucket_")).applyInArrow(positives, "number long, id long, score long")
    first = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    best = found.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= n_positives)
    lists = best.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("_rank", "id", "score"))).alias("positives"))
    armed = cut_lineage(anchors.join(lists, "number"))

    def negatives(some: pa.Table, there: pa.Table) -> pa.Table:
        out: list[tuple] = []
        queries = some.to_pylist()
        for row in there.to_pylist():
            tile = Tile(row)
            for a in queries:
                out += [(a["number"], p, i, s) for p, i, s in negatives_in(tile, a, n_negatives, lowest, highest)]
        columns = zip(*out) if out else ((),) * 4
        return pa.table({k: pa.array(c, pa.int64()) for k, c in zip(("number", "place", "id", "score"), columns)})

    left, right = _meet(armed, tiles, group_anchors)
    hits = left.groupBy("grp", "bucket").cogroup(right.groupBy("grp_", "bucket_")).applyInArrow(
        negatives, "number long, place long, id long, score long")
    within = Window.partitionBy("number", "place").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    kept = hits.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= n_negatives)
    heads = armed.select("number", F.col("id").alias("anchor_id"), F.posexplode("positives").alias("at", "positive")).select(
        "number", "anchor_id", F.col("at").cast("long").alias("place"), F.col("positive.id").alias("positive_id"), F.col("positive.score").alias("positive_score"))
    return kept.join(heads, ["number", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
